"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import tables

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL, whose ``{m}``, ``{a}``, ``{t}`` and ``{c}`` stand for the views of ``tables``."""

    def put(f):
        assert name not in FOUND, name
        FOUND[name] = f
        if sql:
            text = sql
            for mark, view in (("{m}", tables.MESSAGES_SQL), ("{a}", tables.ATTACHMENTS_SQL), ("{t}", tables.TEXTS_SQL), ("{c}", tables.ACCOUNTS_SQL)):
                text = text.replace(mark, view)
            SQL[name] = text
        return f

    return put
