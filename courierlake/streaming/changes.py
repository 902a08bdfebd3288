"""A stream of a mailbox's changes: numbered messages behind a cursor.

The cursor is ``validity:highest``. Another validity means that the numbers were dealt anew, and the stream
starts again from the first; repeats are left to the deduplication behind it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def encode_cursor(validity: int, highest: int) -> str:
    return f"{validity}:{highest}"


def decode_cursor(cursor: str | None) -> tuple[int, int] | None:
    """Validity and highest number; None for anything else, which asks for a full listing."""
    parts = (cursor or "").split(":")
    return (int(parts[0]), int(parts[1])) if len(parts) == 2 and all(p.isdigit() for p in parts) else None


def first_new(cursor: str | None, validity: int) -> int:
    """The number from which to list."""
    held = decode_cursor(cursor)
    return held[1] + 1 if held and held[0] == validity else 1


class Changes(DataSource):
    """``spark.readStream.format("mailbox_changes").load(folder)``: a folder has ``state.json`` (``validity``) and a
    file ``<uid>.eml`` for each message."""

    @classmethod
    def name(cls) -> str:
        return "mailbox_changes"

    def schema(self) -> str:
        return "validity bigint, uid bigint, raw binary"

    def streamReader(self, schema) -> "ChangesReader":
        return ChangesReader(self.options["path"], int(self.options.get("uidsPerTask", "1000")))


class Span(InputPartition):
    def __init__(self, validity: int, first: int, last: int):
        self.validity, self.first, self.last = validity, first, last


class ChangesReader(DataSourceStreamReader):
    def __init__(self, folder: str, step: int):
        self.folder, self.step = Path(folder), step

    def _state(self) -> tuple[int, int]:
        validity = json.loads((self.folder / "state.json").read_text())["validity"]
        return validity, max((int(p.stem) for p in self.folder.glob("*.eml")), default=0)

    def initialOffset(self) -> dict:
        return {"cursor": encode_cursor(0, 0)}

    def latestOffset(self) -> dict:
        return {"cursor": encode_cursor(*self._state())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        validity, highest = decode_cursor(end["cursor"]) or (0, 0)
        first = first_new(start["cursor"], validity)
        return [Span(validity, a, min(a + self.step - 1, highest)) for a in range(first, highest + 1, self.step)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for uid in range(partition.first, partition.last + 1):
            path = self.folder / f"{uid}.eml"
            if path.exists():
                yield partition.validity, uid, path.read_bytes()

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint holds the cursor once a batch is whole."""
