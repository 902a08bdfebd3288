"""Schemas of the tables. The sender column is called ``sender`` where mail headers say ``From``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 4
#: Metadata of the first field, under which a table's version is kept.
VERSION_KEY = "courierlake.schema_version"

_attachment = "array<struct<filename:string,file_type:string,size:bigint,content_hash:string,inline:boolean,content_id:string>>"
MESSAGES = (
    "id string, message_id string, account_id bigint, mailbox_id bigint, uid bigint, subject string, preview string, body string, content_hash string, "
    "sender string, `to` array<string>, cc array<string>, bcc array<string>, date bigint, internal_date bigint, ingest_at bigint, size bigint, thread_id string, "
    f"attachment_count bigint, regular_attachment_count bigint, attachments {_attachment}, attachment_content_hash array<string>, attachment_ext array<string>, "
    "attachment_category array<string>, attachment_content_type array<string>, attachment_name array<string>, tags array<string>, shard_id bigint"
)
ATTACHMENTS = (
    "id string, eid string, account_id bigint, mailbox_id bigint, subject string, content_hash string, sender string, date bigint, ingest_at bigint, size bigint, "
    "attachment_ext string, attachment_category string, attachment_content_type string, shard_id bigint, text string, has_text boolean, is_ocr boolean, "
    "page_count bigint, is_indexed boolean, is_message boolean, name string, tags array<string>, auto_tags array<string>"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def stamped(df: DataFrame, version: int = VERSION) -> DataFrame:
    """``df`` with its schema version in the metadata of its first column."""
    first, *rest = df.columns
    return df.select(F.col(f"`{first}`").alias(first, metadata={VERSION_KEY: version}), *(f"`{c}`" for c in rest))


def checked(df: DataFrame, version: int = VERSION) -> DataFrame:
    """``df`` if its schema version is the one expected; others are refused."""
    found = df.schema.fields[0].metadata.get(VERSION_KEY)
    if found != version:
        raise ValueError(f"the table has schema version {found}, not {version}: rebuild it")
    return df
