"""Lookups that join messages with accounts, mailboxes and users, and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled


def enrich(messages: DataFrame, accounts: DataFrame, mailboxes: DataFrame, strict: bool = False) -> DataFrame:
    """Messages with the address of their account and the name of their mailbox; those without either drop out.
    ``strict``: one that is missing fails the query."""
    if not strict:
        return messages.join(accounts.select("account_id", "account_email"), "account_id").join(mailboxes.select("mailbox_id", "mailbox_name"), "mailbox_id")
    out = messages.join(accounts.select("account_id", "account_email"), "account_id", "left").join(mailboxes.select("mailbox_id", "mailbox_name"), "mailbox_id", "left")
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)).alias(c)
    return out.select(*messages.columns, need("account_email"), need("mailbox_name"))


def owner_of(accounts: DataFrame, users: DataFrame) -> DataFrame:
    """Accounts with the name and address of their creator, or what stands for an unknown one."""
    held = accounts.join(users.select(F.col("user_id").alias("created_by"), "user_name", "user_email"), "created_by", "left")
    return held.select(*accounts.columns, F.coalesce("user_name", F.lit("Unknown")).alias("created_user_name"), F.coalesce("user_email", F.lit("N/A")).alias("created_user_email"))


def parents_of(attachments: DataFrame, messages: DataFrame, columns: list[str]) -> DataFrame:
    """Attachments with columns of their message; null for those without one."""
    parent = messages.select(F.col("id").alias("eid"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return attachments.join(parent, "eid", "left")


def missing_messages(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote rows that no local row has, neither by message id nor by size and internal date. A null message id
    is sought by the fingerprint alone. Two anti-joins on equal keys, never one join on ``or``."""
    by_id = remote.join(local.where("message_id is not null").select("message_id"), "message_id", "left_anti")
    return by_id.join(local.select("size", "internal_date"), ["size", "internal_date"], "left_anti").select(*remote.columns)


def missing_by_id(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote rows whose message id isn't known locally; null ids count as missing."""
    return remote.join(local.select("message_id"), "message_id", "left_anti")


def same_names(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Mailboxes on both sides, by name."""
    return local.join(remote.select("name"), "name", "left_semi")


def new_names(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote mailboxes that aren't local yet."""
    return remote.join(local.select("name"), "name", "left_anti")


def mailbox_changes(known: DataFrame, now: DataFrame) -> DataFrame:
    """Names that appeared and that went, with ``change``."""
    added = now.select("name").distinct().join(known, "name", "left_anti").select("name", F.lit("new").alias("change"))
    gone = known.select("name").distinct().join(now, "name", "left_anti").select("name", F.lit("deleted").alias("change"))
    return added.union(gone)


def referenced_hashes(messages: DataFrame) -> DataFrame:
    """All blob addresses that messages name, as their own or an attachment's."""
    own = messages.select("content_hash")
    return own.union(messages.select(F.explode("attachment_content_hash"))).where("content_hash is not null").distinct()


def orphan_blobs(blobs: DataFrame, messages: DataFrame) -> DataFrame:
    return blobs.join(referenced_hashes(messages), "content_hash", "left_anti")


def missing_blobs(blobs: DataFrame, messages: DataFrame) -> DataFrame:
    """Addresses that messages name but the store doesn't have."""
    return referenced_hashes(messages).join(blobs, "content_hash", "left_anti")


def mailbox_and_below(mailboxes: DataFrame, account, name: str, delimiter: str = "/") -> DataFrame:
    """A mailbox and all below it in the hierarchy of names."""
    return mailboxes.where((F.col("account_id") == account) & ((F.col("name") == name) | F.col("name").startswith(name + delimiter)))


def folder_paths(folders: DataFrame, most: int = 64) -> DataFrame:
    """``id`` and ``path`` of folders that name their ``parent_id``: the chain of names, cut where a parent is
    missing or after ``most`` links. Pointers double each round, so rounds grow with the logarithm of depth. Each
    round is written to the checkpoint folder and joined from there; the rounds end when no folder has a parent left."""
    out = folders.select("id", F.col("parent_id").alias("up"), F.col("name").alias("path"), F.lit(1).alias("depth"))
    steps = 1
    while steps < most:
        above = out.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"), F.col("depth").alias("more"))
        path = F.when(F.col("above").isNotNull() & (F.col("depth") + F.col("more") <= most), F.concat("above", F.lit("/"), "path")).otherwise(F.col("path"))
        out = settled(out.join(above, "up", "left").select("id", F.col("next").alias("up"), path.alias("path"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        if out.where("up is not null").isEmpty():
            break
        steps *= 2
    return out.select("id", "path")


def folder_tree(names: DataFrame, delimiter: str = "/", name: str = "name") -> DataFrame:
    """Every folder of a tree, parents that have no row of their own included, with its depth and ``sort_key``, by which
    folders come in natural order, each before those below it."""
    parts = F.split(F.col(name), delimiter)
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), delimiter))
    nodes = names.select(F.col(name).alias("own"), F.explode(up).alias("path"))
    return nodes.groupBy("path").agg(F.bool_or(F.col("own") == F.col("path")).alias("selectable")).select("path", (F.size(F.split("path", delimiter)) - 1).alias("depth"), "selectable", natural_key(F.col("path"), delimiter).alias("sort_key"))


#: Digits that a number in a sort key is padded to.
DIGITS = 20


def natural_key(path: Column, delimiter: str = "/") -> Column:
    """A key that sorts paths as people do: case doesn't count, ``a2`` comes before ``a10``, and a folder before those below it. Runs of digits
    are padded with zeros after leading zeros are dropped; longer ones than ``DIGITS`` stay as they are. Levels are parted by a character below all others."""
    plain = F.replace(F.lower(path), F.lit(delimiter), F.lit("\x01"))
    parts = F.regexp_extract_all(plain, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(number(p), F.greatest(F.lit(DIGITS), F.length(number(p))), F.lit("0"))).otherwise(p)), "")


def retain_in_mailbox(created: DataFrame, updated: DataFrame, members: DataFrame) -> DataFrame:
    """Changed ids that are in a mailbox."""
    return created.select("id").union(updated.select("id")).distinct().join(members.select("id"), "id", "left_semi")


def snapshot(messages: DataFrame, account, mailbox) -> DataFrame:
    """What a reconciliation compares: message id, uid, size and internal date; empty ids skipped, unknown numbers zero."""
    held = messages.where((F.col("account_id") == account) & (F.col("mailbox_id") == mailbox) & (F.col("message_id") != ""))
    return held.select("message_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("uid", "size", "internal_date")))


def message_ids(messages: DataFrame, account, mailbox) -> DataFrame:
    return messages.where((F.col("account_id") == account) & (F.col("mailbox_id") == mailbox) & (F.col("message_id") != "")).select("message_id").distinct()


def minimal_accounts(accounts: DataFrame, syncable: bool = False) -> DataFrame:
    """Ids and addresses; ``syncable``: without accounts of the type ``NoSync``. An account without a type is fetched."""
    held = accounts.where(F.coalesce("account_type", F.lit("")) != "NoSync") if syncable else accounts
    return held.select("account_id", "email")


def by_id(df: DataFrame, account, key) -> DataFrame:
    return df.where((F.col("account_id") == account) & (F.col("id") == key)).limit(1)


def exists(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: whether any row holds."""
    return df.where(predicate).limit(1).agg((F.count("*") > 0).alias("found"))


def by_id_or_email(accounts: DataFrame, account, email: str | None) -> DataFrame:
    """The account of an id; where there is none, the first one of the address."""
    same = F.col("account_id") == F.lit(account)
    if email is None:
        return accounts.where(same).limit(1)
    alike = F.lower(F.trim("email")) == email.strip().lower()
    return accounts.where(same | alike).orderBy(F.coalesce(same, F.lit(False)).desc(), F.col("account_id").cast("string")).limit(1)


def by_email(accounts: DataFrame, email: str) -> DataFrame:
    """The first account of an address in key order; case and spaces around it don't count."""
    return accounts.where(F.lower(F.trim("email")) == email.strip().lower()).orderBy(F.col("account_id").cast("string")).limit(1)
