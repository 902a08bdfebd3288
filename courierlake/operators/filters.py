"""Filters of message and attachment search as one predicate each."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Fields of a search over everything, and those with a fuzzy layer.
MESSAGE_FIELDS = ("subject", "body", "sender", "to", "cc", "bcc", "attachment_name")
MESSAGE_FUZZY = ("subject", "sender", "to", "cc", "bcc", "attachment_name")
ATTACHMENT_FIELDS, ATTACHMENT_FUZZY = ("subject", "text", "name", "sender"), ("subject", "sender", "name")
#: Columns whose ranges a search over everything may ask for, with their types.
MESSAGE_RANGES = {c: "bigint" for c in ("date", "internal_date", "ingest_at", "size")}
LISTS = {"to", "cc", "bcc", "attachment_name"}


def _words(field: str) -> list[Column]:
    """What phrases are sought in: a text, or the values of a list framed apart, so that none spans two of them."""
    if field not in LISTS:
        return [X.sequence_text(F.col(field))]
    return [F.concat(F.lit(""), F.array_join(F.transform(F.coalesce(F.col(field), F.array().cast("array<string>")), X.sequence_text), "\n"))]


def _gram_text(field: str) -> Column:
    """Where grams are sought: a text, or all values of a list in lines of their own, as no term holds a line feed."""
    return X.gram_text(F.array_join(field, "\n") if field in LISTS else F.col(field))


def words_or_grams(query: str, fields: Collection[str], fuzzy: Collection[str] = (), ranges: dict[str, str] | None = None) -> Column:
    """The query over ``fields``, or its fuzzy layer over ``fuzzy``. Clauses may name one of the fields, or a range of a column in
    ``ranges`` (its name and type). What is sought in a field is made once for a row."""
    ranges = ranges or {}
    each = lambda made: F.struct(*(c.alias(f"f{i}") for i, c in enumerate(made)))
    seqs = [w for f in fields for w in _words(f)]

    def words(s: Column) -> Column:
        own = [s[f"f{i}"] for i in range(len(seqs))]
        return X.word_match(own, query, dict(zip(fields, own)), {c: (F.col(c), kind) for c, kind in ranges.items()})

    found = X.let(each(seqs), words)
    if not fuzzy or not X.fuzzy_terms(query):
        return found
    return found | X.let(each([_gram_text(f) for f in fuzzy]), lambda g: X.fuzzy_match([g[f"f{i}"] for i in range(len(fuzzy))], query))


def within(column: str, ids: Collection | None) -> Column:
    """No restriction for none; an empty set holds nothing."""
    if ids is None:
        return F.lit(True)
    return F.col(column).isin(*ids) if ids else F.lit(False)


def between(column: str, low=None, high=None) -> Column:
    """Both bounds belong to the range; null is in no range."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= low)
    if high is not None:
        out = out & (F.col(column) <= high)
    return out


def has_tags(column: str, tags: Collection[str] | None) -> Column:
    """One of the tags, or a tag below one of them; an empty set doesn't restrict."""
    if not tags:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(X.facet_prefixes(F.col(column)), F.array(*map(F.lit, tags))), F.lit(False))


@dataclass(frozen=True)
class MessageFilter:
    """What a message search asks for; all of it must hold."""

    text: str | None = None
    subject: str | None = None
    body: str | None = None
    tags: tuple[str, ...] | None = None
    sender: str | None = None
    to: str | None = None
    cc: str | None = None
    bcc: str | None = None
    any_recipient: str | None = None
    any_participant: str | None = None
    has_attachment: bool | None = None
    attachment_name: str | None = None
    id: str | int | None = None
    message_id: str | None = None
    attachment_extension: str | None = None
    attachment_category: str | None = None
    attachment_content_type: str | None = None
    since: int | None = None
    before: int | None = None
    internal_date_since: int | None = None
    internal_date_before: int | None = None
    ingest_since: int | None = None
    ingest_before: int | None = None
    account_ids: tuple | None = None
    mailbox_ids: tuple | None = None
    min_size: int | None = None
    max_size: int | None = None

    def has_text(self) -> bool:
        """Whether relevance can rank the hits."""
        return any(x and x.strip() for x in (self.text, self.subject, self.body))

    def column(self, accounts: Collection | None = None) -> Column:
        """The predicate; ``accounts`` are those that the user may search, none for all."""
        c = within("account_id", accounts) & within("account_id", self.account_ids) & within("mailbox_id", self.mailbox_ids)
        c = c & between("date", self.since, self.before) & between("internal_date", self.internal_date_since, self.internal_date_before)
        c = c & between("ingest_at", self.ingest_since, self.ingest_before) & between("size", self.min_size, self.max_size)
        for name, value in (("id", self.id), ("message_id", self.message_id)):
            c = c & (F.col(name) == value) if value is not None else c
        if self.has_attachment is not None:
            n = F.col("regular_attachment_count")
            c = c & (n >= 1 if self.has_attachment else n == 0)
        for name, value in (("attachment_ext", self.attachment_extension), ("attachment_category", self.attachment_category), ("attachment_content_type", self.attachment_content_type)):
            c = c & F.array_contains(name, value) if value is not None else c
        c = c & has_tags("tags", self.tags)
        if self.text is not None:
            c = c & words_or_grams(self.text, MESSAGE_FIELDS, MESSAGE_FUZZY, MESSAGE_RANGES)
        if self.body is not None:
            c = c & words_or_grams(self.body, ["body"])
        for name in ("subject", "sender", "to", "cc", "bcc"):
            if (value := getattr(self, name)) is not None:
                c = c & words_or_grams(value, [name], [name])
        for value, names in ((self.any_recipient, ("to", "cc", "bcc")), (self.any_participant, ("sender", "to", "cc", "bcc"))):
            if value is not None:
                any_of = F.lit(False)
                for name in names:
                    any_of = any_of | words_or_grams(value, [name], [name])
                c = c & any_of
        if self.attachment_name is not None:
            named = words_or_grams(self.attachment_name, ["attachment_name"], ["attachment_name"])
            c = c & (named | F.array_contains("attachment_name", self.attachment_name) if "." in self.attachment_name else named)
        return c


@dataclass(frozen=True)
class AttachmentFilter:
    """What an attachment search asks for; all of it must hold."""

    text: str | None = None
    subject: str | None = None
    sender: str | None = None
    tags: tuple[str, ...] | None = None
    content_hash: str | None = None
    id: str | int | None = None
    attachment_name: str | None = None
    attachment_extension: str | None = None
    attachment_category: str | None = None
    attachment_content_type: str | None = None
    since: int | None = None
    before: int | None = None
    account_ids: tuple | None = None
    mailbox_ids: tuple | None = None
    min_size: int | None = None
    max_size: int | None = None
    is_ocr: bool | None = None
    is_message: bool | None = None
    has_text: bool | None = None
    min_page_count: int | None = None
    max_page_count: int | None = None

    def column(self, accounts: Collection | None = None) -> Column:
        c = within("account_id", accounts) & within("account_id", self.account_ids) & within("mailbox_id", self.mailbox_ids)
        c = c & between("date", self.since, self.before) & between("size", self.min_size, self.max_size) & between("page_count", self.min_page_count, self.max_page_count)
        same = {"content_hash": self.content_hash, "id": self.id, "attachment_ext": self.attachment_extension, "attachment_category": self.attachment_category, "attachment_content_type": self.attachment_content_type, "is_ocr": self.is_ocr, "is_message": self.is_message, "has_text": self.has_text}
        for name, value in same.items():
            c = c & (F.col(name) == F.lit(value)) if value is not None else c
        c = c & has_tags("tags", self.tags)
        if self.text is not None:
            c = c & words_or_grams(self.text, ATTACHMENT_FIELDS, ATTACHMENT_FUZZY)
        for name, value in (("subject", self.subject), ("sender", self.sender)):
            c = c & words_or_grams(value, [name], [name]) if value is not None else c
        if self.attachment_name is not None:
            c = c & (words_or_grams(self.attachment_name, ["name"], ["name"]) | (F.col("name") == self.attachment_name))
        return c


def authorised(df: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """Rows of the accounts in a table of ids; none doesn't restrict."""
    return df if accounts is None else df.join(accounts.select("account_id").distinct(), "account_id", "left_semi")


def valid_pattern(pattern: str) -> bool:
    """Whether a pattern compiles in the class by which Spark matches; no job is run."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # PatternSyntaxException is one
        return False
    return True


@dataclass(frozen=True)
class FilterRule:
    """Values that pass (if any are named) and values that don't; exact ones ignore case, patterns are searched. A pattern that isn't valid
    matches nothing."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()

    def column(self, value: Column) -> Column:
        hit = lambda exact, patterns: self._any([F.lower(value) == e.lower() for e in exact] + [value.rlike(p) for p in patterns if valid_pattern(p)])
        passes = hit(self.include, self.include_patterns) if self.include or self.include_patterns else F.lit(True)
        return passes & ~hit(self.exclude, self.exclude_patterns)

    @staticmethod
    def _any(found: list[Column]) -> Column:
        out = F.lit(False)
        for f in found:
            out = out | f
        return out


def should_archive(enabled: bool, sender: FilterRule, subject: FilterRule, most_bytes: int | None = None, skip_spam: bool = False, columns=("sender", "subject", "size", "spam")) -> Column:
    """Whether a message is archived. Rules that are off pass all; a missing sender or subject passes."""
    if not enabled:
        return F.lit(True)
    s, t, n, spam = map(F.col, columns)
    c = F.coalesce(sender.column(s), F.lit(True)) & F.coalesce(subject.column(t), F.lit(True))
    if most_bytes is not None:
        c = c & ~(n > most_bytes)
    if skip_spam:
        c = c & ~F.coalesce(F.lower(F.trim(spam)).isin("yes", "true"), F.lit(False))
    return c


def should_extract(enabled: bool, rules: dict[str, FilterRule]) -> Column:
    """Whether an attachment's text is extracted; rules that are off extract nothing."""
    c = F.lit(bool(enabled))
    for name, rule in rules.items():
        c = c & F.coalesce(rule.column(F.col(name)), F.lit(True))
    return c


#: Extensions and media types with text, and the size up to which it is extracted.
TEXT_EXTENSIONS = ("pdf", "docx", "pptx", "xlsx", "xls", "odt", "odp", "ods", "txt", "md", "csv", "log", "json", "xml", "html", "htm")
MOST_EXTRACTED = 10 * 1024 * 1024


def should_try_extract(ext: Column, content_type: Column, size: Column) -> Column:
    known = F.coalesce(F.lower(ext).isin(*TEXT_EXTENSIONS), F.lit(False)) | F.coalesce(F.lower(content_type).startswith("text/") | F.lower(content_type).contains("pdf") | F.lower(content_type).contains("officedocument"), F.lit(False))
    return known & (size <= MOST_EXTRACTED)


def retention_expired(cutoff: int, date: str = "date", internal: str = "internal_date") -> Column:
    """Either date is known (positive) and before the cutoff."""
    old = lambda c: (F.col(c) > 0) & (F.col(c) < cutoff)
    return old(date) | old(internal)


def before_day(ts: Column, day: str) -> Column:
    """The UTC day of a timestamp is before a day."""
    return F.to_date(ts) < F.lit(day).cast("date")


def download_due(now_ms: int, manual: Column, last_finished: Column, last_trigger: Column, interval_min: Column, cooldown_ms: int = 60_000) -> Column:
    """Whether an account is to be fetched: never fetched or asked for by hand, or a minute behind the last end and
    an interval (an hour unless set) behind the last start."""
    rested = F.lit(now_ms) - F.coalesce(last_finished, F.lit(0)) > cooldown_ms
    due = F.lit(now_ms) - last_trigger > F.coalesce(interval_min, F.lit(60)).cast("long") * 60_000
    return last_trigger.isNull() | manual | (rested & due)
