"""Sorting, paging and ranking of search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .filters import LISTS, AttachmentFilter, MessageFilter, within
from .terms import K1, B, TermIndex, parts_of, query_weights

SORT_KEYS = {"DATE": "date", "SIZE": "size", "INTERNAL_DATE": "internal_date", "INGEST_AT": "ingest_at"}
MOST_PAGE = 500


def resolve_sort(sort_by: str | None, has_text: bool) -> str:
    """Dates are the default; relevance needs a text to rank by."""
    return "DATE" if sort_by is None or (sort_by == "RELEVANCE" and not has_text) else sort_by


def page_bounds(page: int, size: int) -> tuple[int, int]:
    """Offset and limit of a page, which counts from 1 and has 1 to 500 rows."""
    if page < 1 or not 1 <= size <= MOST_PAGE:
        raise ValueError("pages count from 1 and have 1 to 500 rows")
    return (page - 1) * size, size


def sorted_page(df: DataFrame, key: str, page: int, size: int, descending: bool = True, tie: str = "id") -> DataFrame:
    """A page in the order of ``key``; equal keys by id, so that pages don't overlap."""
    offset, limit = page_bounds(page, size)
    return df.orderBy(F.desc(key) if descending else F.asc(key), tie).offset(offset).limit(limit)


def page_info(df: DataFrame, page: int, size: int) -> DataFrame:
    """One row: total, pages and the page asked for. A page beyond the end is empty, not an error."""
    page_bounds(page, size)
    total = F.count("*")
    return df.agg(total.alias("total_items"), F.ceil(total / size).alias("total_pages")).select(F.lit(page).alias("current_page"), F.lit(size).alias("page_size"), "total_items", "total_pages")


def _equal_to(w: str):
    return lambda x: x == w


def _counts(terms: list[str]):
    return lambda t: F.array(F.size(t), *(F.size(F.filter(t, _equal_to(w))) for w in terms))


def _scored(df: DataFrame, parts: list[tuple[float, Column, dict[str, float]]]) -> DataFrame:
    """``df`` with ``score``: for each part its weight times the BM25 of its terms (with weights of their own) in its array of tokens, summed.

    Term counts come from each row's array, which is computed once for all terms; only one row of totals (rows, mean length and
    rows with each term) is joined to all, so nothing is shuffled by term.
    """
    parts = [p for p in parts if p[2]]
    if not parts:
        return df.withColumn("score", F.lit(0.0))
    out, totals = df, [F.count("*").cast("double").alias("__all")]
    for i, (_, found, terms) in enumerate(parts):
        out = out.withColumn(f"__c{i}", X.let(found, _counts(list(terms))))
        totals.append(F.avg(F.col(f"__c{i}")[0]).alias(f"__avg{i}"))
        totals += [F.count_if(F.col(f"__c{i}")[j + 1] > 0).cast("double").alias(f"__df{i}_{j}") for j in range(len(terms))]
    out = out.crossJoin(F.broadcast(out.agg(*totals)))  # one row
    score = F.lit(0.0)
    for i, (weight, _, terms) in enumerate(parts):
        norm = K1 * (1 - B + B * F.col(f"__c{i}")[0] / F.col(f"__avg{i}"))
        for j, own in enumerate(terms.values()):
            tf, n = F.col(f"__c{i}")[j + 1], F.col(f"__df{i}_{j}")
            idf = F.log(1 + (F.col("__all") - n + 0.5) / (n + 0.5))
            score = score + F.when(tf > 0, weight * own * idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
    return out.withColumn("score", score).drop(*(c for c in out.columns if c.startswith("__")))


def _of(field: str, made) -> Column:
    """``made`` of a text, or of all values of a list in turn."""
    if field not in LISTS:
        return made(F.col(field))
    return F.flatten(F.transform(F.coalesce(F.col(field), F.array().cast("array<string>")), lambda v: made(v)))


def bm25(df: DataFrame, query: str, fields: dict[str, float], key: str = "id", index: TermIndex | None = None) -> DataFrame:
    """``df`` with ``score``: BM25 of the query's words, summed over the fields with their weights. With an ``index`` of ``df`` the
    counts come from there and no text is read."""
    words = {w: max(by.values()) for w, by in query_weights(query).items()}
    if index is None:
        return _scored(df, [(weight, _of(f, X.tokens), words) for f, weight in fields.items()])
    scores = index.scores([(weight, "word", f, words) for f, weight in fields.items()]).withColumnRenamed("id", key)
    return df.join(scores, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def by_relevance(df: DataFrame, query: str, fields: dict[str, float], page: int, size: int) -> DataFrame:
    """A page of the best scores first; the direction asked for plays no part."""
    return sorted_page(bm25(df, query, fields), "score", page, size)


def relevance(df: DataFrame, what: MessageFilter) -> DataFrame:
    """``df`` with ``score``: what a filter's text, subject and body ask for. Words weigh three in the fields that have a fuzzy
    search too, and the grams of its terms one; the body alone has words only. All rows of ``df`` count for how rare a term is."""
    made = {"word": X.tokens, "gram": X.windows}
    return _scored(df, [(weight, _of(f, made[kind]), terms) for weight, kind, f, terms in parts_of(what)])


def search(df: DataFrame, what: MessageFilter | AttachmentFilter, accounts=None, sort_by: str | None = None, descending: bool = True, page: int = 1, size: int = 20, index: TermIndex | None = None) -> DataFrame:
    """A page of the hits of a filter. Attachments have no internal date and sort by date for it. Relevance is that among all rows which
    the user may see, not among the hits. With an ``index`` of the messages, texts are neither searched nor scored."""
    key = resolve_sort(sort_by, isinstance(what, MessageFilter) and what.has_text())
    if index is not None and isinstance(what, MessageFilter):
        hits = index.hits(df, what, accounts)
        if key == "RELEVANCE":
            return sorted_page(hits.join(index.scores(parts_of(what), accounts), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "score", page, size)
        return sorted_page(hits, SORT_KEYS[key], page, size, descending)
    if key == "RELEVANCE":
        return sorted_page(relevance(df.where(within("account_id", accounts)), what).where(what.column(accounts)), "score", page, size)
    column = "date" if key == "INTERNAL_DATE" and isinstance(what, AttachmentFilter) else SORT_KEYS[key]
    return sorted_page(df.where(what.column(accounts)), column, page, size, descending)


def thread(df: DataFrame, account, thread_id) -> DataFrame:
    """The messages of a thread, the newest first."""
    return df.where((F.col("account_id") == account) & (F.col("thread_id") == thread_id)).orderBy(F.desc("date"), "id")


def key_page(df: DataFrame, key: Column, page: int | None = None, size: int | None = None, descending: bool = False) -> DataFrame:
    """A page in the order of keys as strings; everything if no page is asked for."""
    if (page is not None and page < 1) or (size is not None and size < 1):
        raise ValueError("pages and their sizes count from 1")
    out = df.orderBy(key.cast("string").desc() if descending else key.cast("string").asc())
    return out if page is None or size is None else out.offset((page - 1) * size).limit(size)


def account_list(df: DataFrame, admin: bool, descending: bool | None = None, page: int | None = None, size: int | None = None) -> DataFrame:
    """Accounts as an administrator sees them, by key and ascending unless asked otherwise, or as others do, by
    creation and descending unless asked otherwise. Equal times go by id; everything if no page is asked for."""
    down = (not admin) if descending is None else descending
    key = F.col("id").cast("string") if admin else F.col("created_at")
    out = df.orderBy(key.desc() if down else key.asc(), "id")
    if page is None or size is None:
        return out
    offset, limit = page_bounds(page, size)
    return out.offset(offset).limit(limit)
