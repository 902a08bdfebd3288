"""Terms stored at ingest: a table of words and grams by field, which searches and ranking read instead of texts.

A row is a term in a field of a message, with how often and where it occurs and how many terms that field has. Rows are dealt to folders by
the kind of term and a bucket of its first two characters, and sorted inside by field and term: a query reads the files of its own
terms alone. A term in a third of all messages is spread over many files, as rows are dealt by their ids too.
"""

from __future__ import annotations

import zlib
from collections.abc import Collection, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .filters import LISTS, MESSAGE_FIELDS, MESSAGE_FUZZY, MessageFilter, within

#: Folders of each kind, and files that the rows of one folder are dealt to by id at least.
BUCKETS, FILES = 32, 4
K1, B, WORD_BOOST = 1.2, 0.75, 3.0
#: Places left free between two values of a list, so that no phrase spans them.
GAP = 1


def bucket_of(term: str) -> int:
    return zlib.crc32(term[:2].encode()) % BUCKETS


def _list(field: str) -> Column:
    return F.coalesce(F.col(field), F.array().cast("array<string>"))


def _found(field: str, made) -> Column:
    """Arrays of terms: one for a text, one for each value of a list."""
    return F.transform(_list(field), lambda v: made(v)) if field in LISTS else F.array(made(F.col(field)))


def term_rows(df: DataFrame, fields: Collection[str] = MESSAGE_FIELDS, fuzzy: Collection[str] = MESSAGE_FUZZY, key: str = "id", account: str = "account_id") -> DataFrame:
    """``kind`` (word or gram), ``field``, ``term``, ``id``, ``account_id``, ``tf``, ``n`` (terms of the field) and ``positions`` (of words).

    Each field of a row also has a row with the empty term, so that empty fields count for mean lengths. Words are those of
    ``text.tokens``, grams those of ``text.windows``. Null fields are empty; an id is one message; an empty table gives an empty one.
    Rows are made in the task of their message: nothing is shuffled.
    """
    parts = [("word", f, _found(f, X.tokens)) for f in fields] + [("gram", f, _found(f, X.windows)) for f in fuzzy]
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("field"), made.alias("terms")) for kind, f, made in parts))
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(account).cast("long").alias("account_id"), F.inline(each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, account_id, kind, field, values in zip(*(batch.column(j).to_pylist() for j in range(5))):
                at: dict[str, list[int]] = {"": []}
                n = step = 0
                for terms in values:
                    for place, t in enumerate(terms, step):
                        at.setdefault(t, []).append(place)
                    n += len(terms)
                    step += len(terms) + GAP
                for t, places in at.items():
                    for column, v in zip(out, (kind, field, t, i, account_id, len(places), n, places if kind == "word" else None)):
                        column.append(v)
                if len(out[0]) > 100_000:
                    yield batch_of(out)
                    out = [[] for _ in range(8)]
            yield batch_of(out)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["kind", "field", "term", "id", "account_id", "tf", "n", "positions"])

    return rows.mapInArrow(run, "kind string, field string, term string, id string, account_id bigint, tf int, n int, positions array<int>")


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Adds ``term_rows`` to a stored table; with the mode ``overwrite`` of a whole rebuild, puts them in its place."""
    bucket = (F.crc32(F.substring("term", 1, 2).cast("binary")) % BUCKETS).cast("int")
    dealt = rows.withColumn("bucket", bucket).repartition("kind", "bucket", F.pmod(F.xxhash64("id"), F.lit(FILES)))
    dealt.sortWithinPartitions("kind", "bucket", "field", "term", "id").write.mode(mode).partitionBy("kind", "bucket").parquet(f"{path}/terms")
    lengths = rows.sparkSession.read.parquet(f"{path}/terms").where(F.col("bucket") == bucket_of("")).where("term = ''")
    lengths.groupBy("kind", "field", "account_id").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).write.mode("overwrite").parquet(f"{path}/lengths")


class TermIndex:
    """A stored table of terms. Ids are strings in it and come back as ``id`` of the type of ``key_type``."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint"):
        self.spark, self.path, self.key_type = spark, path, key_type

    def rows(self, kind: str, terms: Collection[str], fields: Collection[str], prefixes: Collection[str] = ()) -> DataFrame:
        """The rows of some terms, or of those that start with a prefix: filters on folders, and on what files tell of their terms."""
        short = any(len(p) < 2 for p in prefixes)
        buckets = sorted({bucket_of(t) for t in [*terms, *prefixes]})
        wanted = F.col("term").isin(*terms) if terms else F.lit(False)
        for p in prefixes:
            wanted = wanted | F.col("term").startswith(p)
        held = self.spark.read.parquet(f"{self.path}/terms").where(F.col("kind") == kind).where(F.col("field").isin(*fields))
        return (held if short else held.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))).where(wanted)

    def _ids(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("id").cast(self.key_type).alias("id"))

    def matches(self, query: str, fields: Collection[str]) -> DataFrame:
        """``id`` of the messages for which ``text.word_match`` holds over ``fields``; clauses may name one of these. Ranges need the messages
        themselves and aren't taken here."""
        parts = [p for p in X.clauses(query, fields) if not all(c.excluded for c in p)]
        every = list(dict.fromkeys(c for p in parts for c in p if not c.bounds))
        words = {c: X.query_tokens(c.text) for c in every}
        terms = {w for c, ws in words.items() for w in (ws[:-1] if c.prefix else ws)}
        prefixes = {ws[-1] for c, ws in words.items() if c.prefix and ws}
        if not terms | prefixes:
            return self._ids(self.rows("word", (), fields))
        need: dict[tuple[str, bool], int] = {}
        for c, ws in words.items():
            for i, w in enumerate(ws):
                need.setdefault((w, c.prefix and i == len(ws) - 1), len(need))
        at = [F.flatten(F.collect_list(F.when(F.col("term").startswith(w) if prefix else F.col("term") == w, F.col("positions")))).alias(f"p{i}") for (w, prefix), i in need.items()]
        here = self.rows("word", terms, fields, prefixes).groupBy("id", "field").agg(*at)  # at most the places of one text

        def hit(c: X.Clause) -> Column:
            own = [F.col(f"p{need[w, c.prefix and i == len(words[c]) - 1]}") for i, w in enumerate(words[c])]
            if not own:
                return F.lit(False)
            starts = own[0]
            for i, p in enumerate(own[1:], 1):
                starts = F.array_intersect(starts, F.transform(p, _back(i)))
            found = F.size(starts) > 0
            return found & (F.col("field") == c.field) if c.field else found

        by_field = here.select("id", *(hit(c).alias(f"c{i}") for i, c in enumerate(every)))
        held = by_field.groupBy("id").agg(*(F.bool_or(f"c{i}").alias(f"c{i}") for i in range(len(every))))
        out = F.lit(False)
        for p in parts:
            all_of = F.lit(True)
            for c in p:
                found = F.lit(False) if c.bounds else F.col(f"c{every.index(c)}")
                all_of = all_of & (~found if c.excluded else found)
            out = out | all_of
        return self._ids(held.where(out))

    def fuzzy(self, query: str, fields: Collection[str]) -> DataFrame:
        """``id`` of the messages for which ``text.fuzzy_match`` holds over ``fields``."""
        asked = X.fuzzy_terms(query)
        grams = list(dict.fromkeys(g for t in asked for g in X.query_grams(t)))
        here = self.rows("gram", grams, fields).groupBy("id", "field").agg(*(F.bool_or(F.col("term") == g).alias(f"g{i}") for i, g in enumerate(grams)))
        each = here.select("id", *(X.enough_grams(t, lambda g: F.col(f"g{grams.index(g)}")).alias(f"t{i}") for i, t in enumerate(asked)))
        held = each.groupBy("id").agg(*(F.bool_or(f"t{i}").alias(f"t{i}") for i in range(len(asked))))
        every = F.lit(bool(asked))
        for i in range(len(asked)):
            every = every & F.col(f"t{i}")
        return self._ids(held.where(every))

    def words_or_grams(self, query: str, fields: Collection[str], fuzzy: Collection[str] = ()) -> DataFrame:
        """``id`` of the messages that the query matches, or its fuzzy layer."""
        words = self.matches(query, fields)
        return words.union(self.fuzzy(query, fuzzy)).distinct() if fuzzy and X.fuzzy_terms(query) else words

    def hits(self, df: DataFrame, what: MessageFilter, accounts: Collection | None = None) -> DataFrame:
        """The rows of ``df`` that the filter takes, as its predicate does: what it asks of texts comes from the stored terms."""
        words = lambda q, f, z=(): self.words_or_grams(q, f, z)
        asked = [words(what.body, ["body"])] if what.body is not None else []
        if what.text is not None and not any(c.bounds for p in X.clauses(what.text, (*MESSAGE_FIELDS, "date", "internal_date", "ingest_at", "size")) for c in p):
            asked.append(words(what.text, MESSAGE_FIELDS, MESSAGE_FUZZY))
            what = replace(what, text=None)
        for name in ("subject", "sender", "to", "cc", "bcc"):
            if (value := getattr(what, name)) is not None:
                asked.append(words(value, [name], [name]))
        for value, names in ((what.any_recipient, ("to", "cc", "bcc")), (what.any_participant, ("sender", "to", "cc", "bcc"))):
            if value is not None:  # each field by itself, so an exclusion counts for one field at a time
                each = words(value, [names[0]], [names[0]])
                for name in names[1:]:
                    each = each.union(words(value, [name], [name]))
                asked.append(each)
        rest = replace(what, body=None, subject=None, sender=None, to=None, cc=None, bcc=None, any_recipient=None, any_participant=None)
        out = df.where(rest.column(accounts))
        for ids in asked:
            out = out.join(ids, "id", "left_semi")
        return out

    def scores(self, parts: list[tuple[float, str, str, dict[str, float]]], accounts: Collection | None = None) -> DataFrame:
        """``id`` and ``score``: BM25 of terms, summed over ``parts`` of weight, kind, field and the terms' own weights.

        How rare a term is and how long fields are on average count over all messages of ``accounts``. Those two tables have a row for each
        term and field asked for and are broadcast. Messages without any of the terms aren't returned.
        """
        parts = [p for p in parts if p[3]]
        weights = [(k, f, t, w * own) for w, k, f, terms in parts for t, own in terms.items()]
        summed: dict[tuple, float] = {}
        for k, f, t, w in weights:
            summed[k, f, t] = summed.get((k, f, t), 0.0) + w
        asked = self.spark.createDataFrame([(*x, w) for x, w in summed.items()], "kind string, field string, term string, weight double")
        found = None
        for kind in ("word", "gram"):
            of = [p for p in parts if p[1] == kind]
            if of:
                rows = self.rows(kind, sorted({t for p in of for t in p[3]}), sorted({p[2] for p in of})).where(within("account_id", accounts))
                rows = rows.select("kind", "field", "term", "id", "tf", "n").join(F.broadcast(asked), ["kind", "field", "term"])
                found = rows if found is None else found.union(rows)
        if found is None:
            return self.spark.createDataFrame([], f"id {self.key_type}, score double")
        size = self.spark.read.parquet(f"{self.path}/lengths").where(within("account_id", accounts)).groupBy("kind", "field").agg(F.sum("rows").cast("double").alias("all"), (F.sum("total") / F.sum("rows")).alias("mean"))
        rare = found.groupBy("kind", "field", "term").agg(F.count("*").cast("double").alias("df")).join(F.broadcast(size), ["kind", "field"])
        held = found.join(F.broadcast(rare), ["kind", "field", "term"])
        idf = F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
        return held.groupBy("id").agg(F.sum(part).alias("score")).select(F.col("id").cast(self.key_type).alias("id"), "score")


def _back(i: int):
    return lambda x: x - i


def query_weights(query: str, named: Collection[str] = ()) -> dict[str, dict[str | None, float]]:
    """For each word that a query doesn't exclude its weight by the field it is asked of (None: any); prefixes and ranges don't score."""
    out: dict[str, dict[str | None, float]] = {}
    for part in X.clauses(query, named):
        for c in part:
            if not c.excluded and not c.bounds and not c.prefix:
                for w in X.query_tokens(c.text):
                    out.setdefault(w, {})[c.field] = max(out.get(w, {}).get(c.field, 0.0), c.boost)
    return out


def parts_of(what: MessageFilter) -> list[tuple[float, str, str, dict[str, float]]]:
    """What a filter's text, subject and body score by: words weigh ``WORD_BOOST`` where there is a fuzzy search too, and grams one."""
    out = []
    for query, fields, fuzzy in ((what.text, MESSAGE_FIELDS, MESSAGE_FUZZY), (what.subject, ("subject",), ("subject",)), (what.body, ("body",), ())):
        if query and query.strip():
            words = query_weights(query, fields)
            for f in fields:
                own = {w: max(b for name, b in by.items() if name in (None, f)) for w, by in words.items() if by.keys() & {None, f}}
                out.append((WORD_BOOST if fuzzy else 1.0, "word", f, own))
            grams = dict.fromkeys((g for t in X.fuzzy_terms(query) for g in X.query_grams(t)), 1.0)
            out += [(1.0, "gram", f, grams) for f in fuzzy]
    return out
