"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import budget_mix, embedding_lsh, line_dedup, media_shards, passage_chains, periodic_runs, piece_tokens, quality_qda, simhash_tree, source_audit, toxicity_fm, url_markov, warc_zstd
from .shared import held_out, table


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_fm.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    scored = toxicity_fm.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_media_tar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = media_shards.store(table(spark, sf_dir, "documents"))
    back = media_shards.read_back(media_shards.headers(index))
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op3_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = budget_mix.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_tree.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def piece_model() -> bytes:
    """The bytes of the public 32,000-piece model."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op7_sentencepiece_prefix_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_tokens.encode_decode(table(spark, sf_dir, "documents"), piece_model())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_warc_zstandard(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zstd.write(table(spark, sf_dir, "pages"))
    return warc_zstd.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage of a document that an earlier one (``match_doc_id``) holds."""
    found = passage_chains.repeated_passages(table(spark, sf_dir, "documents"))
    p = found.select("doc_id", F.explode("passages").alias("p"))
    return p.select("doc_id", F.col("p.ref_id").alias("match_doc_id"), F.col("p.start").alias("start_word"), F.col("p.end").alias("end_word"), (F.col("p.end") - F.col("p.start")).alias("n_words"))


def op10_embedding_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_lsh.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"top_run.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * top_run.length div top_run.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: What SQL can express. Fitted models, stored pictures, SentencePiece, SimHash and the knapsack are tested against brute force.
SQL = {
    "op8_warc_zstandard": """with p as (select page_id, coalesce(html, '') as html from pages), d as (select page_id, strlen(html) as n, sha256(html) as digest from p),
  f as (select digest, min(page_id) as first_id from d where n >= 100 group by digest)
  select d.page_id, n as payload_bytes, d.digest as payload_digest, case when d.page_id <> first_id then 'revisit' else 'response' end as record_type,
    case when d.page_id <> first_id then first_id end as refers_to from d left join f on f.digest = d.digest""",
    "op10_embedding_cross_polytope": """with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
  p as (select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
  r as (select vec_id as id, vec_id as c from v union select p.b, r.c from r join p on p.a = r.id), c as (select id, min(c) as component_id from r group by id),
  n as (select a, count(*) as n_links from p group by a)
  select v.vec_id, coalesce(n_links, 0) as n_links, component_id, v.vec_id = component_id as kept from v join c on c.id = v.vec_id left join n on n.a = v.vec_id""",
    "op11_source_audit": f"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as text, row_number() over () as doc from documents),
  o as (select lang, source, doc, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
  kept as (select lang, term, count(*) as n from o group by all having count(distinct doc) >= 10),
  g as (select distinct lang, source from d), c as (select lang, source, term, count(*) as n from o semi join kept using (lang, term) group by all),
  lang_size as (select lang, sum(n) as total, count(*) as terms from kept group by lang), group_size as (select lang, source, sum(n) as total from c group by all),
  p as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.terms)::hugeint as p,
      1 + (1000000000::hugeint * (kept.n + 2)) // (l.total + 2 * l.terms)::hugeint as q
    from g join kept using (lang) join lang_size l using (lang) left join group_size s using (lang, source) left join c using (lang, source, term)),
  v as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q
    union all select a.lang, a.source, 'pair', b.source, coalesce(f.value, 0) from g a join g b on a.lang = b.lang and a.source <> b.source
      left join (select x.lang, x.source, y.source as other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
      on f.lang = a.lang and f.source = a.source and f.other = b.source),
  r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from v)
  select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from r where part = 'pair' or rank <= 10""",
    "op13_line_dedup": f"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents), l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
  k as (select *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') as key from l),
  s as (select key, min(doc_id) as first_id from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
  m as (select doc_id, i, line, coalesce(doc_id > first_id, false) as gone from k left join s on s.key = k.key)
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
