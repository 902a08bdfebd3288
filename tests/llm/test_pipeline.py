"""The pipeline over the smallest tables: what each stage keeps."""

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names, kept = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, DIR)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names, name
        out.write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
    assert kept.count() > 0 and kept.where("n_tokens < 2").count() == 0
    again = corpus_pipeline.run(spark, DIR)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, kept.collect()))


def planted(prose_of):
    """Documents with toxic ones, near copies and a shared passage, and labels that tell the toxic ones by two words."""
    rows, labels, r = [], [], __import__("random").Random(5)
    for i in range(240):
        text = prose_of(120, 1000 + i)
        toxic = i % 6 == 0
        if toxic:
            text += " scumword idiotword " * 3
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    for i in (7, 31, 55):  # a word of 120 replaced: most shingles are shared
        words = rows[i][1].split()
        words[r.randrange(120)] = "replaced"
        rows.append((300 + i, " ".join(words), "en", "s0", len(rows[i][1])))
    passage = prose_of(80, 77)
    for i in (11, 17, 23):
        rows[i] = (i, rows[i][1] + " " + passage + " " + prose_of(30, 500 + i), "en", f"s{i % 3}", 1)
    return rows, labels


def test_run_on_planted_documents(spark, tmp_path, prose_of):
    """Toxic documents and near copies go, shared passages stay in their first document, the mix is that of whole words by source,
    and tokens are those of the library: each stage by plain Python over what the one before left."""
    import sentencepiece

    from courierlake.llm import queries

    rows, labels = planted(prose_of)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert ids and not any(i < 240 and i % 6 == 0 for i in ids) and not ids & {307, 331, 355}
    left = {i: t.split() for i, t, *_ in rows if i < 240 and i % 6}
    for i in (17, 23):  # 11 keeps the passage
        left[i] = left[i][:120] + left[i][200:]
    sizes = {s: sum(len(w) for i, w in left.items() if i % 3 == s) for s in range(3)}
    weights, total = {0: 3, 1: 1, 2: 2}, 1.5 * sum(sizes.values())
    target, free, rest = {}, set(sizes), total
    while free:
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in full} if full else share
        free, rest = (free - full, rest - sum(2 * sizes[s] for s in full)) if full else (set(), 0)
    times = __import__("collections").Counter(r.doc_id for r in got)
    assert set(times) <= set(left) and max(times.values()) <= 2
    for s in sizes:
        taken = sum(len(left[i]) * n for i, n in times.items() if i % 3 == s)
        assert abs(taken - target[s]) <= 125, (s, taken, target[s])
    sp = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        if r.doc_id not in (17, 23):
            want = sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
            assert r.n_tokens == len(want) and bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in want)


def test_run_on_empty_tables(spark, tmp_path, no_docs):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == 0
