"""What is refused: token models that the prefix table can't encode, and clusters without a shared folder."""

import random
from types import SimpleNamespace

import pytest

from courierlake.llm import components, embedding_lsh, piece_tokens, queries, shared

model_pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")


def changed(**normaliser):
    m = model_pb2.ModelProto()
    m.ParseFromString(queries.piece_model())
    for name, value in normaliser.items():
        setattr(m.normalizer_spec, name, value)
    return m


def test_other_models_are_refused():
    piece_tokens.PieceEncoder(changed().SerializeToString())
    with pytest.raises(ValueError, match="only"):
        piece_tokens.PieceEncoder(changed(add_dummy_prefix=False).SerializeToString())
    with pytest.raises(ValueError, match="only"):
        piece_tokens.PieceEncoder(changed(remove_extra_whitespaces=True).SerializeToString())
    unigram = changed()
    unigram.trainer_spec.model_type = model_pb2.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError, match="only"):
        piece_tokens.PieceEncoder(unigram.SerializeToString())


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key: None)
    sc = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(SimpleNamespace(sparkContext=sc))


def test_long_and_odd_payloads(spark):
    """Pages above the piece that the reader takes at once, repeated short ones, and archives that turn over."""
    from courierlake.llm import warc_zstd

    rows = [(i, f"http://x/{i}", "<p>" + f"long {i} " * 20_000) for i in range(3)] + [(10 + i, None, "<b>short</b>") for i in range(20)] + [(40, "u", "y" * 100), (41, "u", "y" * 100), (42, "u", None), (42, "u", "")]
    got = {}
    for r in warc_zstd.read(warc_zstd.write(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect():
        got[r.page_id] = (r.payload_bytes, r.record_type, r.refers_to)
    assert [got[i][0] for i in range(3)] == [len(rows[i][2]) for i in range(3)]
    assert all(got[10 + i] == (12, "response", None) for i in range(20)) and got[40] == (100, "response", None) and got[41] == (100, "revisit", 40) and got[42] == (0, "response", None)


def test_exploded_tables_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Spark sizes buckets by the vectors before they are exploded, so no join of the operator may depend on that size."""
    plans = []
    for module in (embedding_lsh, components):
        def settled(df, keep=module.settled):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return keep(df)

        monkeypatch.setattr(module, "settled", settled)
    r = random.Random(3)
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [x + r.gauss(0, 0.01) for x in base[i % 40]]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/e")
    found = embedding_lsh.near_duplicates(spark.read.parquet(f"{tmp_path}/e"))
    assert sorted((x.vec_id, x.component_id) for x in found.collect()) == [(i, i % 40) for i in range(200)]
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p for p in plans)
