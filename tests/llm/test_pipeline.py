"""The pipeline as a whole and stage by stage, on hand-made documents."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import shared

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("component_id", T.StringType()), T.StructField("score", T.StringType())])
ITEM = "seven quick foxes carried nine small lamps across the frozen river before anyone in the village woke up that morning"


def documents():
    """Clean ones of both kinds of words, copies, a near copy, a leak, nulls, empties; columns of clashing names."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, text(60), ["en", "de", None][i % 3], ["web", "books"][i % 2]) for i in range(40)]
    copy = rows[5][1]
    rows += [(40, copy, "en", "web"), (41, copy + " more", "en", "web"), (42, copy, None, None), (40, copy, "en", "web")]
    rows += [(50, text(30) + " " + ITEM + " " + text(30), "en", "web"), (51, ITEM, "en", "books")]
    rows += [(60, None, "en", "web"), (61, "", "de", "books"), (62, " \n ", None, "web"), (None, text(20), "en", "web"), (63, text(30_000), "en", "web")]
    return [(*r, len(r[1]) if r[1] else None, "x", "y") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    # toxic ones are named by a word that no clean document has
    labels = [(i, 1, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_and_run(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    docs = shared.table(spark, folder, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, folder), "test")
        assert docs.columns == SCHEMA.names, name
        kept.append([tuple(r) for r in docs.collect()])
    given = set(documents())
    for rows in kept:
        assert set(rows) <= given
    toxic, near, clean, mixed = kept
    assert len(toxic) == len(documents())  # no label says toxic, so nothing goes
    ids = [r[0] for r in near]
    assert {5, 40, 41, 42} & set(ids) == {5} and ids.count(5) == 1
    assert {60, 61, 62, None, 63} <= set(ids) and set(range(40)) <= set(ids)
    assert {r[0] for r in near} - {r[0] for r in clean} == {50, 51} and len(near) - len(clean) == 2
    assert set(mixed) == set(clean) and all(1 <= mixed.count(r) <= 2 for r in set(mixed))
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=lambda r: r[1])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for d, text in sorted(((r[0], r[1]) for r in mixed), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        own = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert got == want


def test_stages_on_no_rows(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        if name != "token-ID output":
            assert out.columns == SCHEMA.names


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Away:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Away)
