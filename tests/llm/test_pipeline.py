"""The pipeline's stages on a small corpus."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(900)]
    make = lambda n: " ".join(rng.choice(words, n)) + "."
    texts = [make(int(n)) for n in rng.integers(60, 200, 60)]
    junk = [" ".join(f"{w}***" for w in rng.choice(words, 80)) for _ in range(12)]
    rows = texts + junk + [texts[0], texts[0] + " word1", "short text", None]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(72)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "MinHash near-dedup", "mixing sources", "best-fit packing"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept[0] == [*range(60), 72, 73] == kept[1]
    assert len(kept[2]) == 60 and set(kept[2]) >= set(range(1, 60))
    assert set(kept[3]) <= set(kept[2])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sum(r.length for r in packed) == sum(len(r.ids) // 4 for r in packed) and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_empty(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_stages_return_columns_of_any_name(spark, corpus):
    """One column of each name that a stage uses itself."""
    path, _ = corpus
    names = ["skey", "position", "copy_no", "cut", "times", "target", "source_size", "size", "taken_times", "st", "__t", "__w", "__text", "__score", "score", "t", "rid", "key", "id",
             "bands", "shingles", "class", "first", "members", "c0", "c3", "n_words", "kept", "posterior", "base_failed", "task", "length", "ids", "piece", "h"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() >= docs.count()


def test_scratch_tables_go_when_the_next_stage_begins(spark, corpus, tmp_path):
    path, _ = corpus
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = stages[0](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    held = list(corpus_pipeline._left)
    assert stages[1](spark, docs, path).count() == docs.count()  # unwritten: the tables stay
    assert held and set(held) <= set(corpus_pipeline._left)
    docs.write.parquet(str(tmp_path / "out"))
    stages[1](spark, spark.read.parquet(str(tmp_path / "out")), path)
    assert not set(held) & set(corpus_pipeline._left) and not any(os.path.exists(p.removeprefix("file:")) for p in held)


@pytest.mark.parametrize(
    "hand_on",
    [lambda df: df.cache(), lambda df: df.sparkSession.createDataFrame(df.rdd, df.schema), lambda df: df.checkpoint(eager=False)],
    ids=["cached", "rdd", "checkpoint"],
)
def test_results_that_are_computed_late_keep_their_scratch_tables(spark, corpus, tmp_path, hand_on):
    path, _ = corpus
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    docs = hand_on(corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{path}/documents.parquet"), path))
    try:
        kept = corpus_pipeline.STAGES[1][1](spark, docs, path)
        assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 72, 73]
    finally:
        docs.unpersist()
