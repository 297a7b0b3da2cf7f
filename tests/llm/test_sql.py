"""The SQL of the text operators on planted rows, as the test tables hold few links or none."""

import duckdb
import numpy as np
import pytest

from mosaiq.llm import registry


def same(spark, path, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    found = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    got = registry.QUERIES[name](spark, path)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want))
    return got


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(150, 16))
    x[20:70] = x[20] + rng.normal(scale=0.12, size=(50, 16))
    x[100:106] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None, 1.0]), (204, []), (205, [float("inf")] * 16), (206, rows[20][1][:8])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = same(spark, str(tmp_path), "op7_embedding_neardup", "embeddings").collect()
    assert max(r.n_links for r in got) > 5 and len({r.component_id for r in got}) < 140


@pytest.mark.parametrize("seed", [3, 4])
def test_texts(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    base = [f"v{i}" for i in range(90)]
    texts = [" ".join(f"q{i}" for i in rng.integers(0, 5000, 40)) for _ in range(20)]
    for i in range(30):
        own = list(base)
        for p in rng.choice(90, rng.integers(0, 4), replace=False):
            own[p] = f"x{i}y{p}"
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), texts[1] + "\r\n", None, "", " \t", "one two", "One\x0btwo", "Ä b", "ä b", "a a a a a a a", "a a a a a a a a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = same(spark, str(tmp_path), "op10_bagminhash", "documents").collect()
    assert max(r.class_size for r in got) > 3
