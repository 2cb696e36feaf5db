import numpy as np
import pytest

from lamina.llm import topk
from pyspark.sql import functions as F


def brute(rows, k):
    ids, v = [i for i, _ in rows], np.floor(64 * np.array([x for _, x in rows], float)).astype(int)
    out = []
    for n, i in enumerate(ids):
        if i % 20 == 0:
            found = sorted((-int(v[n] @ v[m]), ids[m]) for m in range(len(ids)) if ids[m] != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "hot", "clustered", "few"])
def test_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BUCKET", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "SHARD_BYTES", 2000)
    monkeypatch.setattr(topk, "TASK_BLOCKS", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8 if kind == "few" else 400, 6)) * rng.lognormal(0, 1.2, size=(8 if kind == "few" else 400, 1))
    if kind == "hot":
        x[::3] = x[0]
    if kind == "clustered":
        x = np.repeat(rng.normal(size=(8, 6)), 50, 0) + rng.normal(size=(400, 6)) * 0.01
    rows = [(int(i), [float(c) for c in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1020, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1040, [float("nan")] * 6), (None, [1.0] * 6), (1060, [float("inf")] + [0.0] * 5)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, score int")
    got = topk.top_products(topk.quantised(table), F.col("id") % 20 == 0, 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 20)


def test_pruning_loses_nothing():
    rng = np.random.default_rng(8)
    for _ in range(300):
        c = np.floor(rng.normal(size=(60, 3)) * 64)
        c = c[np.argsort(-np.linalg.norm(c, axis=1), kind="stable")]
        q = np.floor(rng.normal(size=3) * 64)
        norms = np.linalg.norm(c, axis=1)
        least = float(np.sort(c @ q)[-rng.integers(1, 20)])
        assert set(np.flatnonzero(c @ q >= least)) <= set(topk.candidates(q, np.linalg.norm(q), least, c, norms))


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_products(topk.quantised(table), F.col("id") % 20 == 0).count() == 0


def test_dimensions_repeats_and_sql(spark, tmp_path):
    """Vectors of several dimensions, empty ones and repeated ids; the SQL agrees where ids are distinct."""
    import duckdb

    from lamina.llm.queries import OP5_SQL, op5_topk

    rows = [(i, [float(i % 7) / 3 - 1 + j for j in range(i % 4)], "x") for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, op5_topk(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.execute(OP5_SQL).fetchall()) and {q for q, *_ in got} == {0, 20, 40, 60, 80, 100, 120}
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.5, 1.0]), (7, [1.0, 1.0]), (7, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_products(topk.quantised(twice), F.col("id") % 20 == 0).collect()))
    assert got == [(20, 1, 7, 96 * 64), (20, 2, 7, 64 * 64)]


def test_one_hot_dimension_fills_many_tasks(spark, monkeypatch):
    """All vectors have one dimension and like lengths, so every query reaches every shard: no task gets more than a shard and some blocks."""
    monkeypatch.setattr(topk, "BUCKET", 20)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "SHARD_BYTES", 1000)
    monkeypatch.setattr(topk, "TASK_BLOCKS", 2)
    seen = {}
    search = topk._search

    def watched(rows, k):
        seen["tasks"] = rows.groupBy("shard", "part").agg(F.sum(F.when(F.col("least").isNull(), 1)).alias("buckets"), F.count("least").alias("blocks")).collect()
        return search(rows, k)

    monkeypatch.setattr(topk, "_search", watched)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.top_products(topk.quantised(table), F.col("id") % 20 == 0, 20).collect()
    assert len(got) == 30 * 20 and len(seen["tasks"]) > 15
    assert max(r.blocks for r in seen["tasks"]) < 6 and max(r.buckets for r in seen["tasks"]) <= 3
