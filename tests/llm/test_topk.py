"""Operator 2 against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest

from parcela.llm import topk


def brute(rows, k=5, step=50):
    use = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, tuple(math.floor(256 * x) for x in v)))
    found = {}
    for i, q in use:
        if i % step == 0:
            found.setdefault(i, []).extend((-max(-topk.LONG - 1, min(topk.LONG, sum(a * b for a, b in zip(q, p)))), j) for j, p in use if j != i and len(p) == len(q))
    return sorted((i, r, j, -x) for i, s in found.items() for r, (x, j) in enumerate(sorted(s)[:k], 1))


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, shard int")


@pytest.mark.parametrize("shard_rows", [30, 10_000])
def test_search(spark, shard_rows):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 0.3) for _ in range(6)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec()) for i in range(400)]
    rows += [(400 + i, [rng.choice([0.0, 0.01, -0.01])] * 6) for i in range(100)]
    rows += [(600, None), (650, [0.1, None, 0.2, 0.3, 0.1, 0.1]), (700, [float("nan")] * 6), (None, vec()), (750, [0.1, float("inf"), 0.0, 0.0, 0.0, 0.0]),
             (800, []), (801, []), (850, [0.5, 0.5]), (851, [0.25, -0.5]), (900, vec()), (950, vec()), (950, vec()), (950, hot), (950, hot)]
    got = topk.top_k(frame(spark, rows), shard_rows=shard_rows, sample_rows=200, block_rows=5)
    assert rows_of(got) == brute(rows)


def test_large_values_and_empty(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 8, 16]) for _ in range(3)]) for i in range(0, 120, 2)]
    assert rows_of(topk.top_k(frame(spark, rows))) == brute(rows)
    assert topk.top_k(frame(spark, rows).limit(0)).count() == 0
    assert topk.top_k(frame(spark, [(50, [0.1, 0.2])])).count() == 0


def test_tree_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    points = np.floor(256 * (rng.normal(size=(3000, 4)) + 6 * rng.integers(0, 4, (3000, 1))))
    tree = topk.KDTree(points, np.arange(3000), leaf=16)
    for q in np.floor(256 * rng.normal(size=(20, 4))):
        s = (points @ q).astype(int)
        want = sorted(zip((-s).tolist(), range(3000)))[:6]
        assert tree.search(q, 6) == [(-x, i) for x, i in want]
        assert tree.search(q, 6, bound=-want[2][0]) == [(-x, i) for x, i in want if -x >= -want[2][0]]
    for (a, z), low, high in zip(tree.span, tree.low, tree.high):
        assert (tree.points[a:z].min(0) == low).all() and (tree.points[a:z].max(0) == high).all()


def test_repeated_ids_agree_with_sql(spark, tmp_path):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 0.3) for _ in range(4)]
    rows = [(50, [0.5] * 4), (1, [0.1] * 4), (1, [0.9] * 4), (2, [0.2] * 4)]
    rows += [(rng.choice([0, 1, 2, 50, 50, 100, 7]), rng.choice([[0.5] * 4, vec()])) for _ in range(120)]
    df = frame(spark, rows)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(topk.OP2_SQL.replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert rows_of(topk.top_k(df, shard_rows=20, block_rows=3)) == sorted(want) == brute(rows)
