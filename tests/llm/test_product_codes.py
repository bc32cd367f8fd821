"""Operator 12 against plain Python and its SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from parcela.llm import product_codes as pq


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Every part against every entry, in Python integers."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(max(-pq.LIMIT, min(pq.LIMIT, scale * x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    size, more = divmod(len(kept[0][1]), parts)
    cuts = [k * size + min(k, more) for k in range(parts + 1)]
    cutup = [[q[a:b] for a, b in zip(cuts, cuts[1:])] for _, q, _ in kept]
    books = [[list(x[k]) for x in cutup[:entries]] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            mine = {}
            for x in cutup:
                mine.setdefault(near(x[k], books[k])[1], []).append(x[k])
            for j, xs in mine.items():
                books[k][j] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    found = [[near(x[k], books[k]) for k in range(parts)] for x in cutup]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    return sorted((repr((i, "".join(f"{j:02x}" for _, j in f), e, total[label], sha)) for (i, _, label), f, e in zip(kept, found, errors)))


def shown(frame):
    return sorted(repr(tuple(r)) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 0) for i, v, label in rows], "vec_id long, embedding array<double>, label int, error int")


@pytest.mark.parametrize("size,entries,cell", [(8, 256, 256), (8, 16, 32), (7, 5, 4096), (2, 9, 64)])
def test_edges_against_plain(spark, size, entries, cell):
    rng = random.Random(size)
    vec = lambda: [rng.gauss(0, 0.3) for _ in range(size)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec(), i % 4 or None) for i in range(150)]
    rows += [(i, [rng.choice([0.0, 0.5, -0.5])] * size, 9) for i in range(150, 200)]
    rows += [(300, None, 1), (301, [None] * size, 1), (302, [float("nan")] * size, 1), (303, [float("-inf")] * size, 2), (304, [0.5], 2), (305, [], 2),
             (None, vec(), 2), (7, vec(), 7), (7, vec(), 7), (7, hot, 7), (306, [1e300] * size, 3), (307, [-1e9] * size, 3)]
    assert shown(pq.compress(frame(spark, rows).repartition(3), entries=entries, cell=cell)) == plain(rows, entries=entries)


def test_few_and_none(spark):
    one = [(5, [0.25, -0.25, 1.0, 0.001], None)]
    assert shown(pq.compress(frame(spark, one))) == plain(one)
    assert pq.compress(frame(spark, one).limit(0)).count() == 0
    assert pq.compress(frame(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(ValueError):
        pq.train(pq.scaled(frame(spark, one)), entries=257)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({pq.OP12_SQL})").fetchall()
    assert shown(pq.op12_product_codes(spark, sf)) == sorted(map(repr, want))


@pytest.mark.parametrize("cell", [16, 200, 5000])
def test_cells_keep_every_nearest_entry(cell):
    rng = np.random.default_rng(cell)
    entries = rng.integers(-600, 600, (40, 5))
    x = np.concatenate([rng.integers(-700, 700, (800, 5)), entries, (entries[:20] + entries[20:]) // 2])
    d = ((x[:, None] - entries) ** 2).sum(2)
    grid = pq.GridCodebook(entries, cell, max_cells=50)          # small enough to be emptied on the way
    for rows in np.array_split(np.arange(len(x)), 7):
        index, best = grid.nearest(x[rows])
        assert (index == d[rows].argmin(1)).all() and (best == d[rows].min(1)).all()
    grid = pq.GridCodebook(entries, 16)
    grid.nearest(x)
    assert grid.evaluated < 0.6 * d.size                         # small boxes leave few candidates
