"""Operator 5 against brute force, and its parts one by one."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from parcela.llm import jaccard
from parcela.llm.components import components


def grams(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows, n, num, den):
    sets = [(d, grams(t, n)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if d is not None and e is not None and a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d) if d is not None else None
    return sorted(str((d, len(s), least[find(i)])) for i, (d, s) in enumerate(sets))


def near_copies(rng, base, count, edits):
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(words))
            words[k] = rng.choice(["new", "other", "word"]) + str(rng.randrange(10 ** 6))
        out.append(" ".join(words))
    return out


def corpus():
    rng = random.Random(8)
    text = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    passage = " ".join(text(60))
    texts = near_copies(rng, text(140), 70, 9) + near_copies(rng, text(60), 30, 4) + near_copies(rng, text(25), 20, 2)
    texts += [" ".join(text(rng.choice([5, 12, 40, 200]))) for _ in range(80)]
    texts += [passage + " " + " ".join(text(30)) for _ in range(25)] + [" ".join(text(90))] * 6
    texts += ["one two", "One  TWO", "one", "a b c", "a b c d", "x" * 5, "\x1c y z", None, "", " \n\t", "ÀB c d", "àb c d", " ".join(text(3000))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, rows[0][1]), (None, None), (900, texts[0]), (900, texts[0]), (901, texts[0]), (901, texts[80])]


@pytest.mark.parametrize("n,num,den,task", [(3, 90, 100, 2_000_000), (5, 80, 100, 2_000_000), (3, 90, 100, 1500), (2, 60, 100, 3000)])
def test_join(spark, n, num, den, task):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "v", 1) for d, t in rows], "doc_id long, text string, version string, region int")
    got = jaccard.join_components(docs, n, num, den, task).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, n, num, den)


def test_repeated_rows_send_one_set(spark):
    docs = spark.createDataFrame([(1, "a b c d")] * 40 + [(1, "a b c e"), (2, "a b c d"), (None, "a b c d")], "doc_id long, text string").repartition(3)
    rows = jaccard.classes(docs, 3).where("doc_id = 1").distinct()
    members = rows.selectExpr("doc_id", "version", "class", "7L AS region", "4L AS total")
    sent = jaccard._member_sets(docs, members, 3).collect()
    assert len(sent) == 2 and {bytes(r["class"]) for r in sent} == {bytes(r["class"]) for r in rows.collect()}


@pytest.mark.parametrize("n,num,den,task", [(3, 90, 100, 2_000_000), (2, 60, 100, 3000)])
def test_every_link(spark, n, num, den, task):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, pairs = jaccard.join_links(docs, n, num, den, task)
    sets = [(d, frozenset(grams(t, n))) for d, t in rows]
    near = lambda a, b: bool(a and b) and den * len(a & b) >= num * len(a | b)
    want = [(d, len(s), sum(j != i and near(s, o) for j, (e, o) in enumerate(sets) if e is not None) if d is not None else 0)
            for i, (d, s) in enumerate(sets)]
    assert sorted(str((r.doc_id, r.n_shingles, r.n_links)) for r in got.collect()) == sorted(map(str, want))
    distinct = list({s for d, s in sets if d is not None})
    linked = pairs.collect()
    assert len(linked) == len(set(linked)) == sum(near(a, b) for i, a in enumerate(distinct) for b in distinct[:i])
    assert all(r.a < r.b for r in linked)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in jaccard.join_components(docs, 3, 90, 100).collect()] == [(0, 1)]
    assert jaccard.join_components(docs.limit(0), 3, 90, 100).count() == 0


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100)])
def test_linked_sets_meet_in_a_cell(num, den):
    rng = np.random.default_rng(2)
    starts, parts, spares = jaccard.rings(num, den)
    for size in [1, 2, 5, 9, 10, 11, 19, 20, 57, 150, 400]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64))
            fewest = -(-num * len(a) // den)
            kept = int(rng.integers(fewest, len(a) + 1))          # b: part of a, and some more, still linked
            extra = max(0, (kept * den - num * len(a)) // num)
            b = np.unique(np.concatenate([rng.permutation(a)[:kept], rng.integers(0, 2 ** 63, int(rng.integers(0, extra + 1)), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            assert den * shared >= num * (len(a) + len(b) - shared)
            h, ends = np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(a) + len(b)])
            cell, owner = jaccard.cell_keys(h, ends, num, den)
            assert np.array_equal(np.sort(a), np.sort(b)) or set(cell[owner == 0]) & set(cell[owner == 1])


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100)])
def test_linked_sets_share_a_rare_gram(num, den):
    rng = np.random.default_rng(5)
    for size in [1, 2, 5, 10, 11, 57, 200]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64))
            fewest = -(-num * len(a) // den)
            kept = int(rng.integers(fewest, len(a) + 1))
            extra = max(0, (kept * den - num * len(a)) // num)
            b = np.unique(np.concatenate([rng.permutation(a)[:kept], rng.integers(0, 2 ** 63, int(rng.integers(0, extra + 1)), dtype=np.uint64)]))
            counts = rng.integers(0, 5, 16)
            cell, owner = jaccard.prefix_cells(np.concatenate([a, b]), np.array([len(a), len(a) + len(b)]), np.array([7, 7]), counts, num, den)
            assert set(cell[owner == 0]) & set(cell[owner == 1])
            assert (owner == 0).sum() == len(a) - -(-num * len(a) // den) + 1


def test_region_join_recurses():
    rng = random.Random(1)
    texts = [t for k in range(12) for t in near_copies(rng, [f"g{k}w{rng.randrange(90)}" for _ in range(80)], 15, 5)]
    sets = [np.unique(np.array([hash(g) & (2 ** 62 - 1) for g in grams(t, 3)], np.uint64)) for t in texts]
    region = jaccard.Region(sets, 90, 100, small=20)
    calls = []
    compare = region._compare
    region._compare = lambda w: (calls.append(len(w)), compare(w))
    region.join()
    assert max(calls) < len(sets) / 2
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                assert region.find(i) == region.find(j)
    for a, b in region.links:
        shared = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    frame = spark.createDataFrame([*edges, (5, 5), (None, 3), (7, None)], "a long, b long")
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
    for _ in range(500):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.label for r in components(frame).collect()} == {a: b for a, b in parent.items() if a not in alone}
    assert components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 100])
def test_keys_in_several_rows(size):
    """Counts are exact however the rows are cut into batches; the keys at both ends say so."""
    keys = [1, 1, 2, 3, 3, 3, 4, 5, 5, 6]
    rows = pa.table({"key": keys, "node": range(10), "need": [1] * 10}, schema=jaccard.HELD)
    out = pa.Table.from_batches(jaccard.shared_keys(iter(rows.to_batches(max_chunksize=size))), schema=jaccard.SHARED).to_pylist()
    assert [(r["key"], r["node"], r["n"]) for r in out] == [
        (1, 0, jaccard.MANY), (1, 1, jaccard.MANY), (3, 3, 3), (3, 4, 3), (3, 5, 3), (5, 7, 2), (5, 8, 2), (6, 9, jaccard.MANY)]


def test_a_shared_passage_makes_no_block_pairs(spark, monkeypatch):
    """Sets that share a passage and little else are parted by exact counts, where hashed counts cannot tell."""
    rng = np.random.default_rng(3)
    draw = lambda k: rng.integers(0, 2 ** 63, k, dtype=np.uint64)
    passage = draw(60)
    sets = [np.unique(np.concatenate([passage, draw(40)])) for _ in range(60)]
    sets += [np.unique(np.append(s[:-4], draw(2))) for s in sets[:5]]
    rows = [(7, sum(map(len, sets)), b"%08d" % k, s.tobytes()) for k, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "region long, total long, class binary, grams binary").repartition(3)
    rare = jaccard._rare_cells
    monkeypatch.setattr(jaccard, "_rare_cells", lambda *a: rare(*a, buckets=1))
    monkeypatch.setattr(jaccard, "_block_pairs", lambda *a: pytest.fail("pairs of blocks"))
    links = jaccard.region_links(frame, 80, 100, task_grams=400).collect()
    assert sorted((min(int(r.a), int(r.b)), max(int(r.a), int(r.b))) for r in links) == [(k, 60 + k) for k in range(5)]


def test_sketches_part_no_linked_sets(monkeypatch):
    """Linked sets always may link, also where sketches differ in length or are cut short; unrelated ones may not."""
    rng = np.random.default_rng(4)
    draw = lambda k: rng.integers(0, 2 ** 63, k, dtype=np.uint64)
    for most in (512, 4):
        monkeypatch.setattr(jaccard, "SKETCH_WORDS", (4, most))
        for num, den in [(90, 100), (80, 100), (50, 100)]:
            sets, linked = [], []
            for size in [1, 2, 9, 30, 57, 200, 380, 390, 760, 1500]:
                for _ in range(15):
                    a = draw(size)
                    kept = int(rng.integers(-(-num * size // den), size + 1))
                    b = np.append(a[:kept], draw(int(rng.integers(0, max(0, (kept * den - num * size) // num) + 1))))
                    linked.append((len(sets), len(sets) + 1))
                    sets += [np.sort(a), np.sort(b)]
            ends = np.cumsum([len(x) for x in sets])
            sketch = pa.chunked_array([pa.array([*jaccard.sketches(np.concatenate(sets), ends), None], pa.binary())])
            i, j = np.array(linked).T
            assert jaccard.may_link(sketch, i, j, num, den).all()
            assert jaccard.may_link(sketch, i, np.full(len(i), len(sets)), num, den).all()     # no sketch: any
            if most == 512 and num >= 80:
                large = i[np.diff(ends, prepend=0)[i] >= 30]
                assert jaccard.may_link(sketch, large[:-2], large[2:], num, den).mean() < 0.02


@pytest.mark.parametrize("size", [1, 7, 1000])
@pytest.mark.parametrize("most", [3, 1024])
def test_sketched_stars(size, most):
    """Whatever the batches, nodes of a meeting are tied if their sketches allow it, and all of a meeting
    that is large or at an end of the partition, which is also tied to a node of its own."""
    rng = np.random.default_rng(6)
    draw = lambda k: np.sort(rng.integers(0, 2 ** 63, k, dtype=np.uint64))
    a, b, c = draw(100), draw(100), draw(100)
    sets = [a, b, np.append(a[:-2], draw(1)), c, np.append(b[:-2], draw(1)), np.append(a[:-2], draw(1))]
    sketch = jaccard.sketches(np.concatenate(sets), np.cumsum([len(x) for x in sets]))
    rows = [(m, 10 * m + k, sketch[k]) for m, which in [(1, [0, 1]), (2, [0, 1, 2, 3, 4, 5]), (3, [0, 1]), (4, [1, 3, 4]), (5, [3]), (6, [1, 3])] for k in which]
    frame = pa.table(list(zip(*rows)) and [pa.array(x) for x in zip(*rows)], names=["meeting", "node", "sketch"])
    out = pa.Table.from_batches(jaccard.sketched_stars(90, 100, most)(iter(frame.to_batches(max_chunksize=size))), schema=jaccard.PAIR).to_pylist()
    end = [int(jaccard.mix(np.array([m])).view(np.int64)[0]) for m in (1, 6)]
    inside = [(22, 20), (24, 21), (25, 20)] if most > 3 else [(20 + k, 20) for k in range(1, 6)]
    want = [(11, 10), (end[0], 10), *inside, (44, 41), (63, 61), (end[1], 61)]
    assert sorted((r["a"], r["b"]) for r in out) == sorted(want)


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_meetings(size):
    """Cells with the same nodes make one meeting; cells with one node make none, but at the ends."""
    rows = [(1, 5), (2, 5), (2, 5), (3, 5), (3, 6), (4, 5), (4, 6), (4, 6), (5, 5), (5, 6), (5, 7), (6, 8)]
    frame = pa.table([pa.array(x, pa.int64()) for x in zip(*rows)], names=["cell", "node"])
    out = pa.Table.from_batches(jaccard.meetings(iter(frame.to_batches(max_chunksize=size))), schema=jaccard.MEETING).to_pylist()
    by_name = {}
    for r in out:
        by_name.setdefault(r["meeting"], []).append(r["node"])
    assert sorted(by_name.values()) == [[5], [5, 6, 5, 6], [5, 6, 7], [8]]


def test_few_common_grams_make_no_region(spark):
    """Texts that share a few phrases, each alone in many a part, are not sent on; linked ones are, and are found."""
    rng = random.Random(9)
    phrases = [[f"p{k}x{i}" for i in range(3)] for k in range(30)]

    def text():
        blocks = [[f"w{rng.randrange(10 ** 9)}" for _ in range(4)] for _ in range(20)]
        return sum((x for b in blocks for x in (b, rng.choice(phrases))), [])

    texts = [text() for _ in range(150)]
    texts += [[*t[:-1], "other"] for t in texts[:4]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.join_components(docs, 3, 80, 100).where("component_id < doc_id").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(150 + k, k) for k in range(4)]
    assert jaccard._rows_and_sets(docs, 3, 80, 100)[2].count() <= 40     # a few meet where a partition ends
