"""Operator 11 against plain Python: Stirling numbers by recursion, dictionaries for restaurants."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcela.llm import pitman_yor as py

SF = "/root/testdata/sf0.001"


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield rest[:i] + [[items[0], *rest[i]]] + rest[i + 1:]


def seatings(c):
    """Summed seating weights by number of tables, from every way to seat c customers."""
    out = defaultdict(float)
    for p in partitions(list(range(c))):
        out[len(p)] += math.prod(math.prod(k - py.DISCOUNT for k in range(1, len(t))) for t in p)
    return out


STIRLING = {1: np.array([0.0, 1.0])}


def stirling(c):
    """Generalised Stirling numbers of c customers by number of tables, over (c - 1)!."""
    for n in range(max(STIRLING), c):
        s = np.append(STIRLING[n], 0.0)
        STIRLING[n + 1] = (np.append(0.0, s[:-1]) + (n - py.DISCOUNT * np.arange(n + 2)) * s) / n
    return STIRLING[c]


def weights(c, others, p, strength):
    tables = np.concatenate([[0.0], np.cumsum(np.log((strength + py.DISCOUNT * (others + np.arange(1, c))) * p))])
    with np.errstate(divide="ignore"):
        logs = np.log(stirling(c)[1:]) + tables
    w = np.exp(logs - logs.max())
    return w / w.sum()


def plain_draw(c, others, p, strength, u):
    upto = np.cumsum(weights(c, others, p, strength))
    return 1 + min(int(np.searchsorted(upto, u * upto[-1], side="right")), c - 1)


def test_closed_form_is_the_sum_over_seatings():
    for c in range(1, 8):
        want = seatings(c)
        for t in range(1, c + 1):
            assert math.isclose(stirling(c)[t] * math.factorial(c - 1), want[t])
        for t in range(1, c):
            assert math.isclose(py._odds(float(t), float(c), 3.0, 0.2, 2.0), want[t + 1] / want[t] * (2 + 0.5 * (3 + t)) * 0.2)


@pytest.mark.parametrize("c,others,p,strength", [(2, 0, 0.5, 1.0), (6, 10, 0.01, 2.0), (40, 3, 0.9, 0.5), (60, 5000, 0.02, 2.0), (90, 100, 1.0, 2.0), (120, 10 ** 6, 0.9, 2.0)])
def test_draws_follow_the_conditional(c, others, p, strength):
    u = (np.arange(4000) + 0.5) / 4000
    t = py.draw_tables(np.full(4000, c), np.full(4000, others), np.full(4000, p), strength, u)
    share = np.bincount(t, minlength=c + 1)[1:] / 4000
    assert np.abs(share - weights(c, others, p, strength)).max() < 1e-3
    assert (np.diff(t) >= 0).all() and t.min() >= 1 and t.max() <= c


def test_a_hot_pair_is_one_cheap_draw():
    t = py.draw_tables(np.array([10 ** 12, 10 ** 12, 3]), np.array([10 ** 6, 0, 0]), np.array([0.01, 0.5, 0.1]), 2.0, np.array([0.5, 0.5, 0.5]))
    assert 5_000 < t[0] < 20_000 and 1 <= t[1] <= 10 ** 7 and 1 <= t[2] <= 3


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [py.END]


def plain(rows, strength=2.0, root=2.0, burn=1, samples=2):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [tokens_of(x) for i, x in rows if i is not None and not held(i)]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    number = {w: k for k, w in enumerate(sorted(count, key=lambda w: w.encode()), 1)}
    pair = Counter((u, w) for t in train for u, w in zip([None, *t], t))
    base = 1 / (v + 1)
    customers = Counter()
    for (u, _), c in pair.items():
        customers[u] += c
    draw = lambda c, o, p, s, a, b, k: plain_draw(c, o, p, s, py.uniforms(np.array([a]), np.array([b]), k)[0])
    tables = {x: 1 for x in pair}
    root_tables = {w: 1 for w in count}

    def seat_root(sweep):
        c1, all1 = Counter(), sum(root_tables.values())
        for (_, w), t in tables.items():
            c1[w] += t
        for w in list(root_tables):
            root_tables[w] = (w, all1 - root_tables[w])
        for w, (_, o) in list(root_tables.items()):
            root_tables[w] = draw(c1[w], o, base, root, -1, number[w], sweep)
        t1, c = sum(root_tables.values()), sum(c1.values())
        unknown = (root + t1 / 2) * base / (root + c)
        return {w: (c1[w] - root_tables[w] / 2) / (root + c) + unknown for w in c1}, unknown
    parent, unknown = seat_root(0)
    states = []
    for sweep in range(1, burn + samples + 1):
        total = Counter()
        for (u, _), t in tables.items():
            total[u] += t
        tables = {(u, w): draw(c, total[u] - tables[u, w], parent[w], strength, number.get(u, 0), number[w], sweep) for (u, w), c in pair.items()}
        parent, unknown = seat_root(sweep)
        if sweep > burn:
            total = Counter()
            for (u, _), t in tables.items():
                total[u] += t
            states.append((dict(tables), total, parent, unknown))

    def prob(u, w):
        return sum(((pair.get((u, w), 0) - t.get((u, w), 0) / 2) + (strength + total[u] / 2) * p.get(w, x)) / (strength + customers[u]) for t, total, p, x in states) / samples
    out = []
    for i, text in rows:
        t = tokens_of(text)
        out.append((i, held(i), len(t), sum(w in count for w in t), n, sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in t),
                    sum(math.log10(prob(u, w)) for u, w in zip([None, *t], t))))
    return out, prob, count


def same(frame, want):
    got = sorted((tuple(r) for r in frame.collect()), key=repr)
    want = sorted(want, key=repr)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-12)


def corpus():
    rng = random.Random(5)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(80)] + ["Ünï", "東京", "a" * 300]
    rows = []
    for i in range(150):
        w = [rng.choice(vocab)]
        for _ in range(rng.randrange(40)):
            w.append(vocab[(hash(w[-1][:2] == "w1") + rng.randrange(12)) % len(vocab)] if rng.random() < 0.8 else f"rare{rng.randrange(400)}")
        rows.append((i, "  \n".join(w) if i % 7 else " ".join(w).upper()))
    rows += [(200, None), (201, ""), (202, " \t\r\n\x0b\x0c"), (203, "the " * 90), (203, "the " * 90), (None, "w1 w2 nowhere else"), (None, None), (204, "x y\x1cz")]
    return rows


@pytest.mark.parametrize("block_bytes,bucket_pairs", [(24 << 20, 10 ** 6), (400, 60)])
def test_against_plain(spark, block_bytes, bucket_pairs):
    rows = corpus()
    frame = spark.createDataFrame([(i, x, 0.5, "k") for i, x in rows], "doc_id long, text string, score double, word string").repartition(3)
    want, prob, count = plain(rows)
    same(py.score(py.learn(frame, block_bytes=block_bytes, bucket_pairs=bucket_pairs)), want)
    for u in (None, "the", "w1", "never met"):
        assert math.isclose(sum(prob(u, w) for w in [*count, "never met"]), 1, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(i, "some words here") for i in held] + [(None, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = py.score(py.learn(frame)).collect()
    assert len(got) == 4 and all(r.n_known == r.train_tokens == 0 and r.base_score == r.score == 0 for r in got)
    assert py.score(py.learn(frame.limit(0))).count() == 0


def test_query_tells_likely_texts(spark):
    out = py.op11_pitman_yor(spark, SF).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert out[1] > 0.95 * out[0]               # log-probabilities are negative: pairs tell more than single words


def test_packed_numbers():
    for a in (np.array([], np.int64), np.array([0, -1, 1 << 62]), np.arange(5000) ** 3):
        assert (py.unpack(py.pack(a)) == a).all()
    x = np.array([0.5, -2.25, 1e300])
    assert (py.unpack(py.pack(x), np.float64) == x).all()


@pytest.mark.parametrize("texts", [["a b", None, "", " x\ty  Z\n", "\x1c q\x0b", "É Ünï"] * 3, ["A b C", "d e F", "G h", "i  J k", "l"] * 4])
def test_words_of_slices(texts):
    whole = pa.array(texts, pa.string())
    for a in range(0, 12, 5):
        words, n = py.split_words(whole.slice(a, 5))
        want = [tokens_of(x)[:-1] for x in texts[a:a + 5]]
        assert words.to_pylist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    assert py.split_words(pa.array([], pa.string()))[1].tolist() == []
