"""Operator 13 against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from parcela.llm import resample

SF = "/root/testdata/sf0.001"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text, n):
    w = words_of(text)
    return [" ".join(w[i:i + k]) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def plain(docs, target, n=1, buckets=10_000, percent=10, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, x in docs for f in features_of(x, n))
    t = Counter(bucket(f) for x in target for f in features_of(x, n))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, x in docs:
        g = [gain(bucket(f)) for f in features_of(x, n)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    can = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(can[:percent * len(can) // 100], 1):
        r[4] = k
    return sorted(map(repr, (r[:5] for r in rows)))


def shown(frame):
    return sorted(repr(list(r)) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert shown(resample.op13_importance_resample(spark, SF)) == plain(docs, target)


ODD = ["", None, "  \n\t", "Ünï Ä 東京 a1-B2 _x", "word " * 30, "a b c d e f g h i j k l m n o p q r s t u v", "X" * 5000, "\x00\x7f`{|}~@[", "0:9;A"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_edges_ties_and_orders(spark, n):
    rng = random.Random(n)
    docs = list(enumerate(ODD)) + [(7, "word " * 30), (None, "word " * 30), (None, "word " * 30)]
    docs += [(100 + i, " ".join(rng.choice("red green blue dark light".split()) for _ in range(25))) for i in range(60)] * 2
    frame = spark.createDataFrame([(i, x, 1, 2) for i, x in docs], "doc_id long, text string, score int, rank int")
    target = spark.createDataFrame([("dark Blue blue",), (None,)], "text string")
    got = resample.draw(resample.learn(frame, target, n, 97).weigh(frame), percent=35, min_words=6)
    assert shown(got) == plain(docs, ["dark Blue blue", None], n, 97, 35, 6)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = docs.limit(0)
    assert resample.draw(resample.learn(none, none).weigh(none)).count() == 0
    assert shown(resample.draw(resample.learn(docs, none).weigh(docs))) == plain([(1, "a b")], [])


@pytest.mark.parametrize("n", [1, 2, 4])
def test_pieces_do_not_matter(n):
    data = ("The  quick, brown-fox; éé jumps " * 200).encode()
    add = lambda parts: (sum(w for w, _ in parts), sum((c for _, c in parts), Counter()))
    whole = add(list(resample.feature_counts(data, n)))
    assert whole == add(list(resample.feature_counts(data, n, piece=50)))
    assert whole[1] == Counter(zlib.crc32(f.encode()) for f in features_of(data.decode(), n))
