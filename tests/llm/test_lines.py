"""Operators 1, 9 and 10 against plain Python over whole small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from parcela.llm import crf, line_dedup, line_rules, qda
from parcela.llm.textstats import TextBlock

WS = " \t\n\v\f\r"
DDL = "doc_id long, text string, keep int, version string"
A = "This Line is found in a good many of the documents here"
B = "ünd diese Zeile mit vierzig Zeichen und etwas mehr kömmt öfter vor"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "v") for d, t in rows], DDL)


def edge_rows():
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice([A, "  " + A.upper() + "\t", B, "short", "", f"own line number {i} with a lot of further words"])
                          for _ in range(rng.randint(1, 6)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (None, A), (102, A + "\n" + A), (102, A + "\n" + A), (102, "x\n" + B), (103, "\n\n" + B),
                   (104, ("word " * 30 + "\n") * 4000), (105, "x" * 39 + "\n" + "é" * 40)]


def plain_dedup(rows, min_docs=5):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s).strip(WS)
    holders = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 40:
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_line_dedup(spark, partitions):
    rows = edge_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = line_dedup.dedup_digests(frame(spark, rows)).collect()
        assert sorted(str(tuple(r)) for r in got) == plain_dedup(rows)
        texts = line_dedup.dedup_lines(frame(spark, rows), carry=("keep",)).collect()
        assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in texts) == sorted(eval(x)[3] for x in plain_dedup(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_line_dedup_hot_line_over_partitions():
    """A line that spans partitions is settled by their reports."""
    rows = sorted((1, 1, d, 0, 1, 0) for d in range(50)) + [(2, 2, d, 0, 1, 0) for d in range(4)]
    parts = [rows[:3], rows[3:30], rows[30:]]
    found = [r for p in parts for r in line_dedup.stream(sorted(p, key=lambda r: (r[0], r[1], -r[2])), 5)]
    totals = collections.defaultdict(lambda: [0, -1])
    for r in found:
        if r[0] == line_dedup.REPORT:
            totals[r[1:3]][0] += r[7]
            totals[r[1:3]][1] = max(totals[r[1:3]][1], r[3])
    gone = [(r[1], r[3]) for r in found if r[0] == line_dedup.DROP]
    gone += [(r[1], r[3]) for r in found if r[0] == line_dedup.OPEN and totals[r[1:3]][0] >= 5 and r[3] < totals[r[1:3]][1]]
    assert sorted(gone) == [(1, d) for d in range(49)]


def test_line_dedup_empty_and_bitmap(spark):
    assert line_dedup.dedup_digests(frame(spark, [(1, "a")]).limit(0)).count() == 0
    keep = zlib.compress(np.packbits([1, 0, 1]).tobytes())
    assert line_dedup.apply_bitmap(b"a\nb\nc", keep) == (3, 1, b"a\nc")
    assert line_dedup.apply_bitmap(b"", None) == (1, 0, b"")


def plain_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
        seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_rules(spark):
    rng = random.Random(2)
    rows = edge_rows() + [(200 + i, "".join(rng.choice(["a", "b ", "c\n", "\t", "# ", " ", "é", "\x1c", "a b c "]) for _ in range(rng.randint(0, 300))))
                          for i in range(150)]
    model = crf.LinearChain.empty(line_rules.N_FEATURES)
    got = line_rules.judge(frame(spark, rows), model).collect()
    mine = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
    assert mine == sorted(str((d, *plain_base(t))) for d, t in rows)
    assert all(r.kept == (not r.base_failed) for r in got)  # no labels: every line is content
    kept = line_rules.keep_good(frame(spark, rows), model)
    assert kept.columns == ["doc_id", "text", "keep", "version"] and kept.count() == sum(r.kept for r in got)


def test_viterbi_and_training():
    rng = np.random.default_rng(1)
    model = crf.LinearChain(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in (0, 1, 2, 6):
        e = rng.normal(size=(n, 2))
        best = max(([(i >> j) & 1 for j in range(n)] for i in range(2 ** n)), key=lambda p: sum(e[t, y] for t, y in enumerate(p))
                   + (model.begin[p[0]] if p else 0) + sum(model.moves[a, b] for a, b in zip(p, p[1:])))
        assert model.decode(e) == best
    seqs = []
    for _ in range(60):
        y = np.repeat(rng.integers(0, 2, 3), 10)
        x = np.where(rng.random(30) < 0.85, y, 1 - y)
        seqs.append((x[:, None], y))
    fitted = crf.train(seqs, 2)
    right = np.mean([np.mean(np.array(fitted.decode(fitted.weights[x].sum(1))) == y) for x, y in seqs])
    assert right > 0.93 and crf.train([], 3).weights.shape == (3, 2)


def test_models_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in qda.score(docs, qda.learn(docs, labels)).collect()}
    known = [(rows[r.doc_id], r.quality) for r in labels.collect()]
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.predicted, q) for r, q in known if r.held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95
    # Labels of held-out rows are no input.
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    assert {r.doc_id: r.score for r in qda.score(docs, qda.learn(docs, turned)).collect()} == {d: r.score for d, r in rows.items()}
    verdict = {r.doc_id: r for r in line_rules.judge(docs, line_rules.learn(docs, labels)).collect()}
    judged = [(verdict[r.doc_id], r.quality) for r in labels.collect()]
    assert np.mean([v.kept == bool(q) for v, q in judged if not v.base_failed]) > 0.97


def test_models_without_labels(spark):
    docs = frame(spark, edge_rows())
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r.score for r in qda.score(docs, qda.learn(docs, none)).collect()} == {1.0}
    one = spark.createDataFrame([(1, 0), (3, 0), (3, 0), (4, 1), (4, 0)], "doc_id long, quality int")
    assert {r.score for r in qda.score(docs, qda.learn(docs, one)).collect()} == {0.0}
    assert qda.keep_good(docs, qda.learn(docs, none)).count() == docs.count()
    assert line_rules.learn(docs, none).weights.any() == False  # noqa: E712
    assert qda.score(docs.limit(0), qda.learn(docs.limit(0), none)).count() == 0


def test_block_of_empty_texts():
    block = TextBlock([b"", b" ", b"\n"])
    assert block.n_words.tolist() == [0, 0, 0] and block.n_dup_lines.tolist() == [0, 0, 0]
    assert qda.statistics(block).shape == (3, len(qda.FEATURES)) and np.isfinite(qda.statistics(block)).all()
