"""Operators 6, 7 and 8 against the library's whole-text encoding."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from parcela.llm import bpe, packing, tokencount
from parcela.llm.common import to_batch
from parcela.llm.fragments import FragmentEncoder

PARTS = ["a", "e", "q", "Z", "'", "'s", "'re", "!", "#", " ", "  ", "\n", "\r\n", "\t", "1", "23", "é", "ß", " ",
         "　", "\x1c", "\x85", "…", "́", "Å", "ẖ", "H̱", "<|endoftext|>", "<|startoftext|>",
         "<|STARTOFTEXT|>", "<|", "中", "the", " of", "ll", "İ", "Σ", "≠", "\x00"]
DDL = "doc_id long, text string, ids string, extra int"


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def coder(request):
    return FragmentEncoder(request.param, keep=500)


def test_fragments_encode_as_the_library(coder):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for step in (6, 1 << 20):
        got = coder.encode_many([t.encode() for t in texts], step)
        for t, g in zip(texts, got):
            assert np.frombuffer(g, "<u4").tolist() == coder.library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("before", [1400, 1365 + 32, 1365 + 33, 2000, 5000])
def test_marks_far_past_a_step_stay_whole(coder, before):
    # Wide characters have no certain cut, so the first ones past the step lie inside the mark.
    text = ("中" * before + "<|endoftext|>") * 3 + "文 end" * 40
    for step in (100, 1000, 4200):
        got = coder.encode(text.encode(), step)
        assert np.frombuffer(got, "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids
        assert b"".join(coder.runs(text.encode(), step)) == text.encode()


def test_text_of_many_marks(coder):
    text = "".join(f"Doc {i % 7} it's\n<|endoftext|>" for i in range(5000)) + "<|endoftext|>" * 3 + "end"
    got = coder.encode_many([text.encode()])[0]
    assert np.frombuffer(got, "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_decode(coder):
    if coder.byte_level:
        for ids in ([50256, 128], [128, 262], list(range(300))):
            assert coder.decode(np.array(ids)).decode() == coder.library.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def docs(spark):
    long = "word and another " * 9000
    rows = [(1, "Hello there.\nGeneral\n\nKenobi", "x", 1), (2, None, None, None), (3, "", "y", 2), (None, "no id", "z", 3),
            (4, "same row", "s", 4), (4, "same row", "s", 4), (5, long, "l", 5), (6, " \n\n \t", "w", 6)]
    return spark.createDataFrame(rows, DDL)


def test_codec_rows(docs):
    lib = FragmentEncoder(bpe.VOCABULARY).library
    rows = bpe.encode_decode_digests(docs).collect()
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert sorted(r.text for r in bpe.decode(bpe.encode(docs)).collect()) == sorted(r.text or "" for r in docs.collect())


@pytest.mark.parametrize("rule", ["first", "most"])
def test_token_counts(docs, rule):
    lib = FragmentEncoder(tokencount.VOCABULARY).library
    got = {}
    for r in tokencount.count_tokens(docs, rule=rule).collect():
        got.setdefault((r.doc_id), {}).setdefault(r.section, []).append((r.start_byte, r.n_bytes, r.n_tokens))
    for r in docs.collect():
        text = r.text or ""
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        counts = [0] * len(lines)
        owner = [i for i, x in enumerate(lines) for _ in x.encode()]
        at = 0
        for t in lib.encode(text, add_special_tokens=False).tokens:
            mine = owner[at:at + len(t)]
            counts[mine[0] if rule == "first" else max(sorted(set(mine)), key=mine.count)] += 1
            at += len(t)
        sections = got[r.doc_id]
        assert [sections[i][0][2] for i in range(len(lines))] == counts
        assert [sections[i][0][1] for i in range(len(lines))] == [len(x.encode()) for x in lines]
        assert len(sections) == len(lines)


def check_packing(rows, tokens_of, window=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        at = 0
        for r in s:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    for d, ids in tokens_of.items():
        pieces = sorted(by_doc.pop(d), key=lambda r: r["start"])
        at = 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    return padding


def test_packer_pads_nothing():
    rng = random.Random(3)
    packer, docs_, rows = packing.Packer(5, flush_windows=8), {}, []
    for d in range(900):
        ids = [rng.randrange(40000) for _ in range(rng.choice([0, 3, 90, 300, 700, 1900, 2047, 2048, 5000]))] + [1]
        docs_[d] = ids
        packer.add(d, np.array(ids, "<u4").tobytes())
        if packer.held >= packer.flush_at:
            rows += packer.flush()
    rows += packer.flush(last=True)
    rows = [dict(zip(packing.SCHEMA.names, r)) for r in rows]
    assert check_packing(rows, docs_) == 0
    loads = {}
    for r in rows:
        loads[r["step_group"]] = loads.get(r["step_group"], 0) + r["length"]
    assert len(loads) > 10
    assert to_batch([], packing.SCHEMA).num_rows == 0


def test_packing_rows(docs):
    lib = FragmentEncoder(packing.VOCABULARY).library
    once = docs.dropDuplicates(["doc_id"])
    want = {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [1] for r in once.collect()}
    assert check_packing([r.asDict() for r in packing.pack(once).collect()], want) == 0
    assert packing.pack(docs).where("doc_id = 4 and start = 0").count() == 2
    empty = docs.limit(0)
    assert packing.pack(empty).count() == tokencount.count_tokens(empty).count() == bpe.encode(empty).count() == 0


@pytest.mark.parametrize("low,high", [(150, 150), (130, 255), (300, 500), (1100, 1999), (1, 3)])
def test_no_pool_starves(low, high):
    """Lengths of which no whole number fills a window: every flush packs nearly all, in linear time."""
    rng = random.Random(low)
    packer, docs_, rows, flushes = packing.Packer(1, flush_windows=8), {}, [], 0
    for i in range(20_000 if high < 1000 else 2_000):
        docs_[i] = [i % 1000] * rng.randint(low, high)
        packer.add(i, b"".join(x.to_bytes(4, "little") for x in docs_[i]))
        if packer.held >= packer.flush_at:
            rows += packer.flush()
            flushes += 1
            assert packer.held < sum(packing.TIERS)
    rows = [dict(zip(packing.SCHEMA.names, r)) for r in rows + packer.flush(last=True)]
    assert check_packing(rows, docs_) == 0
    assert flushes <= sum(map(len, docs_.values())) // (packer.flush_at - sum(packing.TIERS)) + 1
