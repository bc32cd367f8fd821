"""Fragment-wise BPE encoding: cut where no token can reach across, encode each fragment once.

A byte pair that occurs inside no vocabulary token is a certain cut for the
merges: a merge across it would make a token that holds the pair.  Before
the merges, the vocabulary's own pattern splits a text into words; a pair is
used only where that split comes out the same on both sides, judged from the
classes of the two bytes (rules at ``_classes``).  The library encodes each
distinct fragment; a text's ids are the concatenation.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WS = b" \t\n\v\f\r"
#: The UTF-8 forms of white space outside ASCII.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def resolve(vocabulary: str) -> str:
    """A vocabulary file: a path, or a name in the installed tokenizer folder."""
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers
    return public_tokenizers.path(vocabulary)


def byte_of_symbol() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the rest follow from 256 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def never_inside(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 table: true where the byte pair occurs inside no token."""
    free = np.ones((256, 256), bool)
    for t in tokens:
        for a, b in zip(t, t[1:]):
            free[a, b] = False
    return free


def _classes() -> dict[str, np.ndarray]:
    b = np.arange(256)
    space = np.isin(b, list(WS))
    letter = ((b | 32) >= 97) & ((b | 32) <= 122) & (b < 128)
    digit = (b >= 48) & (b <= 57)
    return {"space": space, "letter": letter, "digit": digit, "wide": b >= 128,
            "sign": (b > 32) & (b < 127) & ~letter & ~digit, "quote": b == 39}


def byte_level_cuts(free: np.ndarray, wide_space: bool) -> np.ndarray:
    """Pairs that are certain cuts for a byte-level vocabulary.

    Kept from ``free``: anything before ASCII white space (a character beyond
    ASCII counts only in texts without wide spaces); letters, digits and signs
    against one another.  Not used: pairs after white space, pairs within a
    character, and pairs that would free or split an apostrophe's contraction.
    """
    c = _classes()
    left = ~c["space"] & ~c["wide"]
    ok = np.outer(left if wide_space else ~c["space"], c["space"])
    plain = c["letter"] | c["digit"] | c["sign"]
    ok |= np.outer(plain, plain)
    ok &= ~np.outer(c["quote"], c["letter"])          # 's stays whole
    ok &= ~np.outer(c["sign"], c["quote"])            # !'s does not become a contraction
    return ok & free


def word_cuts() -> np.ndarray:
    """Pairs that are certain cuts for a vocabulary with word ends that drops white
    space: word ends before ASCII white space, letters against digits and signs."""
    c = _classes()
    ok = np.outer(~c["space"], c["space"])
    rest = c["digit"] | c["sign"]
    ok |= np.outer(c["letter"], rest) | np.outer(rest & ~c["quote"], c["letter"])
    return ok


class FragmentEncoder:
    """Encodes UTF-8 texts as the library does, fragment by fragment.

    ``ids`` come as bytes of little-endian unsigned 32-bit integers.  Two
    generations of up to ``keep`` fragments each stay cached; a full younger
    one becomes the older one.
    """

    def __init__(self, vocabulary: str, keep: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        path = resolve(vocabulary)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.keep = keep
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        marks = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.marks = {m: struct.pack("<I", i) for m, i in marks.items()}
        self.mark_pattern = re.compile(b"|".join(re.escape(m) for m in marks)) if marks else None
        self.byte_level = spec.get("normalizer") is None
        if self.byte_level:
            symbols = byte_of_symbol()
            vocab = sorted(spec["model"]["vocab"].items(), key=lambda x: x[1])
            size = max([i for _, i in vocab] + list(marks.values())) + 1
            self.token_bytes: list[bytes] = [b""] * size
            for t, i in vocab:
                self.token_bytes[i] = bytes(symbols[ch] for ch in t)
            for m, i in marks.items():
                self.token_bytes[i] = m
            self.token_length = np.array([len(t) for t in self.token_bytes], np.int64)
            free = never_inside([self.token_bytes[i] for _, i in vocab])
            self.narrow = byte_level_cuts(free, False).ravel()
            self.wide = byte_level_cuts(free, True).ravel()
        else:
            self.narrow = self.wide = word_cuts().ravel()
            self.blank = _classes()["space"]
            self.space = self.blank.astype(np.int64)

    def split(self, data: bytes) -> list[bytes]:
        """The fragments of one text, in order."""
        out: list[bytes] = []
        at = 0
        for mark in self.mark_pattern.finditer(data) if self.mark_pattern is not None else ():
            out += self.split_plain(data[at:mark.start()])
            out.append(mark[0])
            at = mark.end()
        return out + self.split_plain(data[at:])

    def split_plain(self, data: bytes) -> list[bytes]:
        if not data:
            return []
        if not self.byte_level:
            data = self._folded(data)
        b = np.frombuffer(data, np.uint8)
        table = self.wide if not data.isascii() and WIDE_SPACE.search(data) else self.narrow
        at = np.flatnonzero(table[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
        ends = at.tolist()
        starts = [0, *ends]
        if not self.byte_level:  # a fragment's leading space has no ids
            starts[1:] = (at + self.space[b[at]]).tolist()
        return [data[i:j] for i, j in zip(starts, [*ends, len(data)])]

    def _folded(self, data: bytes) -> bytes:
        """ASCII capitals folded, as the vocabulary's normaliser does.  Left alone are texts
        with combining marks, which it composes first, and texts where folding makes a mark."""
        if b"\xcc" in data or b"\xcd" in data:
            return data
        low = data.lower()
        return data if self.mark_pattern is not None and self.mark_pattern.search(low) else low

    def learn(self, fragments: set[bytes]) -> dict[bytes, bytes]:
        """Cached ids of all these fragments; the library encodes those not seen yet."""
        if new := fragments.difference(self.cache):
            if len(self.cache) + len(new) > self.keep:
                self.older, self.cache = self.cache, {}
                new = fragments
            for f in new:
                if (ids := self.older.get(f) or self.marks.get(f)) is not None:
                    self.cache[f] = ids
            rest = list(new.difference(self.cache))
            for f, e in zip(rest, self.library.encode_batch_fast([f.decode() for f in rest], add_special_tokens=False)):
                ids = e.ids
                self.cache[f] = struct.pack(f"<{len(ids)}I", *ids)
        return self.cache

    def runs(self, data: bytes, step: int) -> Iterator[bytes]:
        """A text in runs of about ``step`` bytes that are encoded as the whole text is.

        Cuts and marks are both walked once, in order; a cut inside a mark is none.
        """
        marks = self.mark_pattern.finditer(data) if self.mark_pattern is not None else iter(())
        start = first = last = 0     # of the run, and of the first mark that ends past the cut
        while len(data) - start > step:
            end = len(data)
            for cut in self._cuts(data, start + step):
                while last <= cut:
                    mark = next(marks, None)
                    first, last = mark.span() if mark else (len(data), len(data))
                if first >= cut:
                    end = cut
                    break
            yield data[start:end]
            start = end
        yield data[start:]

    def encode(self, data: bytes, step: int = 1 << 20) -> bytes:
        """Ids of a whole text; a long text goes through in runs of fragments."""
        parts = []
        for run in self.runs(data, step):
            fragments = self.split(run)
            parts.append(b"".join(map(self.learn(set(fragments)).__getitem__, fragments)))
        return b"".join(parts)

    def encode_many(self, texts: list[bytes], step: int = 1 << 20) -> list[bytes]:
        """Ids of several texts.

        Plain texts are joined, cut in one pass and dictionary-encoded, so that only
        distinct fragments become Python objects.  Texts with marks, wide spaces,
        combining marks or more than ``step`` bytes take the way of ``encode``.
        """
        plain = [len(t) <= step and self._is_plain(t) for t in texts]
        done: list[bytes] = [b""] * len(texts)
        some = [i for i, p in enumerate(plain) if p and texts[i]]
        for i, ids in zip(some, self._encode_joined([texts[i] for i in some]) if some else []):
            done[i] = ids
        return [d if p else self.encode(t, step) for t, d, p in zip(texts, done, plain)]

    def _is_plain(self, data: bytes) -> bool:
        if self.mark_pattern is not None and self.mark_pattern.search(data if self.byte_level else data.lower()):
            return False
        if data.isascii():
            return True
        return not WIDE_SPACE.search(data) if self.byte_level else b"\xcc" not in data and b"\xcd" not in data

    def _encode_joined(self, texts: list[bytes]) -> list[bytes]:
        data = b"".join(texts)
        b = np.frombuffer(data if self.byte_level else data.lower(), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        cut = np.empty(len(b), bool)
        cut[:-1] = self.narrow[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        cut[ends - 1] = True
        if not self.byte_level:  # white space has no ids: drop it
            kept = ~self.blank[b]
            last = np.flatnonzero(cut)
            at = np.cumsum(kept)[last]
            b, n_of_text = b[kept], np.searchsorted(last, ends - 1) + 1
        else:
            at = np.flatnonzero(cut) + 1
            n_of_text = np.searchsorted(at, ends) + 1
        offsets = np.concatenate(([0], at)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.learn(set(distinct))
        ids = list(map(known.__getitem__, distinct))
        flat = np.frombuffer(b"".join(ids), "<u4")
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(length) - length
        which = coded.indices.to_numpy()
        n = length[which]
        upto = np.cumsum(n)
        out = flat[np.arange(upto[-1]) + np.repeat(start[which] - (upto - n), n)]
        bounds = [0, *(upto[n_of_text - 1] * 4).tolist()]
        raw = out.tobytes()
        return [raw[i:j] for i, j in zip(bounds, bounds[1:])]

    def _cuts(self, data: bytes, start: int) -> Iterator[int]:
        """The certain cuts of a whole text at or after ``start``, but for its marks."""
        for at in range(start, len(data), 1 << 12):
            b = np.frombuffer(data[at - 1:at + (1 << 12)], np.uint8)
            # An ASCII cut is certain whatever wide spaces the text has.
            ok = np.flatnonzero(self.wide[(b[:-1].astype(np.uint16) << 8) | b[1:]])
            yield from (ok + at).tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; broken characters become U+FFFD, as in the library."""
        data = b"".join(map(self.token_bytes.__getitem__, ids.tolist()))
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> FragmentEncoder:
    """One encoder a worker process and vocabulary."""
    return FragmentEncoder(vocabulary)
