"""Counts over whole texts, many texts at a time.

``TextBlock`` lays texts end to end, one line feed after each, and derives
words (``[^\\x20\\x09-\\x0D]+``), lines and their statistics with array
operations, so that Python handles no word by itself.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_B = np.arange(256)
UPPER = (_B >= 65) & (_B <= 90)
LOWER = (_B >= 97) & (_B <= 122)
DIGIT = (_B >= 48) & (_B <= 57)
BEGINS = (_B & 0xC0) != 0x80          # first byte of a code point
MARK = (_B > 32) & (_B < 127) & ~UPPER & ~LOWER & ~DIGIT


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encode_runs(data: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """Dictionary encoding of the byte runs that end at ``ends``."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return runs.dictionary_encode()


class TextBlock:
    """Words, lines and counts of a list of UTF-8 texts."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.doc_end = np.cumsum([len(t) + 1 for t in texts])
        self.doc_start = np.concatenate(([0], self.doc_end[:-1]))
        self.line_end = np.flatnonzero(self.data == 10) + 1
        self.line_start = np.concatenate(([0], self.line_end[:-1]))
        self.line_doc = np.searchsorted(self.doc_end, self.line_start, "right")

    def by_doc(self, kind: np.ndarray) -> np.ndarray:
        """Bytes of a kind (a table of 256) in each text."""
        return np.add.reduceat(kind[self.data].astype(np.int64), self.doc_start)

    def by_line(self, kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[self.data].astype(np.int64), self.line_start)

    @functools.cached_property
    def word_span(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word; every text ends in white space, so no word spans two."""
        blank = SPACE[self.data]
        edge = np.diff(blank.astype(np.int8), prepend=1)
        return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)

    @functools.cached_property
    def word_doc(self) -> np.ndarray:
        return np.searchsorted(self.doc_end, self.word_span[0], "right")

    @functools.cached_property
    def word_line(self) -> np.ndarray:
        return np.searchsorted(self.line_end, self.word_span[0], "right")

    def coded_words(self, fold: bool = False) -> pa.DictionaryArray:
        """The words as codes; ``fold`` lower-cases A-Z first."""
        data = self.data
        if fold:
            data = np.where(UPPER[data], data + 32, data).astype(np.uint8)
        start, end = self.word_span
        return encode_runs(data[~SPACE[data]], np.cumsum(end - start))

    @functools.cached_property
    def word_code(self) -> np.ndarray:
        return self.coded_words().indices.to_numpy().astype(np.int64)

    @functools.cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.word_doc, minlength=self.n)

    @functools.cached_property
    def word_chars(self) -> np.ndarray:
        return self.by_doc(BEGINS & ~SPACE)

    @functools.cached_property
    def line_code(self) -> np.ndarray:
        return encode_runs(self.data, self.line_end).indices.to_numpy().astype(np.int64)

    @functools.cached_property
    def line_words(self) -> np.ndarray:
        return np.bincount(self.word_line, minlength=len(self.line_end))

    @functools.cached_property
    def line_repeats(self) -> np.ndarray:
        """True for a line with a word that equals an earlier line of its text."""
        key = self.line_doc * (len(self.line_end) + 1) + self.line_code
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        return ~first & (self.line_words > 0)

    @functools.cached_property
    def n_dup_lines(self) -> np.ndarray:
        return np.bincount(self.line_doc, self.line_repeats, self.n).astype(np.int64)

    @functools.cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in 3-word windows that their text holds twice or more, the first included."""
        code, doc = self.word_code, self.word_doc
        marked = np.zeros(len(code), bool)
        if len(code) >= 3:
            whole = np.flatnonzero(doc[2:] == doc[:-2])
            key = mix(code + 1)[whole] + mix(code + (1 << 32))[whole + 1] + mix(code + (1 << 33))[whole + 2]
            key = mix(key ^ mix(doc[whole] + (1 << 34)))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(len(key), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            at = whole[again]
            marked[at] = marked[at + 1] = marked[at + 2] = True
        return np.bincount(doc, marked, self.n).astype(np.int64)
