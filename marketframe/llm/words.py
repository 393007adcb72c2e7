"""Words, hashes and shingles of whole texts, computed on the bytes of Arrow columns.

A text column arrives as one byte buffer with offsets. Words are found and hashed with a few passes over
that buffer, so no Python object exists per word. Texts are cut into chunks of ``CHUNK_BYTES`` only to
bound memory: a chunk holds whole texts, however long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93 | 1)


class Rule(NamedTuple):
    """is_word and image say for each byte whether it belongs to a word, and what it counts as."""

    is_word: np.ndarray
    image: np.ndarray


def _rule(is_word, lower: bool) -> Rule:
    image = np.arange(256, dtype=np.uint8)
    if lower:
        image[65:91] += 32
    return Rule(np.array([is_word(b) for b in range(256)]), image)


#: words ``[^\x20\x09-\x0D]+`` as they are, and with A-Z lower-cased
SPACED = _rule(lambda b: not (b == 32 or 9 <= b <= 13), lower=False)
SPACED_LOWER = _rule(lambda b: not (b == 32 or 9 <= b <= 13), lower=True)
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased
ALNUM_LOWER = _rule(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90, lower=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, made once for a worker and longer on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int):
        if n > len(self.up):
            n = max(n, CHUNK_BYTES + 1)
            for name, b in (("up", int(_BASE)), ("down", _inverse(int(_BASE)))):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


_POWERS = _Powers()


class Words(NamedTuple):
    """Words of a list of texts: those of text ``d`` are ``first[d]:first[d + 1]``; start and end are byte places."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(self.texts), self.counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words_of(texts: pa.Array, rule: Rule) -> Words:
    """Split texts into words and hash each word to 64 bits."""
    raw, off = buffers(texts)
    n = len(raw)
    inside = rule.is_word[raw]
    fresh = np.zeros(n + 1, bool)  # a text starts here
    fresh[off] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    data = rule.image[raw]
    up, down = _POWERS.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    value = mix64((sums[end] - sums[start]) * down[start])
    return Words(data, start, end, np.searchsorted(start, off), value, off)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds about ``limit`` bytes of text; a longer text is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and for each text where its runs begin.

    A text with fewer words, but not none, has one run: all its words. The result keeps repeats.
    """
    h, n = w.hash, len(w.hash)
    counts = w.counts
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(runs, out=first[1:])
    value = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        value = value * _STEP + h[j : j + len(value)]
    place = np.repeat(w.first[:-1] - first[:-1], runs) + np.arange(first[-1])
    short = np.flatnonzero((counts > 0) & (counts < k))
    out = np.zeros(first[-1], np.uint64)
    whole = place < len(value)
    out[whole] = value[place[whole]]
    for d in short:
        v = np.uint64(counts[d])
        for x in h[w.first[d] : w.first[d + 1]]:
            v = np.uint64((int(v) * int(_STEP) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[first[d]] = v
    return mix64(out), first


def distinct_sets(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, laid end to end, with offsets."""
    parts = [np.unique(value[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), off


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_of(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))
