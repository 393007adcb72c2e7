"""Benchmark passages inside documents, found with an FM-index per shard of the documents.

A shard is the part of a task's texts whose words can matter: runs of words in which every pair of
neighbours also stands in some benchmark window (a window of one word matters alone). Nothing outside such
runs can belong to an occurrence, so the index stays small and nothing is lost. All distinct windows are
searched backward in the shard at once, their occurrences located through the kept suffix places, and
covered words merged into spans.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .scan import scan_texts
from .words import ALNUM_LOWER, chunks, words_of

#: A benchmark above this size is to be given in parts: every executor holds its windows.
BENCHMARK_BYTES = 64_000_000
SHARD_WORDS = 300_000

FOUND = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<long>"


class Phrases(NamedTuple):
    """Distinct windows of the items: symbols of each, and the items that hold it."""

    words: np.ndarray  # sorted hashes of benchmark words; symbol = place + 2 (0 ends, 1 parts runs)
    pairs: np.ndarray  # sorted symbol pairs that stand next to each other in a window
    single: np.ndarray  # by symbol: is a window alone
    flat: np.ndarray
    first: np.ndarray
    size: np.ndarray
    item_first: np.ndarray
    item: np.ndarray  # ids of the items of each window
    least: int


def phrases_of(ids: list, texts: list, window: int) -> Phrases:
    w = words_of(pa.array(texts, pa.string()), ALNUM_LOWER)
    vocabulary, symbol = np.unique(w.hash, return_inverse=True)
    symbol = symbol.astype(np.int64) + 2
    found: dict[bytes, set] = {}
    for d in range(w.texts):
        a, b = w.first[d], w.first[d + 1]
        if a == b or ids[d] is None:
            continue
        size = min(window, b - a)
        for i in range(a, b - size + 1):
            found.setdefault(symbol[i : i + size].tobytes(), set()).add(ids[d])
    windows = [np.frombuffer(k, np.int64) for k in found]
    size = np.array([len(x) for x in windows], np.int64)
    first = np.cumsum(size) - size
    flat = np.concatenate(windows) if windows else np.zeros(0, np.int64)
    n = len(vocabulary) + 2
    inner = np.ones(len(flat), bool)
    inner[(first + size - 1)[size > 0]] = False
    at = np.flatnonzero(inner)
    single = np.zeros(n, bool)
    single[flat[first[size == 1]]] = True
    members = [sorted(x) for x in found.values()]
    item_first = np.concatenate([[0], np.cumsum([len(x) for x in members])]).astype(np.int64)
    item = np.array([i for x in members for i in x], np.int64)
    return Phrases(vocabulary, np.unique(flat[at] * n + flat[at + 1]), single, flat, first, size, item_first, item, int(size.min()) if len(size) else 1)


def _in_sorted(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return (table[at] == x if len(table) else np.zeros(len(x), bool)), at


def _relevant(w, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and places of the words that can be hit, and whether each follows on the one before it."""
    n = len(p.words) + 2
    known, at = _in_sorted(p.words, w.hash)
    symbol = np.where(known, at + 2, 0)
    where = np.flatnonzero(known[:-1] & known[1:]) if len(known) else np.zeros(0, np.int64)
    border = np.zeros(len(w.hash) + 1, bool)
    border[w.first] = True
    where = where[~border[where + 1]]
    paired, _ = _in_sorted(p.pairs, symbol[where] * n + symbol[where + 1])
    joined = np.zeros(len(w.hash) + 1, bool)  # a word and the one before it stand together
    joined[where[paired] + 1] = True
    keep = np.flatnonzero(joined[:-1] | joined[1:] | p.single[symbol])
    follows = joined[keep]
    run = np.cumsum(~follows) - 1
    long_enough = np.bincount(run, minlength=1)[run] >= p.least if len(run) else np.zeros(0, bool)
    return symbol[keep][long_enough], keep[long_enough], follows[long_enough]


def _search(parts: list, p: Phrases):
    """For each buffered part: hit words of the shard (text, word place), and (text, item) pairs found."""
    symbol = np.concatenate([x[1] for x in parts])
    place = np.concatenate([x[2] for x in parts])
    follows = np.concatenate([x[3] for x in parts])
    owner = np.concatenate([x[4] for x in parts])
    none = np.zeros(0, np.int64)
    if not len(symbol) or not len(p.size):
        return none, none, none, none
    shift = np.cumsum(~follows)
    at = np.arange(len(symbol)) + shift  # a sign that parts runs stands before each run
    seq = np.ones(at[-1] + 1, np.int64)
    seq[at] = symbol
    index = FMIndex(seq, len(p.words) + 2)
    lo, hi = index.search(p.flat, p.first, p.size)
    count = hi - lo
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    begin = index.locate(rows)
    cover = np.zeros(len(seq) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + p.size[phrase], -1)
    hit = np.cumsum(cover)[at] > 0
    back = np.full(len(seq), -1, np.int64)
    back[at] = np.arange(len(at))
    text = owner[back[begin]]
    pair = np.unique(np.stack([text, phrase], 1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
    many = np.diff(p.item_first)[pair[:, 1]]
    item = p.item[np.repeat(p.item_first[pair[:, 1]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    both = np.unique(np.stack([np.repeat(pair[:, 0], many), item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    return owner[hit], place[hit], both[:, 0], both[:, 1]


def _answer(parts: list, p: Phrases):
    text, place, with_item, item = _search(parts, p)
    at = 0
    for part, _, _, _, _, n_words in parts:
        n = part.num_rows
        a, b = np.searchsorted(text, [at, at + n])
        t, x = text[a:b] - at, place[a:b]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1] + 1)
        begin = np.flatnonzero(fresh)
        stop = np.concatenate([begin[1:], [len(t)]]) - 1 if len(begin) else begin
        span_first = np.searchsorted(t[begin], np.arange(n + 1))
        spans = pa.StructArray.from_arrays([pa.array(x[begin], pa.int32()), pa.array(x[stop] + 1, pa.int32())], ["start", "end"])
        c, d = np.searchsorted(with_item, [at, at + n])
        item_first = np.searchsorted(with_item[c:d] - at, np.arange(n + 1))
        yield (
            part,
            {
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array(np.bincount(t, minlength=n), pa.int64()),
                "spans": pa.ListArray.from_arrays(pa.array(span_first, pa.int32()), spans),
                "items": pa.ListArray.from_arrays(pa.array(item_first, pa.int32()), pa.array(item[c:d], pa.int64())),
            },
        )
        at += n


def benchmark_hits(docs: DataFrame, items: DataFrame, keep: list[str], window: int = 13) -> DataFrame:
    """Columns ``keep`` of every document with n_words, n_hit, the word ``spans`` hit, and the ``items`` that occur.

    Documents and items are cut into words of letters, digits and non-ASCII characters after A-Z are
    lower-cased. A window is ``window`` consecutive words of an item, or a shorter item's words. Null and
    empty texts have no words and no hits; items without id or words are never found; repeated rows are
    judged one by one; empty tables give no rows, or no hits. Words of a benchmark of more than
    ``BENCHMARK_BYTES`` raise ValueError: call once for each part of it and add up the spans.
    """
    size = items.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes, more than {BENCHMARK_BYTES}: give it in parts")
    rows = items.select(F.col("item_id").cast("long"), "text").toArrow()
    phrases = phrases_of(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), window)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(phrases))

    def scan(batches):
        p = Phrases(*shared.value)
        parts, held, texts = [], 0, 0
        for part in chunks(batches):
            w = words_of(part.column("text"), ALNUM_LOWER)
            symbol, at, follows = _relevant(w, p)
            owner = np.searchsorted(w.first, at, side="right") - 1
            parts.append((part, symbol, at - w.first[owner], follows, owner + texts, w.counts))
            held, texts = held + len(symbol), texts + part.num_rows
            if held >= SHARD_WORDS or len(parts) >= 16:
                yield from _answer(parts, p)
                parts, held, texts = [], 0, 0
        if parts:
            yield from _answer(parts, p)

    return scan_texts(docs, scan, FOUND, keep)


def is_contaminated():
    """Over a twentieth of the words, and at least one, stand in benchmark windows."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
