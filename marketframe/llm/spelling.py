"""Spelling variants: words that are one edit apart, and the common form that a rare one stands for.

Two words one edit apart share all code points before and after the edit. A word is cut into parts; for each
part it joins the group of the words that agree with it everywhere else. Inside a group, padded matrices of
code points compare blocks of pairs: the words are one edit apart if common prefix and common suffix
together reach the longer length less one. A pair can share several groups and counts in one of them only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Maximal runs of letters; A-Z count as a-z.
RUN = "[A-Za-z\\u00C0-\\u00FF]{%d,}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word has at most this many parts (a long word has longer ones), and a part no fewer code points than ``SHORTEST``.
PARTS, SHORTEST = 8, 2
#: Larger groups of long parts are cut finer. Groups of the shortest parts are bounded by the alphabet.
LARGE = 2000
#: Code points compared at a time.
BLOCK = 4_000_000

_TILE = "word string, near long, best_n long, best string"


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, change: Column | None = None) -> DataFrame:
    """(word, n) of runs of at least ``least_length`` code points that occur at least ``least_count`` times.

    ``change`` may rewrite a ``word`` (with the columns of ``docs`` at hand) before lengths and counts are
    taken. A null text has no words.
    """
    runs = docs.withColumn("word", F.explode(F.regexp_extract_all("text", F.lit(RUN % least_length), 0)))
    runs = runs.withColumn("word", F.translate("word", _UPPER, _LOWER))
    if change is not None:
        runs = runs.withColumn("word", change).filter(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _parts(lo: Column, hi: Column) -> Column:
    """A range of places cut into parts."""
    step = F.greatest(F.lit(SHORTEST), F.ceil((hi - lo) / PARTS)).cast("int")
    return F.transform(F.sequence(lo, hi - 1, step), lambda a: F.struct(a.alias("lo"), F.least(a + step, hi).alias("hi")))


def _grouped(rows: DataFrame) -> DataFrame:
    """Name the group of each row: what stands before and after its part. ``size`` is the length of the shorter words."""
    longer = F.length("word") - F.col("size")
    key = F.xxhash64("size", "lo", F.col("word").substr(F.lit(1), F.col("lo")), F.col("word").substr(F.col("hi") + longer + 1, F.col("size")))
    return rows.withColumn("key", key)


def groups(words: DataFrame) -> DataFrame:
    """(key, size, lo, hi, word, n): every word once for each part, as one of its length and as one a code point longer.

    Groups of more than ``LARGE`` words whose part can be cut are cut, until none is left: a round for each
    factor of ``PARTS`` in the length of such a part.
    """
    size = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda s: s > 1))
    rows = words.select("word", "n", size.alias("size"))
    rows = _grouped(rows.select("*", F.explode(_parts(F.lit(0), F.col("size"))).alias("p")).select("word", "n", "size", "p.*"))
    out = rows.filter(F.col("hi") - F.col("lo") <= SHORTEST)
    rest = rows.filter(F.col("hi") - F.col("lo") > SHORTEST)
    while not (rest := cut_lineage(rest, "parts")).isEmpty():
        large = rest.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LARGE).select("key")
        out = out.unionByName(rest.join(large, "key", "left_anti").select(out.columns))
        finer = rest.join(large, "key", "left_semi").select("word", "n", "size", F.explode(_parts(F.col("lo"), F.col("hi"))).alias("p"))
        finer = _grouped(finer.select("word", "n", "size", "p.*"))
        out = out.unionByName(finer.filter(F.col("hi") - F.col("lo") <= SHORTEST).select(out.columns))
        rest = finer.filter(F.col("hi") - F.col("lo") > SHORTEST)
    return out


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    other = np.ones((len(a), a.shape[1] + 1), bool)
    np.not_equal(a, b, out=other[:, :-1])
    return other.argmax(axis=1)


def _tile(size: int, part: pa.Table) -> pa.RecordBatch:
    """Near words inside the groups of one size: per word how many, and the one of largest n (ties: the least)."""
    words, at = np.unique(np.array(part.column("word").to_pylist()), return_inverse=True)
    length = np.char.str_len(words)
    code = words.view(np.uint32).reshape(len(words), -1)  # padded with zeros
    front = code[:, :size]
    place = length[:, None] - 1 - np.arange(size)[None, :]
    back = np.take_along_axis(code, place, axis=1)  # the last code points, from the end
    n = np.zeros(len(words), np.int64)
    n[at] = part.column("n").to_numpy()
    key, lo, hi = (part.column(c).to_numpy() for c in ("key", "lo", "hi"))
    long = length[at] > size
    order = np.lexsort((at, long, key))
    at, key, lo, hi, long = at[order], key[order], lo[order], hi[order], long[order]
    end = np.searchsorted(key, key, side="right")
    partners = np.where(long, 0, end - 1 - np.arange(len(key)))  # shorter words meet all behind them
    upto = np.concatenate([[0], np.cumsum(partners)])
    own, other = [], []
    step = max(1, BLOCK // size)
    for first in range(0, int(upto[-1]), step):
        pair = np.arange(first, min(first + step, int(upto[-1])))
        i = np.searchsorted(upto, pair, side="right") - 1
        j = i + 1 + pair - upto[i]
        a, b = at[i], at[j]
        prefix = _first_difference(front[a], front[b])
        suffix = _first_difference(back[a], back[b])
        near = (prefix + suffix >= size - 1 + long[j]) & (a != b)
        # the one group that counts is that of the part in which the common suffix begins
        begin = np.maximum(size - suffix, 1) - 1
        near &= (lo[i] <= begin) & (begin < hi[i]) & (lo[j] == lo[i]) & (hi[j] == hi[i])
        own.append(a[near])
        other.append(b[near])
    a = np.concatenate([*own, *other]) if own else np.zeros(0, np.int64)
    b = np.concatenate([*other, *own]) if own else np.zeros(0, np.int64)
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    found, start, count = np.unique(a, return_index=True, return_counts=True)
    best = b[start]
    return pa.RecordBatch.from_arrays([pa.array(words[found].tolist(), pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array(words[best].tolist(), pa.string())], names=["word", "near", "best_n", "best"])


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of one size at a time; rows come in the order of size and key."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        while rows.num_rows:
            size = rows.column("size").to_numpy()
            to = int(np.searchsorted(size, size[0], side="right"))
            if held and held[-1].column("size")[-1].as_py() != size[0]:
                yield _tile(held[-1].column("size")[-1].as_py(), pa.concat_tables(held))
                held = []
            held.append(rows.slice(0, to))
            rows = rows.slice(to)
            if sum(t.num_rows for t in held) * (int(size[0]) + 1) > BLOCK:
                table = pa.concat_tables(held)
                key = table.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1], side="left"))  # the last group may go on
                if whole:
                    yield _tile(int(size[0]), table.slice(0, whole))
                    table = table.slice(whole)
                held = [table]
    if held:
        yield _tile(held[-1].column("size")[-1].as_py(), pa.concat_tables(held))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best): for words that have near ones, how many, and the one of largest ``n`` (ties: the least)."""
    dealt = groups(words).repartition(F.col("size"), F.col("key")).sortWithinPartitions("size", "key")
    tiles = dealt.select("size", "key", "lo", "hi", "word", "n").mapInArrow(_tiles, _TILE)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    merged = tiles.groupBy("word").agg(F.sum("near").alias("near"), best)
    return merged.select("word", "near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) without cycles: the last word that forms lead to. Each round doubles the step."""
    step = cut_lineage(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("__further"))
        moved = cut_lineage(step.join(on, "root", "left").select("word", F.coalesce("__further", "root").alias("root"), F.col("__further").isNotNull().alias("moved")), "forms")
        step = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return step


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words with counts.

    A word's form is its near word of largest ``n``, if that is at least ``times`` its own; null otherwise. Its
    root is where forms end, the word itself without one. Empty words are near one-letter words only by name:
    words of fewer than two code points meet nobody. No words, no rows.
    """
    words = cut_lineage(words.select("word", "n"), "words")
    common = F.col("best_n") >= times * F.col("n")
    out = words.join(near_words(words), "word", "left")
    out = cut_lineage(out.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n")), "near")
    return out.join(roots(out), "word", "left").withColumn("root", F.coalesce("root", "word"))
