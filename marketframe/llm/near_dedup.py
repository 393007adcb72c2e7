"""Groups of near-duplicate texts by MinHash bands and odd sketches, confirmed on full shingle sets.

Every text is signed by BANDS x ROWS MinHash samples. Texts that agree in all samples of a band are
candidates; a pair at the least similarity of 0.75 is missed by all bands with a chance of 3e-8. The
samples are also folded into an odd sketch, a bitmap in which sample i flips one bit: the population count
of the exclusive or of two sketches estimates how many samples differ, and candidates far below the
threshold are dropped before their sets are fetched.

Texts with equal sets are one class, so copies never multiply. A band's bucket is not paired up: a text
meets the smallest member of all its buckets; what stays in different components is compared again, first
with the smallest member of each bucket and at last within the buckets that still hold several components. So no link
between different texts that could join components is left untried. Shingles that only one candidate has
can be in no intersection; what is left of a set bounds its similarity to any other, and pairs that the
bound rules out are never made.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .scan import scan_texts
from .words import SPACED_LOWER, chunks, distinct_sets, grams, list_of, mix64, signed, words_of

BANDS, ROWS = 64, 5
SKETCH_BITS = 1024
#: What an estimate may fall short of the threshold by: about five of its standard errors (0.026).
SLACK = 0.13
#: Fixed size of the filter that spares texts outside all candidate pairs; false hits only cost time.
FILTER_BITS = 1 << 23
#: The same for shingles that stand in two candidates; false hits only weaken the bound.
COMMON_BITS = 1 << 26
PART_BYTES = 600_000

_FACTOR = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def sign(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and odd sketches (texts x SKETCH_BITS / 64) of non-empty shingle sets."""
    n, samples = len(first) - 1, len(_FACTOR)
    least = np.empty((samples, n), np.uint64)
    for i, a in enumerate(_FACTOR):
        least[i] = np.minimum.reduceat(x * a, first[:-1])
    keys = np.zeros((BANDS, n), np.uint64)
    rows = least.reshape(BANDS, ROWS, n)
    for j in range(ROWS):
        keys = mix64(keys + rows[:, j] + np.uint64(j + 1))
    keys = mix64(keys + np.arange(BANDS, dtype=np.uint64)[:, None])
    bit = (mix64(least + np.arange(samples, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount((bit + np.arange(n) * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS) & 1
    sketch = np.packbits(odd.astype(np.uint8).reshape(n, -1), axis=1, bitorder="little").view(np.uint64)
    return np.ascontiguousarray(keys.T), np.ascontiguousarray(sketch)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set digest (d1, d2), band keys and odd sketch of every row."""

    def scan(batches):
        for part in chunks(batches, limit=PART_BYTES):
            x, first = distinct_sets(*grams(words_of(part.column("text"), SPACED_LOWER), shingle))
            size = np.diff(first)
            some = np.flatnonzero(size)
            keys, sketch = np.zeros((0, BANDS), np.uint64), np.zeros((0, SKETCH_BITS // 64), np.uint64)
            digest = np.zeros((2, len(size)), np.uint64)
            if len(some):
                keys, sketch = sign(x, np.concatenate([first[some], first[-1:]]))
                for k in range(2):
                    digest[k, some] = np.add.reduceat(mix64(x + np.uint64(k * 7919 + 1)), first[some])
            filled = np.concatenate([[0], np.cumsum(size > 0)])
            yield (
                part,
                {
                    "n_shingles": pa.array(size, pa.int64()), "d1": pa.array(signed(digest[0])), "d2": pa.array(signed(digest[1])),
                    "keys": list_of(signed(keys.ravel()), filled * BANDS, pa.int64()), "sketch": list_of(signed(sketch.ravel()), filled * (SKETCH_BITS // 64), pa.int64()),
                },
            )

    return scan_texts(docs, scan, "n_shingles long, d1 long, d2 long, keys array<long>, sketch array<long>", ["doc_id"])


def estimated_likeness(a: Column, b: Column) -> Column:
    """Similarity by the population count of two odd sketches' exclusive or."""
    flipped = reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64)])
    differing = F.log(F.greatest(1 - 2 * flipped / SKETCH_BITS, F.lit(1e-9))) / (2 * np.log(1 - 2 / SKETCH_BITS))
    return 1 - differing / (BANDS * ROWS)


def _set_filter(nodes: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS bits with the slots of all nodes."""
    slot = _slot(F.col("node")) + 1
    return _bitmap(nodes.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")), FILTER_BITS)


def _bitmap(rows: DataFrame, size: int) -> bytes:
    """One bitmap of a fixed size from its parts (k from 1, bits)."""
    out = bytearray(size // 8)
    for r in rows.toLocalIterator():
        at = (r["k"] - 1) * len(r["bits"])
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def _slot(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(FILTER_BITS))


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): full sets of the texts of ``nodes``, and of a few others that share a slot."""
    shared = docs.sparkSession.sparkContext.broadcast(_set_filter(nodes))

    def scan(batches):
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            wanted = batch.filter(pa.array(bits[batch.column("slot").to_numpy(zero_copy_only=False)]))
            for part in chunks([wanted]):
                x, first = distinct_sets(*grams(words_of(part.column("text"), SPACED_LOWER), shingle))
                yield part, {"shingles": list_of(signed(x), first, pa.int64())}

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "text", _slot(F.col("doc_id")).alias("slot"))
    return cut_lineage(scan_texts(rows, scan, "shingles array<long>", ["node"]), "sets")


def _common_sizes(sets: DataFrame) -> DataFrame:
    """(node, common): how many shingles of a set stand in another one too, or a few more by chance."""
    slot = F.pmod(F.xxhash64("x"), F.lit(COMMON_BITS)) + 1
    twice = sets.select(F.explode("shingles").alias("x")).groupBy("x").count().filter("count > 1")
    rows = twice.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    slots = sets.select("node", F.transform("shingles", lambda x: F.pmod(F.xxhash64(x), F.lit(COMMON_BITS))).alias("slots"))
    shared = sets.sparkSession.sparkContext.broadcast(_bitmap(rows, COMMON_BITS))

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            slots = batch.column("slots")
            at = slots.flatten().to_numpy()
            hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(hit)])
            size = pc.list_value_length(slots).to_numpy()
            end = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sums[end] - sums[end - size])], names=["node", "common"])

    return slots.mapInArrow(run, "node long, common long").groupBy("node").agg(F.max("common").alias("common"))


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) with 100 * |intersection| >= threshold * |union|."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return cut_lineage(both.filter(100 * shared >= threshold * (F.size("x") + F.size("y") - shared)).select("a", "b"), "confirmed")


def near_groups(docs: DataFrame, shingle: int = 5, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Words are separated by white space after A-Z are lower-cased; a set has the distinct runs of
    ``shingle`` words, or all words of a shorter text as one. Texts without words are linked with nothing.
    Rows of one doc_id are one node; a row without doc_id has no component (null). An empty table gives
    no rows. ``threshold`` (percent) may not be under 75, for which the bands are made.
    """
    if threshold < 75:
        raise ValueError("the bands find pairs of 75 percent and more")
    docs = docs.select("doc_id", "text")
    signed_rows = cut_lineage(signatures(docs, shingle), "signatures")
    some = signed_rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("node"))
    copies = cut_lineage(some.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"]).filter("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "copies")
    stand = some.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")

    banded = stand.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    shared = cut_lineage(banded.join(buckets, "key").select("key", "node", "low").distinct(), "buckets")
    sets = _sets(docs, shared.select("node"), shingle)
    common = _common_sizes(sets)
    sketch = cut_lineage(some.select(F.col("doc_id").alias("node"), "n_shingles", "sketch").join(common, "node"), "sketches")
    left, right = (sketch.select(F.col("node").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("common").alias(f"m_{n}"), F.col("sketch").alias(f"s_{n}")) for n in "ab")
    most = F.least("m_a", "m_b")  # no intersection is larger
    possible = 100 * most >= threshold * (F.col("n_a") + F.col("n_b") - most)
    likely = possible & (estimated_likeness(F.col("s_a"), F.col("s_b")) >= threshold / 100 - SLACK)

    def hopeful(candidates: DataFrame) -> DataFrame:
        return cut_lineage(candidates.join(left, "a").join(right, "b").filter(likely).select("a", "b"), "pairs")

    first = hopeful(shared.filter("node != low").groupBy(F.col("node").alias("b")).agg(F.min("low").alias("a")).select("a", "b"))
    links = copies.union(_confirmed(first, sets, threshold))
    found = components(links)

    def placed() -> DataFrame:
        """Rows of the buckets with the component of each member."""
        return shared.join(found, "node", "left").select("key", "node", "low", F.coalesce("component", "node").alias("component"))

    of_low = found.select(F.col("node").alias("low"), F.col("component").alias("of_low"))
    apart = placed().join(of_low, "low", "left").filter(F.col("component") != F.coalesce("of_low", "low"))
    rest = hopeful(apart.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.union(_confirmed(rest, sets, threshold))
        found = components(links)
    tried = first.union(rest)

    named = placed()
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high AND n > 2")
    keys = stand.select(F.col("doc_id").alias("node"), "keys")
    members = cut_lineage(named.drop("low").join(mixed.select("key"), "key").join(sketch, "node").join(keys, "node"), "mixed")
    if not members.isEmpty():
        m, o = (members.select("key", F.col("node").alias(n), F.col("component").alias(f"c_{n}"), F.col("n_shingles").alias(f"n_{n}"), F.col("common").alias(f"m_{n}"), F.col("sketch").alias(f"s_{n}"), F.col("keys").alias(f"k_{n}")) for n in "ab")
        once = F.get(F.array_intersect("k_a", "k_b"), F.lit(0)) == m.key  # a pair meets in the first bucket that it shares
        across = m.join(o, (m.key == o.key) & (F.col("c_a") < F.col("c_b")) & likely & once)
        across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        last = cut_lineage(across.join(tried, ["a", "b"], "left_anti"), "untried")
        if not last.isEmpty():
            found = components(links.union(_confirmed(last, sets, threshold)))

    return signed_rows.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
