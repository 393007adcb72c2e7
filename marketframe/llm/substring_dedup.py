"""Word windows that stand more than once in a corpus, found with FM-indexes over shards of passages.

Every window of WINDOW words names one of its runs of ANCHOR words, the one with the least hash, so equal
windows name equal anchors. Neighbouring windows mostly share theirs; their words together are a segment.
Segments whose anchor stands only once cannot hold a repeat. The others are dealt into shards by anchor
(equal segments as one, with their count), each shard gets an FM-index over the wavelet matrix of its
words, and each segment is searched backward in it: whole at first, and if that stands only once, window by
window. All windows that occur at least twice are marked; a shard holds every occurrence of its windows.

Anchors that a sample shows to be very common rank behind all others. A window is then dealt by a common
anchor only if all its anchors are common, that is inside a common passage, where segments are equal and
merge before they move; the windows across its ends go by the rare words outside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .fm_index import FMIndex
from .scan import fields, scan_texts
from .words import SPACED, Words, chunks, mix64, signed, words_of

WINDOW, ANCHOR = 35, 8
#: Fixed size of the filter of repeated anchors; what it lets through needlessly only costs time.
FILTER_BITS = 1 << 27
#: Share of documents that shows which anchors are common; it steers how work is dealt, not what is found.
SAMPLE, COMMON_SHARE, COMMON_LEAST = 64, 0.005, 12
SHARD_WORDS = 250_000
FLUSH_BYTES = 8_000_000

_STEP = np.uint64(0x9FB21C651E98DF25 | 1)
_TOP = np.uint64(1 << 63)


def _grams(w: Words) -> np.ndarray:
    """Hash of the ANCHOR words from every place on; those across texts are never used."""
    n = max(len(w.hash) - ANCHOR + 1, 0)
    value = np.zeros(n, np.uint64)
    for j in range(ANCHOR):
        value = value * _STEP + w.hash[j : j + n]
    return mix64(value)


def _windows(w: Words, window: int) -> np.ndarray:
    """First words of all windows."""
    count = np.maximum(w.counts - window + 1, 0)
    return np.repeat(w.first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())


def segments(w: Words, common: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of every run of windows that share an anchor."""
    start = _windows(w, window)
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    g = _grams(w)
    rank = g >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, g), len(common) - 1)
        rank = np.where(common[at] == g, rank | _TOP, rank)
    width = window - ANCHOR + 1
    best, span = np.arange(len(g)), 1
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(rank[a] <= rank[b], a, b)
        span *= 2
    a, b = best[start], best[start + width - span]
    anchor = np.where(rank[a] <= rank[b], a, b)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(fresh)
    last = np.concatenate([begin[1:], [len(start)]]) - 1
    return g[anchor[begin]], start[begin], start[last]


def _digest(w: Words, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Hash of the words of segments."""
    n = len(w.hash)
    up = np.full(n + 1, _STEP, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n + 1, pow(int(_STEP), -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(w.hash) * up[:n], out=sums[1:])
    size = last - first + window
    return mix64((sums[last + window] - sums[first]) * down[first] + size.astype(np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    """A key of each row from id and text, so that rows which share an id are told apart."""
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def common_anchors(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of word runs that stand in COMMON_SHARE of the sampled documents; a bounded number."""

    def scan(batches):
        for part in chunks(batches):
            w = words_of(part.column("text"), SPACED)
            g = _grams(w)
            for d in range(part.num_rows):
                own = np.unique(g[w.first[d] : max(w.first[d + 1] - ANCHOR + 1, w.first[d])])
                yield part.slice(d, 1), {"grams": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(signed(own)))}

    sample = docs.select("text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    rows = scan_texts(sample, scan, "grams array<long>", [])
    least = max(COMMON_LEAST, int(COMMON_SHARE * sample.count()))
    found = rows.select(F.explode("grams").alias("g")).groupBy("g").count().filter(F.col("count") >= least).select("g").toArrow()
    return np.sort(found.column("g").to_numpy().astype(np.int64).view(np.uint64))


def _anchor_filter(docs: DataFrame, common, window: int) -> bytes:
    """Bitmap of the slots of anchors that stand at least twice."""

    def run(batches):
        for part in chunks(batches):
            anchor, _, _ = segments(words_of(part.column("text"), SPACED), common.value, window)
            value, n = np.unique(anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(n)], names=["anchor", "n"])

    counted = docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    slot = F.pmod("anchor", F.lit(FILTER_BITS)) + 1
    rows = counted.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in rows.toLocalIterator():
        at = (r["k"] - 1) * len(r["bits"])
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


_SEGMENT = "row_key long, doc_id long, first int, anchor long, digest long, n long, words binary"


def _collect_segments(docs: DataFrame, common, kept, window: int) -> DataFrame:
    """Places of segments (row_key, doc_id, first; no words) and distinct segments of a task (n, words)."""
    arrow = to_arrow_schema(fields(_SEGMENT))

    def batch(row_key, doc_id, first, anchor, digest, n, words):
        columns = [row_key, doc_id, first, anchor, digest, n, words]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        bits = np.frombuffer(kept.value, np.uint8)
        held, held_bytes = {}, 0

        def flush():
            keys = list(held)
            none = pa.nulls(len(keys))
            yield batch(none, none, none, [k[0] for k in keys], [k[1] for k in keys], [v[0] for v in held.values()], [v[1] for v in held.values()])

        for part in chunks(batches):
            w = words_of(part.column("text"), SPACED)
            anchor, first, last = segments(w, common.value, window)
            slot = (anchor % np.uint64(FILTER_BITS)).astype(np.int64)
            some = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            anchor, first, last = anchor[some], first[some], last[some]
            if not len(anchor):
                continue
            digest = _digest(w, first, last, window)
            owner = np.searchsorted(w.first, first, side="right") - 1
            row = pa.array(owner)
            yield batch(part.column("row_key").take(row), part.column("doc_id").take(row), first - w.first[owner], signed(anchor), signed(digest), pa.nulls(len(row)), pa.nulls(len(row)))
            raw = w.data.tobytes()
            for i, key in enumerate(zip(signed(anchor).tolist(), signed(digest).tolist(), strict=True)):
                if key in held:
                    held[key][0] += 1
                    continue
                a, b = w.start[first[i]], w.end[last[i] + window - 1]
                held[key] = [1, raw[a:b]]
                held_bytes += int(b - a) + 200
            if held_bytes > FLUSH_BYTES:
                yield from flush()
                held, held_bytes = {}, 0
        if held:
            yield from flush()

    rows = docs.select("row_key", F.col("doc_id").cast("long"), "text").mapInArrow(run, fields(_SEGMENT))
    return cut_lineage(rows, "segments")


def _marks(anchor: np.ndarray, digest: np.ndarray, n: np.ndarray, words: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct segments of whole anchors: which of their windows occur twice or more, as bits."""
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
    at = np.flatnonzero(fresh)
    n = np.add.reduceat(n, at)
    anchor, digest = anchor[at], digest[at]
    group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
    use = np.flatnonzero(np.bincount(group, n)[group] > 1)  # an anchor that came through by chance
    anchor, digest, n = anchor[use], digest[use], n[use]
    mask = np.zeros(len(anchor), np.int64)
    if not len(anchor):
        return anchor, digest, mask
    w = words_of(words.take(pa.array(at[use])), SPACED)
    vocabulary, symbol = np.unique(w.hash, return_inverse=True)
    m = len(anchor)
    seq = np.ones(len(symbol) + m, np.int64)
    seq[np.arange(len(symbol)) + w.owner()] = symbol + 2
    first = w.first[:-1] + np.arange(m)
    weight = np.repeat(n, w.counts + 1)
    index = FMIndex(seq, len(vocabulary) + 2, order=2 * window, weight=weight)
    size = w.counts
    lo, hi = index.search(seq, first, size, least=2)
    whole = hi > lo
    windows = size - window + 1
    mask[whole] = (np.int64(1) << windows[whole]) - 1
    part = np.flatnonzero(~whole)
    many = windows[part]
    who = np.repeat(part, many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    lo, hi = index.search(seq, first[who] + offset, np.full(len(who), window), least=2)
    hit = hi > lo
    np.bitwise_or.at(mask, who[hit], np.int64(1) << offset[hit])
    return anchor, digest, mask


def _search_shards(found: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, mask) of all segments that hold a repeated window."""
    dealt = found.filter("words IS NOT NULL").select("anchor", "digest", "n", "words").repartition("anchor").sortWithinPartitions("anchor", "digest")

    def answer(table):
        anchor, digest, n = (table.column(c).to_numpy() for c in ("anchor", "digest", "n"))
        a, d, mask = _marks(anchor, digest, n, table.column("words").combine_chunks(), window)
        some = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(d[some]), pa.array(mask[some])], names=["anchor", "digest", "mask"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size * 48 < SHARD_WORDS:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            at = 0
            while at < cut:
                to = min(at + SHARD_WORDS // 48, cut)
                to = cut if to == cut else int(np.searchsorted(anchor, anchor[to - 1], side="right"))
                yield answer(table.slice(at, to - at))
                at = to
            held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            yield answer(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "anchor long, digest long, mask long")


def remove_repeats(docs: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` (doc_id, text and others) without its repeated windows.

    Adds n_words, n_removed, the word ``spans`` removed, and ``kept``: the other words, joined by one space.
    A window is ``window`` words of one text, separated by white space and compared as they are; a word is
    removed if any window over it stands at another place too, in the same text or another row's, judged on
    the texts as given. Null, empty and shorter texts lose nothing; a repeated row repeats all its windows;
    rows without doc_id are judged like others; an empty table gives no rows. ``window`` is 16 to 69.
    """
    if not 2 * ANCHOR <= window < 62 + ANCHOR:
        raise ValueError("window must be 16 to 69 words")
    sc = docs.sparkSession.sparkContext
    keyed = _keyed(docs)
    narrow = keyed.select("row_key", "doc_id", "text")
    common = sc.broadcast(common_anchors(narrow))
    kept = sc.broadcast(_anchor_filter(narrow, common, window))
    found = _collect_segments(narrow, common, kept, window)
    marked = _search_shards(found, window)
    places = found.filter("row_key IS NOT NULL").select("row_key", F.col("doc_id").alias("id"), "first", "anchor", "digest").join(marked, ["anchor", "digest"])
    by_row = places.groupBy("row_key", "id").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))  # rows that repeat id and text name the same marks: at most one for each word
    both = keyed.alias("d").join(by_row.alias("m"), (F.col("d.row_key") == F.col("m.row_key")) & F.col("d.doc_id").eqNullSafe(F.col("m.id")), "left").select(*[F.col(f"d.`{c}`") for c in dict.fromkeys([*keep, "text"])], "marks")

    def scan(batches):
        for part in chunks(batches):
            w = words_of(part.column("text"), SPACED)
            marks = part.column("marks")
            values, sizes = marks.flatten(), pc.list_value_length(marks).fill_null(0).to_numpy(zero_copy_only=False)
            first = values.field("first").to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.first[:-1], sizes)
            mask = values.field("mask").to_numpy(zero_copy_only=False)
            cover = np.zeros(len(w.hash) + 1, np.int64)
            for b in range(63):
                at = first[(mask >> b) & 1 == 1] + b
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            owner = w.owner()
            edge = np.ones(len(gone) + 1, bool)
            edge[:-1][1:] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(edge[:-1] & gone)
            stop = np.flatnonzero(edge[1:] & gone) + 1
            span_owner = owner[begin] if len(begin) else begin
            spans = pa.StructArray.from_arrays([pa.array(begin - w.first[span_owner], pa.int32()), pa.array(stop - w.first[span_owner], pa.int32())], ["start", "end"])
            stay = np.flatnonzero(~gone)
            size = w.end[stay] - w.start[stay] + 1  # with a space
            total = int(size.sum())
            take = np.repeat(w.start[stay] - (np.cumsum(size) - size), size) + np.arange(total)
            out = np.concatenate([w.data, [32]]).astype(np.uint8)[take]
            out[np.cumsum(size) - 1] = 32
            stay_count = np.bincount(owner[stay], minlength=part.num_rows)
            byte_end = np.concatenate([[0], np.cumsum(size)])[np.cumsum(stay_count)]
            byte_start = np.concatenate([[0], byte_end[:-1]])
            raw = out.tobytes()
            yield (
                part,
                {
                    "n_words": pa.array(w.counts, pa.int64()),
                    "n_removed": pa.array(w.counts - stay_count, pa.int64()),
                    "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(span_owner, np.arange(part.num_rows + 1)), pa.int32()), spans),
                    "kept": pa.array([raw[a : max(a, b - 1)].decode() for a, b in zip(byte_start, byte_end, strict=True)], pa.string()),
                },
            )

    return scan_texts(both, scan, "n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string", keep)
