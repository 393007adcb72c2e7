"""Ranked lexical search in integer arithmetic, term owners in a pipeline.

Terms belong to stages: rare terms to the first, the most common to the last. Documents are dealt into shards
of a bounded number. Items travel in bundles: an item's bundle for a shard holds its weighted terms and a
sparse accumulator of documents and scores, and each stage cogroups it with the postings of the terms that
the stage owns. After a stage an item keeps the documents that can still be among the best of the shard; with
rare terms first, that leaves few. The last stage keeps the best of each shard, and the best of all shards follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, work_dir
from .words import ALNUM_LOWER, chunks, list_of, signed, words_of

#: Documents of a shard and items of a bundle, on average.
SHARD_DOCS, BUNDLE_ITEMS = 4096, 256
#: A term in more than such a share of the documents belongs to a later stage.
STAGE_SHARES = (1 / 256, 1 / 16)
#: Rows of one term in a join are dealt to so many tasks.
SALTS = 16
#: No term adds more than its weight times this.
MOST = 1_000_000
#: Bits for each distinct term of the items, and the most bits, of the filter for terms that no item has.
FILTER_BITS, FILTER_MOST = 32, 1 << 26

_COUNTED = "key long, doc_id long, n long, terms array<long>, counts array<int>"
_BUNDLE = "bundle int, shard int, item long, item_id long, terms array<long>, weights array<long>, stages array<int>, docs array<long>, ids array<long>, scores array<long>"
_NO_ID = np.iinfo(np.int64).max


def _slot(value: np.ndarray, bits: int) -> np.ndarray:
    return (value >> np.uint64(20)) & np.uint64(bits - 1)


def term_counts(texts: DataFrame, filled: np.ndarray | None = None) -> DataFrame:
    """(key, doc_id, n, terms, counts): all terms of a text in number, and its distinct terms (hashes) with counts.

    ``filled`` is a bitmap of the terms that matter; a few others may pass. Texts without terms have no row.
    """
    bits = 0 if filled is None else len(filled) * 64

    def run(batches: Iterator[pa.RecordBatch]):
        for part in chunks(batches):
            w = words_of(part.column("text"), ALNUM_LOWER)
            owner, value = w.owner(), w.hash
            if bits:
                slot = _slot(value, bits)
                near = (filled[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                owner, value = owner[near], value[near]
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            fresh = np.ones(len(value), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
            start = np.flatnonzero(fresh)
            count = np.diff(np.append(start, len(value)))
            some = w.counts > 0
            off = np.searchsorted(owner[start], np.arange(w.texts + 1))
            rows = pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("doc_id"), pa.array(w.counts, pa.int64()), list_of(signed(value[start]), off, pa.int64()), list_of(count, off, pa.int32())],
                names=["key", "doc_id", "n", "terms", "counts"],
            )
            yield rows.filter(pa.array(some))

    return texts.select("key", "doc_id", "text").mapInArrow(run, _COUNTED)


def _filter_of(terms: DataFrame) -> np.ndarray:
    """A bitmap of distinct terms, as large as they need up to a fixed size."""
    bits = min(FILTER_MOST, max(1 << 12, 1 << int(FILTER_BITS * max(terms.count(), 1) - 1).bit_length()))
    slot = F.shiftrightunsigned("term", 20).bitwiseAND(bits - 1)
    words = terms.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((shiftrightunsigned(term, 20) & {bits - 1}) & 63 AS int))")).alias("word"))
    out = np.zeros(bits // 64, np.uint64)
    for r in words.toLocalIterator():  # at most bits / 64 rows, whatever the input
        out[r.at] = np.uint64(r.word & 0xFFFFFFFFFFFFFFFF)
    return out


def _evaluate(stage: int, top: int, left: pa.Table, right: pa.Table, last: bool) -> pa.Table:
    """One stage for the items of a bundle over the documents of a shard."""
    flat = lambda c: left.column(c).combine_chunks().flatten().to_numpy()
    offsets = lambda c: left.column(c).combine_chunks().offsets.to_numpy() - left.column(c).combine_chunks().offsets[0].as_py()
    acc_docs, acc_ids, acc_scores, acc_at = flat("docs"), flat("ids"), flat("scores"), offsets("docs")
    terms, weights, stages, term_at = flat("terms"), flat("weights"), flat("stages"), offsets("terms")
    docs, seen = np.unique(np.concatenate([acc_docs, right.column("key").to_numpy()]), return_index=True)
    ids = np.concatenate([acc_ids, right.column("doc_id").to_numpy()])[seen]
    place = right.column("term").to_numpy()
    order = np.argsort(place, kind="stable")
    place, doc, part = place[order], np.searchsorted(docs, right.column("key").to_numpy()[order]), right.column("part").to_numpy()[order]
    begin, end = np.searchsorted(place, terms, "left"), np.searchsorted(place, terms, "right")
    out = []
    for i in range(left.num_rows):
        score = np.zeros(len(docs), np.int64)
        mine = slice(acc_at[i], acc_at[i + 1])
        score[np.searchsorted(docs, acc_docs[mine])] = acc_scores[mine]
        rest = 0
        for t in range(term_at[i], term_at[i + 1]):
            if stages[t] == stage:
                own = slice(begin[t], end[t])
                score[doc[own]] += weights[t] * part[own]  # a document holds a term once
            elif stages[t] > stage:
                rest += int(weights[t]) * MOST
        near = np.flatnonzero(score)
        if len(near) > top:
            least = np.partition(score[near], -top)[-top]
            near = near[score[near] + rest >= least]
            if last:
                near = near[np.lexsort((ids[near], -score[near]))[:top]]
        out.append((near, score[near]))
    at = np.concatenate([[0], np.cumsum([len(n) for n, _ in out])])
    near = np.concatenate([n for n, _ in out]) if out else np.zeros(0, np.int64)
    scores = np.concatenate([s for _, s in out]) if out else np.zeros(0, np.int64)
    arrays = {"docs": docs[near], "ids": ids[near], "scores": scores}
    return pa.table({c: list_of(arrays[c], at, pa.int64()) if c in arrays else left.column(c) for c in left.column_names})


def _stage(number: int, top: int, last: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _evaluate(number, top, left, right, last)

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its best rows of ``docs`` with a score above 0.

    Both have ``text``, and ``doc_id`` and ``item_id`` as longs; other columns are left out. A term's weight is
    floor(1000 ln((2N+2) / (2 df+1))), its part of a score weight * ((10^9 tf) div (1000 tf + 20 m)) with
    m = 50 + (50 n N) div L; N counts texts with a term, L their terms, n a text's own. Every row is a
    document or item of its own, repeated ids included. Equal scores rank by doc_id, null last. Null and empty
    texts have no terms; items without any, and empty tables, have no rows.
    """
    rows = items.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").alias("doc_id"), "text")
    wanted = cut_lineage(term_counts(rows).select(F.col("key").alias("item"), F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")), "items")
    n_items = wanted.select("item").distinct().count()
    # a null id gets a negative key
    place = F.monotonically_increasing_id()
    texts = docs.select(F.when(F.col("doc_id").isNull(), -1 - place).otherwise(place).alias("key"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text")
    counted = cut_lineage(term_counts(texts, _filter_of(wanted.select("term").distinct())), "terms")
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    number, length = total.docs, max(total.terms or 0, 1)
    shards, bundles = max(1, -(-number // SHARD_DOCS)), max(1, -(-n_items // BUNDLE_ITEMS))

    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * number + 2) / (2.0 * F.col("df") + 1))).cast("long")
    stage = sum((F.col("df") > share * number).cast("int") for share in STAGE_SHARES)
    weighted = wanted.join(df, "term").select("item", "item_id", "term", weight.alias("weight"), stage.alias("stage"), F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"))
    weighted = cut_lineage(weighted, "weighted")

    owners = weighted.select("bundle", "stage", "term", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")).distinct()
    shard: Column = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    m = F.expr(f"50 + (50 * n * {number}L) div {length}L")
    posted = counted.withColumn("m", m).select("key", "doc_id", "m", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    posted = posted.select("key", "doc_id", "m", F.col("t.terms").alias("term"), F.col("t.counts").cast("long").alias("tf"), F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
    part = F.expr("(1000000000L * tf) div (1000 * tf + 20 * m)")
    path = work_dir(docs.sparkSession, "postings")
    posted.join(owners, ["term", "salt"]).select("bundle", shard.alias("shard"), "stage", "key", "doc_id", "term", part.alias("part")).write.partitionBy("stage").parquet(path)
    posted = docs.sparkSession.read.schema("bundle int, shard int, key long, doc_id long, term long, part long, stage int").parquet(path)

    none = F.array().cast("array<long>")
    held = F.collect_list(F.struct("term", "weight", "stage")).alias("t")
    bundle = weighted.groupBy("bundle", "item", "item_id").agg(held).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    bundle = bundle.select(
        "bundle", "shard", "item", "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.col("t.stage").alias("stages"), none.alias("docs"), none.alias("ids"), none.alias("scores")
    )
    for s in range(len(STAGE_SHARES) + 1):
        owned = posted.filter(F.col("stage") == s).drop("stage")
        step = _stage(s, top, s == len(STAGE_SHARES))
        bundle = bundle.groupBy("bundle", "shard").cogroup(owned.groupBy("bundle", "shard")).applyInArrow(step, _BUNDLE)
    best = bundle.select("item", "item_id", F.explode(F.arrays_zip("docs", "ids", "scores")).alias("d")).select("item", "item_id", "d.*")
    order = Window.partitionBy("item").orderBy(F.desc("scores"), "ids", F.desc("docs"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("item_id", "rank", F.when(F.col("docs") >= 0, F.col("ids")).alias("doc_id"), F.col("scores").alias("score"))
