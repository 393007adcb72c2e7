"""One-permutation MinHash fingerprints of texts, and the order of documents that their query needs.

Every shingle is hashed once; its high bits choose a bin, the rest is its value, and a bin keeps its least
value. An empty bin borrows from the filled bin that comes first in a fixed random order of its own
(optimal densification: the order depends on the bin only, so equal sets borrow alike). The low bits of
all bins are packed; unrelated bins agree by chance in one of 2^bits cases, which ``likeness`` takes out.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACED_LOWER, grams, mix64, words_of

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_FEW = 64


class OnePermutation:
    """Fingerprints of ``bins`` bins with ``bits`` (1, 2, 4 or 8) bits each, over ``shingle``-word shingles.

    A text of fewer words is one shingle; a text without words has the empty fingerprint. Two empty ones
    are alike (1), an empty one is unlike any other (0).
    """

    def __init__(self, bins: int = 512, bits: int = 4, shingle: int = 5):
        self.bins, self.bits, self.shingle = bins, bits, shingle
        every = np.arange(bins, dtype=np.uint64)
        score = mix64((every[:, None] << np.uint64(32)) + every[None, :] + np.uint64(1))
        self.order = np.argsort(score, axis=1)
        self.turn = np.argsort(self.order, axis=1)  # when a bin's order comes to another bin

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Low bits of all bins of all texts, and which texts have any shingle."""
        value, first = grams(words_of(texts, SPACED_LOWER), self.shingle)
        n = len(texts)
        owner = np.repeat(np.arange(n), np.diff(first))
        shift = np.uint64(64 - int(self.bins).bit_length() + 1)
        place = owner * self.bins + (value >> shift).astype(np.int64)
        least = np.full(n * self.bins, _EMPTY, np.uint64)
        np.minimum.at(least, place, value & ((np.uint64(1) << shift) - np.uint64(1)))
        least = least.reshape(n, self.bins)
        filled = least != _EMPTY
        count = filled.sum(1)
        for d in np.flatnonzero((count > 0) & (count < _FEW)):
            have = np.flatnonzero(filled[d])
            donor = have[np.argmin(self.turn[:, have], axis=1)]
            least[d] = np.where(filled[d], least[d], least[d][donor])
        doc, empty = np.nonzero(~filled & (count >= _FEW)[:, None])
        turn = 0
        while len(doc):
            donor = self.order[empty, turn]
            got = filled[doc, donor]
            least[doc[got], empty[got]] = least[doc[got], donor[got]]
            doc, empty, turn = doc[~got], empty[~got], turn + 1
        return (mix64(least) & np.uint64((1 << self.bits) - 1)).astype(np.uint8), count > 0

    def likeness(self, a: np.ndarray, a_any: np.ndarray, b: np.ndarray, b_any: np.ndarray) -> np.ndarray:
        """Estimated share of common shingles, from the share of equal bins less those equal by chance."""
        chance = 0.5**self.bits
        raw = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
        return np.where(a_any & b_any, raw, (a_any == b_any).astype(float))

    def packed(self, codes: np.ndarray, some: np.ndarray) -> list[str]:
        """Fingerprints as base64 text."""
        wide = np.unpackbits(codes[:, :, None], axis=2, bitorder="little")[:, :, : self.bits]
        raw = np.packbits(wide.reshape(len(codes), -1), axis=1)
        return [base64.b64encode(r.tobytes()).decode() if s else "" for r, s in zip(raw, some, strict=True)]


def in_order(docs: DataFrame) -> DataFrame:
    """Documents dealt into ranges of ascending doc_id and sorted there: columns range, guest, doc_id, text.

    Each range ends with a guest, the first document of the next range (of the first range after the last
    one), so that every document meets its successor inside one partition. Ranges are cut at approximate
    quantiles; the texts move once. Null ids come first; rows of one id are ordered by text.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("double"), F.lit(-9.3e18)).alias("place"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(keyed.approxQuantile("place", [i / n for i in range(1, n)], 0.25 / n)))
    dealt = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="place", outputCol="range", handleInvalid="keep").transform(keyed)
    heads = [(r["range"], r["head"]) for r in dealt.groupBy("range").agg(F.min("place").alias("head")).sort("range").collect()]
    guests = spark.createDataFrame([(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)], "place double, host double")
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    abroad = F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))
    both = dealt.join(F.broadcast(guests), "place", "left").select("doc_id", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, abroad))).alias("to"))
    flat = both.select("to.range", "to.guest", "doc_id", "text")
    return flat.repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "text")


def with_next(batches, column: str = "text"):
    """From the batches of ``in_order``: lists (doc_id, text, guest) of neighbouring rows; the last row is seen again."""
    held = None
    for batch in batches:
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column(column).to_pylist(), batch.column("guest").to_pylist(), strict=True))
        size = 0
        out = [held] if held else []
        for r in rows:
            out.append(r)
            size += len(r[1])
            if size > 1_000_000:
                yield out
                out, size = [r], 0
        if len(out) > 1:
            yield out
        held = out[-1] if out else held
