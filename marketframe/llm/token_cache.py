"""Token counts of whole texts, kept in a table by content digest and tokenizer version.

A text is looked up by the SHA-256 of its normalised content (null counts as empty; nothing else may be
changed without changing counts) and the SHA-256 of the tokenizer file. Only distinct texts that the table
lacks are encoded, and their counts are appended to it, so a later run over grown data encodes the rest.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import scan_texts
from .words import chunks

CACHE = "version string, digest binary, n_tokens long"


@lru_cache(maxsize=4)
def _encoder(path: str):
    """Per worker: a function from texts to token counts."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """One count per version and digest; an append that was done twice counts once. No table yet: no rows."""
    try:
        table = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    return table.groupBy("version", "digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, with its ``digest``; new counts are appended to ``cache``.

    A null text is empty; repeated rows, and rows that share or lack a doc_id, are each counted. An empty
    table gives no rows. The row that stands for a digest is found by digests alone, so a text that a third
    of all rows share is encoded once and never gathered anywhere; rows that share both id and text are encoded
    once per part of a task.
    """
    spark, version = docs.sparkSession, version_of(path)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = read_cache(spark, cache).filter(F.col("version") == version)
    wanted = keyed.groupBy("digest").agg(F.min("doc_id").alias("chosen")).join(known, "digest", "left_anti")
    here = keyed.alias("k").join(wanted.alias("w"), F.col("k.doc_id").eqNullSafe(F.col("w.chosen")) & (F.col("k.digest") == F.col("w.digest")), "left_semi")

    def encode(batches):
        last = None
        for part in chunks(batches):  # rows that repeat id and text meet in one task, most of them in one part
            seen, fresh = {last}, []
            for at, digest in enumerate(part.column("digest").to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    fresh.append(at)
            last = part.column("digest")[part.num_rows - 1].as_py()
            part = part.take(pa.array(fresh, pa.int64()))
            yield part, {"n_tokens": pa.array(_encoder(path)(part.column("text").to_pylist()), pa.int64())}

    misses = scan_texts(here, encode, "n_tokens long", ["digest"])
    misses.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("version") == version).select("digest", "n_tokens")
    return keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "digest").select("doc_id", "digest", "n_bytes", "n_tokens")
