"""From raw documents to token ids, in stages that are each written as Parquet and read again."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.bpe import encode_texts
from marketframe.llm.decontaminate import benchmark_hits, is_contaminated
from marketframe.llm.near_dedup import near_groups
from marketframe.llm.queries import fold
from marketframe.llm.scan import as_row, with_key
from marketframe.llm.substring_dedup import remove_repeats
from marketframe.llm.toxicity import learn, score_texts
from marketframe.session import shuffles_dropped, work_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; labels of fold 0 are not learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold() != 0).select("doc_id", "toxic")
    return score_texts(as_row(docs), learn(docs, labels), ["row"]).filter("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near texts: that of the smallest doc_id (null last), of equal ids the first row.

    Rows are judged by their own texts: rows of one id with unlike texts all stay, rows without an id take
    part. Texts without words are like nothing; of such rows of one id one stays, without an id all.
    """
    keyed = with_key(docs)
    groups = near_groups(keyed.select(F.col("key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "key")
    ids = keyed.select("key", "doc_id").join(groups, "key")
    some, known = F.col("n_shingles") > 0, F.col("doc_id").isNotNull()
    group = [F.when(some, F.col("component_id")).alias("g1"), F.when(~some & known, F.col("doc_id")).alias("g2"), F.when(~some & ~known, F.col("key")).alias("g3")]
    first = ids.groupBy(*group).agg(F.min(F.struct(~known, "doc_id", "key"))["key"].alias("key"))
    return keyed.join(first.select("key"), "key", "left_semi").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of 35 words; a text that loses nothing stays as it is."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    cut = remove_repeats(packed, ["doc_id", "text", "row"]).select("doc_id", text.alias("text"), "row")
    values = {c: F.col(f"row.`{c}`") for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in values:
        values["n_chars"] = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), values["n_chars"])
    return cut.select(*[values[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth stands in benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return benchmark_hits(as_row(docs), benchmark, ["row"]).filter(~is_contaminated()).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text they decode to."""
    coded = encode_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "lang", "source"])
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A trained classifier, merges and digests of them have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{number}-{name}")
        with shuffles_dropped(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
