"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from . import oracles
from .bpe import encode_texts
from .decontaminate import benchmark_hits, is_contaminated
from .fingerprint import OnePermutation, in_order, with_next
from .katz import katz_scores
from .lexical import ranked
from .license_scan import scan_licenses
from .main_text import main_text_of
from .near_dedup import near_groups
from .spelling import variants, word_counts
from .substring_dedup import remove_repeats
from .token_cache import count_tokens
from .toxicity import learn, score_texts
from .url_templates import host_of, longest_rule, path_of, template_verdicts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(column).cast("string")) % 5


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the texts outside fold 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold() != 1).alias("trained"))
    return katz_scores(docs).withColumn("held_out", F.coalesce(fold() == 1, F.lit(False)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, ["doc_id"]).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text beside its edited text (its last quarter replaced from the next document) and the next text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches):
        method = OnePermutation()
        for rows in with_next(batches):
            near = [(i, a[0], a[1], b[1]) for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)) if not a[2]]
            if not near:
                continue
            at = [i for i, *_ in near]
            edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for _, _, t, u in near]
            codes, some = method.codes(pa.array([r[1] for r in rows], pa.string()))
            other, other_some = method.codes(pa.array(edited, pa.string()))
            after = [i + 1 for i in at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for _, d, _, _ in near], pa.int64()),
                    pa.array([len(t) for _, _, t, _ in near], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(method.packed(codes[at], some[at]), pa.string()),
                    pa.array(method.packed(other, other_some), pa.string()),
                    pa.array(method.likeness(codes[at], some[at], other, other_some), pa.float64()),
                    pa.array(method.likeness(codes[at], some[at], codes[after], some[after]), pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(run, ddl)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return benchmark_hits(docs, table(spark, sf_dir, "benchmark"), ["doc_id"]).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


#: (verdict, host, path): fixed rules of the query
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a rule fits label the templates of their hosts; the templates judge the rest."""
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = pages.withColumn("fit", longest_rule(URL_RULES, F.col("host"), F.col("path")))
    judged = template_verdicts(ruled.select("host", "path", (F.col("fit.verdict") == "block").alias("blocked")))
    verdict = F.coalesce("fit.verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return ruled.join(judged, ["host", "path"]).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels outside fold 0, at most a fixed number of either class, and scores every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").filter(fold() != 0).select("doc_id", "toxic"))
    return score_texts(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so every distinct text is encoded once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, work_dir(spark, "token-cache"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text_of(F.col("html")).alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one in 199 (document, run) pairs the run loses a code point, so that there are misspellings; a null id is empty."""
    word = F.col("word")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    changed = F.when(h % 199 == 0, F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length(word)))).otherwise(word)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(word_counts(docs, change=changed)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_near_duplicates, op3_benchmark_decontamination, op4_url_filter, op5_katz_scores, op6_substring_dedup, op7_toxicity, op8_token_counts, op9_bpe_round_trip, op10_license_scan, op11_main_text, op12_spelling_variants, op13_lexical_search)
}
ORACLES: dict[str, str] = {
    "op2_near_duplicates": oracles.NEAR_DUPLICATES, "op3_benchmark_decontamination": oracles.DECONTAMINATION, "op6_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op13_lexical_search": oracles.LEXICAL_SEARCH,
}
