"""License lines in documents by diagonal voting, in DataFrame operations only.

All rolling word pairs of the documents meet the pairs of the templates in one hash join against a table
of fixed size. A match of document place p with template place t votes for the diagonal p - t. Diagonals
at most ``spread`` apart (words added or left out) merge, and a span holds if an ordered alignment, place
and template place both rising, reaches enough of the template's pairs; matches are compared word by word,
not by hash alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases that must stand word by word: (label, phrase).
BASE_PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Lines that are found with gaps too: (label, line).
LICENSE_LINES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license"),
]


def words_of(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters; A-Z are lower-cased, and letters that no phrase has."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _pairs(words: Column) -> Column:
    """Each word with the next one (null after the last)."""
    return F.zip_with(words, F.slice(words, 2, 2**30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def template_pairs(spark: SparkSession, phrases: list[tuple[str, str, bool]]) -> DataFrame:
    """One row per place of a phrase (label, words, whether it must be whole) with its pair's hash."""
    rows = []
    for number, (label, phrase, whole) in enumerate(phrases):
        w = phrase.split(" ")
        rows += [(number, label, whole, len(w) - 1, t, w[t], w[t + 1]) for t in range(len(w) - 1)]
    made = spark.createDataFrame(rows, "template int, label string, whole boolean, pairs int, t int, ta string, tb string")
    return made.withColumn("hash", F.xxhash64("ta", "tb"))


def _aligned(matches: Column, pairs: Column) -> Column:
    """(n, start, end) of the longest alignment of ``matches`` (place, back = -t) in order of place, then of back.

    The state holds the longest alignment that ends at each template place; of equal ones the later start,
    hence the shorter span, stays. Later places of the template come first at one place of the text, so no
    place serves twice.
    """
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(best, m):
        t, place = -m["back"], m["place"]
        before = F.array_max(F.slice(best, F.lit(1), t))  # null at the first place
        n, start = F.coalesce(before["n"], F.lit(0)), F.coalesce(before["start"], F.lit(0))
        here = F.struct((n + 1).alias("n"), F.when(n > 0, start).otherwise(place).alias("start"), place.alias("end"))
        return F.transform(best, lambda old, at: F.when(at == t, F.greatest(old, here)).otherwise(old))

    return F.aggregate(matches, F.array_repeat(none, pairs), step, F.array_max)


def license_matches(docs: DataFrame, base: list[tuple[str, str]] = BASE_PHRASES, lines: list[tuple[str, str]] = LICENSE_LINES, spread: int = 6, share: float = 0.7) -> DataFrame:
    """One row per span found: doc_id, digest (of the text), label, whole, start, coverage.

    ``base`` phrases of two words or more are found exactly: ``start`` is the place of their first word.
    ``lines`` are found where at least ``share`` of their pairs stand in order, on diagonals at most
    ``spread`` apart; ``coverage`` is that share, and spans of one line that overlap are one. Rows that
    repeat an id and a text share their spans. ``base`` and ``lines`` are short lists: their pairs are
    broadcast, and a span has at most (spread + 1) * pairs matches.
    """
    spark = docs.sparkSession
    phrases = [(n, p, True) for n, p in base] + [(n, p, False) for n, p in lines]
    if any(len(p.split(" ")) < 2 for _, p, _ in phrases):
        raise ValueError("a phrase needs two words or more")
    pairs = docs.select("doc_id", text_digest().alias("digest"), F.posexplode(_pairs(words_of(F.col("text")))).alias("place", "p"))
    hashed = pairs.select("doc_id", "digest", "place", "p.a", "p.b", F.xxhash64("p.a", "p.b").alias("hash"))
    met = hashed.join(F.broadcast(template_pairs(spark, phrases)), "hash").filter((F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")))
    votes = met.groupBy("doc_id", "digest", "template", "label", "whole", "pairs", (F.col("place") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("places"))
    one = ["doc_id", "digest", "template"]
    near = F.collect_list(F.struct("diagonal", "places")).over(Window.partitionBy(*one).orderBy("diagonal").rangeBetween(0, spread))
    own = F.array(F.struct("diagonal", "places"))
    spans = votes.withColumn("near", near).withColumn("near", F.when(F.col("whole"), own).otherwise(F.col("near")))
    needed = F.when(F.col("whole"), 1.0).otherwise(share) * F.col("pairs")
    enough = F.size(F.array_distinct(F.flatten(F.transform("near", lambda d: d["places"])))) >= needed
    match = lambda d: F.transform(d["places"], lambda t: F.struct((d["diagonal"] + t).alias("place"), (-t).alias("back")))
    matches = F.array_sort(F.flatten(F.transform("near", match)))
    verified = spans.filter(enough).withColumn("span", _aligned(matches, F.col("pairs"))).filter(F.col("span.n") >= needed)
    order = Window.partitionBy(*one).orderBy("span.start", "span.end", "diagonal")
    past = F.max("span.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("whole") | past.isNull() | (F.col("span.start") > past)
    islands = verified.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = islands.groupBy(*one, "label", "whole", "pairs", "island").agg(F.max(F.struct("span.n", (-F.col("span.start")).alias("back"))).alias("best"))
    return best.select("doc_id", "digest", "label", "whole", (-F.col("best.back")).cast("long").alias("start"), (F.col("best.n") / F.col("pairs")).alias("coverage"))


def text_digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def scan_licenses(docs: DataFrame, base: list[tuple[str, str]] = BASE_PHRASES, lines: list[tuple[str, str]] = LICENSE_LINES) -> DataFrame:
    """For every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a phrase or line that one span holds in order, 0 without any. Null and empty
    texts have no words; repeated rows are judged alike; a null id is an id of its own; an empty table
    gives no rows.
    """
    found = license_matches(docs, base, lines)
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))  # noqa: E731  as many as there are labels at most
    whole = F.when(F.col("whole"), F.col("start"))
    summed = found.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("key")).agg(
        F.count_if("whole").alias("n_base"), F.min(whole).alias("first_word"), F.max(whole).alias("last_word"),
        joined(F.when(F.col("whole"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("coverage").alias("score"),
    )
    each = docs.select("doc_id", text_digest().alias("digest"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return each.join(summed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("key")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
