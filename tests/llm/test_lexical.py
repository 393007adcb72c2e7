"""Rankings against a plain version: ties, repeated rows, null ids, long texts, many shards and bundles."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import types as T

from marketframe.llm import lexical, oracles, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_ranking(docs, items, top):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    number, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b, n in bags:
            m = 50 + 50 * n * number // length
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def frame(spark, rows, name):
    fields = [T.StructField(name, T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "score", "key", "term")]]
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], T.StructType(fields))


def corpus(seed, n=260):
    rnd = random.Random(seed)
    stock = ["the", "of", "AND", "é", "1st"] + ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(120)]
    text = lambda k: " ".join(stock[min(int(rnd.expovariate(0.06)), len(stock) - 1)] + rnd.choice(["", ",", "-x"]) for _ in range(k))
    docs = [(i, text(rnd.randint(1, 60))) for i in range(n)]
    docs += [docs[3]] * 40 + [(d + 1000, t) for d, t in docs[:70]] + [(None, docs[5][1]), (None, docs[5][1]), (400, None), (401, ""), (402, " .-"), (403, text(20_000))]
    items = [(i, text(rnd.randint(1, 30))) for i in range(25)] + [(50, docs[3][1]), (50, docs[3][1]), (None, text(5)), (51, None), (52, ""), (53, "unheard zzzzzz"), (54, text(3000))]
    return docs, items


@pytest.mark.parametrize("shard, bundle, top", [(4096, 256, 50), (16, 5, 7), (50, 256, 1)])
def test_plain_ranking(spark, monkeypatch, shard, bundle, top):
    """Equal rows that straddle the last rank may take either place, so rows are compared as a multiset."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", bundle)
    docs, items = corpus(shard)
    got = lexical.ranked(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), top)
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == plain_ranking(docs, items, top)


def test_small_filter_lets_terms_through(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FILTER_MOST", 64)
    docs, items = corpus(1, 60)
    got = lexical.ranked(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), 5)
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == plain_ranking(docs, items, 5)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty(spark, docs, items):
    assert lexical.ranked(frame(spark, docs, "doc_id"), frame(spark, items, "item_id")).count() == 0


def test_query_and_sql(spark, tmp_path):
    docs, items = corpus(8)
    frame(spark, docs, "doc_id").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, items, "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op13_lexical_search(spark, str(tmp_path))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = Counter(db.execute(f"SELECT item_id, rank, doc_id, score FROM ({oracles.LEXICAL_SEARCH})").fetchall())
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want == plain_ranking(docs, items, 50)
