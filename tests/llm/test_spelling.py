"""Near words against a comparison of all pairs, the query against plain counting."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from marketframe.llm import queries, spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def plain_variants(n: dict[str, int]) -> set:
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = set()
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.add((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df) -> set:
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


SCHEMA = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, seed):
    rnd = random.Random(seed)
    n = {"".join(rnd.choice("abé") for _ in range(rnd.randint(2, 9))): rnd.choice([1, 2, 5, 10, 30, 200]) for _ in range(500)}
    assert found(spelling.variants(spark.createDataFrame(list(n.items()), SCHEMA))) == plain_variants(n)


def test_long_words_and_large_groups(spark, monkeypatch):
    """Parts of long words hold more than the alphabet; groups that grow are cut finer, blocks are small."""
    monkeypatch.setattr(spelling, "LARGE", 20)
    rnd = random.Random(9)
    stem = "".join(rnd.choice("abcdefgh") for _ in range(70))
    n = {stem[:30] + "".join(rnd.choice("xyz") for _ in range(7)) + stem[30:]: rnd.randint(1, 90) for _ in range(250)}
    for w in list(n)[:60]:
        k = rnd.randrange(len(w))
        n.setdefault(w[:k] + rnd.choice(["", "q", "qq"]) + w[k + 1 :], rnd.randint(1, 500))
    n["".join(rnd.choice("abcdefgh") for _ in range(30_000))] = 5
    words = spark.createDataFrame(list(n.items()), SCHEMA)
    assert spelling.groups(words).groupBy("key").count().agg({"count": "max"}).first()[0] < 60
    assert found(spelling.variants(words)) == plain_variants(n)


def test_small_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    n = {"".join(rnd.choice("ab") for _ in range(rnd.randint(5, 8))): rnd.choice([1, 5, 40]) for _ in range(200)}
    words = spark.createDataFrame(list(n.items()), SCHEMA)
    dealt = spelling.groups(words).coalesce(1).sortWithinPartitions("size", "key").select("size", "key", "lo", "hi", "word", "n").toArrow()
    whole = Counter()
    monkeypatch.setattr(spelling, "BLOCK", 50)
    for tile in spelling._tiles(dealt.to_batches(max_chunksize=7)):
        for r in tile.to_pylist():
            whole[r["word"]] += r["near"]
    assert whole == {w: k for w, _, _, _, k, _ in plain_variants(n) if k}


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, tmp_path):
    """Nulls, empty texts, repeated rows, capitals, other letters and a column of a clashing name."""
    rnd = random.Random(2)
    stock = ["".join(rnd.choice(["er", "on", "th", "é", "ß", "Ö", "a"]) for _ in range(rnd.randint(2, 6))) for _ in range(60)]
    docs = [(i, " ".join(rnd.choice(stock[: 5 + i % 55]).title() if rnd.random() < 0.1 else rnd.choice(stock[: 5 + i % 55]) for _ in range(120)) + " 12x,") for i in range(150)]
    docs += [docs[3], docs[3], (None, docs[4][1]), (7, None), (8, ""), (9, "ab1cdefghi-jklmno ÷×÷×÷×")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "word", "n")]])
    spark.createDataFrame([(*d, "clash", "n") for d in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 6
    got = found(queries.op12_spelling_variants(spark, str(tmp_path)))
    assert got == plain_variants({w: n for w, n in counts.items() if n >= 5})
    assert any(form for _, form, *_ in got)
