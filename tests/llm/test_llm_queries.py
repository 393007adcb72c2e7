"""The registered queries on a small corpus against plain versions, and on empty tables."""

from __future__ import annotations

import random
from collections import Counter

import brute
import public_tokenizers
import pytest

import corpus_pipeline
from marketframe.llm import license_scan, queries
from marketframe.llm.substring_dedup import remove_repeats
from marketframe.llm.token_cache import CACHE, count_tokens

Q = queries.QUERIES


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def sorted_docs(docs):
    return sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_op1(spark, small, corpus):
    docs = sorted_docs(corpus[0])
    got = Q["op1_fingerprints"](spark, small).collect()
    want, alike = Counter(), {}
    for i, (d, t) in enumerate(docs):
        t, after = t or "", docs[(i + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want[(d, len(t), brute.sha(edited))] += 1
        a, b, c = brute.shingles(t), brute.shingles(edited), brute.shingles(after)
        alike[(d, brute.sha(edited))] = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    for r in got:
        edited, after = alike[(r.doc_id, r.edited_sha256)]
        assert abs(r.near_edited - edited) < 0.2 and abs(r.near_next - after) < 0.2 and 0 <= r.near_next <= 1
    by_text = {}
    for r in got:
        text = [t for d, t in docs if d == r.doc_id]
        if len(set(text)) == 1:
            assert by_text.setdefault(brute.low(text[0]) if text[0] else "", r.fingerprint) == r.fingerprint
    assert {r.fingerprint for r in got if r.doc_id in (3000, 3001, 3002)} == {""}


def test_op2(spark, small, corpus):
    assert rows(Q["op2_near_duplicates"](spark, small), "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(corpus[0])


def test_op3(spark, small, corpus):
    items = [(i, t) for i, t in corpus[1] if i is not None]
    got = rows(Q["op3_benchmark_decontamination"](spark, small), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contamination(corpus[0], items)


def test_op4(spark, small):
    got = {r.page_id: r for r in Q["op4_url_filter"](spark, small).collect()}
    assert len(got) == 101
    assert [tuple(got[i])[1:5] for i in range(9)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.org", "/x", "org/", "allow"), ("a.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("b.com", "", None, "allow"), ("b.com", "/fr/1", "com/fr/", "allow"), ("b.com", "/fr/2", "com/fr/", "allow"),
    ]
    assert {(r.path[:4], r.template, r.verdict) for r in got.values() if r.host == "c.com" and r.rule} == {("/de/", "/de/*", "block"), ("/fr/", "/fr/*", "allow")}


def test_op5(spark, small, corpus):
    got = Q["op5_katz_scores"](spark, small).collect()
    want = brute.unigram_scores(corpus[0])
    assert Counter(tuple(r)[:5] for r in got) == Counter(w[:5] for w in want)
    assert sorted(round(r.base_score, 6) for r in got) == sorted(round(w[5], 6) for w in want)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_op6(spark, small, corpus):
    want = Counter((d, n, gone, brute.sha(text)) for d, n, gone, text in brute.without_repeats(corpus[0]))
    assert rows(Q["op6_substring_dedup"](spark, small), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op7(spark, small, corpus):
    got = Q["op7_toxicity"](spark, small).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in corpus[0])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (brute.fold(r.doc_id) == 0) for r in got)
    texts = dict(corpus[0])
    scored = [(r.score, any(s in texts[r.doc_id] for s in ("stupid", "idiot", "worthless", "trash"))) for r in got if r.doc_id is not None and r.doc_id < 270]
    bad, good = [s for s, x in scored if x], [s for s, x in scored if not x]
    assert sum(a > b for a in bad for b in good) > 0.9 * len(bad) * len(good)


def test_op8(spark, small, corpus):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((d, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for d, t in corpus[0])
    assert rows(Q["op8_token_counts"](spark, small), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_op9(spark, small, corpus):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in corpus[0]:
        ids = model.encode(t or "", add_special_tokens=False).ids
        want[(d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(model.decode(ids, skip_special_tokens=False)))] += 1
    assert rows(Q["op9_bpe_round_trip"](spark, small), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op10(spark, small, corpus):
    got = Q["op10_license_scan"](spark, small)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == brute.license_phrases(corpus[0])
    found = {(d, t): brute.license_lines(t, license_scan.LICENSE_LINES, 6, 0.7) for d, t in corpus[0]}
    bases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    want = Counter()
    for d, t in corpus[0]:
        words = " " + " ".join(brute.LETTERS.findall(brute.low(t))) + " "
        held = found[d, t] | {n: 1.0 for n, p in bases.items() if f" {p} " in words}
        want[d, ",".join(sorted(held)), round(max(held.values(), default=0.0), 9)] += 1
    assert Counter((r.doc_id, r.labels, round(r.score, 9)) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).count() == 0


def test_pipeline(spark, small, corpus):
    """Every stage keeps what a plain version keeps of that stage's input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = f"{small}/stage-{name}"
        stage(spark, docs, small).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        after = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "toxicity":
            assert not after - Counter(before)
        elif name == "minhash_near_dedup":
            kept = {d for (d, _, _, k) in brute.near_duplicates(before) if k}
            assert {d for d, _ in after} - {None} == kept and max(n for (d, _), n in after.items() if d is not None) == 1
            assert sum(n for (d, _), n in after.items() if d is None) == sum(d is None for d, _ in before)
        elif name == "substring_dedup":
            assert after == Counter((d, kept if gone else t) for (d, t), (_, _, gone, kept) in zip(before, brute.without_repeats(before), strict=True))
        else:
            items = [(i, t) for i, t in corpus[1] if i is not None]
            bad = {d for (d, *_, c) in brute.contamination(before, items) if c}
            assert after == Counter(r for r in before if r[0] not in bad)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert Counter(r.doc_id for r in last) == Counter(d for d, _ in after.elements())
    assert Counter((r.doc_id, r.decoded_sha256) for r in last) == Counter((d, brute.sha(t or "")) for d, t in after.elements())
    assert all(len(r.ids) == r.n_tokens for r in last)


def test_near_stage_judges_rows(spark):
    """A clean text under a repeated id stays; copies without an id merge; of equal ids one row stays."""
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base + " more", " ".join(f"x{i}" for i in range(30))
    docs = [(1, base), (5, near), (5, other), (None, other + " y"), (None, base), (7, ""), (7, None), (None, ""), (None, " "), (9, other.upper()), (11, "alone here"), (11, "alone here")]
    rows_in = spark.createDataFrame([(d, t, "clash", "k") for d, t in docs], "doc_id long, text string, key string, row string")
    got = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, rows_in, "")
    assert got.columns == rows_in.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept[(7, "")] + kept[(7, None)] == 1
    assert Counter({k: n for k, n in kept.items() if k[0] != 7}) == Counter([(1, base), (5, other), (None, ""), (None, " "), (11, "alone here")])


def test_pipeline_runs_whole(spark, small, empty):
    assert corpus_pipeline.run(spark, small).count() > 40
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, small, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = Q[name](spark, small)
    res = db.execute(queries.ORACLES[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got, *columns) == Counter(res.fetchall())


def test_op10_spans_hold_in_order(spark):
    rnd = random.Random(5)
    line = "licensed under the apache license version 2 0".split()
    texts = ["license version " * 5, "the license " * 6, "of the terms " * 6, " ".join(line), " ".join(line[:4] + ["cool"] + line[4:]), " ".join(line[4:] + line[:4])]
    texts += [" ".join(line) + " " + " ".join(line), " ".join(x for x in line for _ in range(1 + (rnd.random() < 0.2)))]
    vocabulary = sorted({w for _, x in license_scan.LICENSE_LINES for w in x.split()})
    for _ in range(60):
        w = rnd.choice(license_scan.LICENSE_LINES)[1].split() + rnd.choice(license_scan.LICENSE_LINES)[1].split()
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 2)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = [(f"{n}:{i}", x) for i, (n, x) in enumerate(license_scan.LICENSE_LINES)]
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in license_scan.scan_licenses(docs, [], lines).collect()}
    for i, t in enumerate(texts):
        held = brute.license_lines(t, lines, 6, 0.7)
        assert got[i] == (",".join(sorted(held)), round(max(held.values(), default=0.0), 9)), t
    assert [got[i][0] for i in range(3)] == ["", "", ""] and got[3] == ("apache:0", 1.0)
    assert license_scan.license_matches(docs.filter("doc_id = 6"), [], lines).filter("label = 'apache:0'").count() == 2


def test_op8_cache(spark, tmp_path):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(None, "one text")] * 500 + [(7, "another text")] * 300, "doc_id long, text string")
    cache = str(tmp_path / "cache")
    first = Counter(map(tuple, count_tokens(docs, cache, path).collect()))
    stored = spark.read.parquet(cache)
    assert stored.count() == 2 and sum(first.values()) == 800
    assert Counter(map(tuple, count_tokens(docs, cache, path).collect())) == first and spark.read.parquet(cache).count() == 2
    grown = docs.unionByName(spark.createDataFrame([(8, "a new text")], "doc_id long, text string"))
    count_tokens(grown, cache, path)
    assert spark.read.parquet(cache).count() == 3
    count_tokens(grown, cache, public_tokenizers.path("word_bpe_49k.json"))
    assert spark.read.parquet(cache).count() == 6
    doubled = spark.read.parquet(cache).collect()  # an append that was done twice
    spark.createDataFrame(doubled, CACHE).write.mode("append").parquet(cache)
    assert Counter(map(tuple, count_tokens(docs, cache, path).collect())) == first


def test_op6_rows_that_repeat_id_and_text(spark):
    words = " ".join(f"w{i % 50}" for i in range(90))
    docs = spark.createDataFrame([(3, words)] * 3000 + [(4, "short")], "doc_id long, text string")
    got = Counter(map(tuple, remove_repeats(docs, ["doc_id"]).select("doc_id", "n_words", "n_removed", "kept").collect()))
    assert got == {(3, 90, 90, ""): 3000, (4, 1, 0, "short"): 1}
