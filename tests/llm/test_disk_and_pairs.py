"""What the operators write besides their results, and how many candidate pairs they make."""

from __future__ import annotations

import glob
import random
import tempfile
import time
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from marketframe import session
from marketframe.llm import katz, near_dedup
from marketframe.session import cut_lineage


def test_stored_steps_leave_no_shuffle_files(spark):
    def files():
        return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))

    before, setting = files(), spark.conf.get(session._DROP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert len(cut_lineage(df).collect()) == 7
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(session._DROP, None) == setting


def test_near_stage_reads_stored_texts_where_they_lie(spark, small, monkeypatch):
    """Rows of files are keyed by place and not copied; rows multiplied after reading are."""
    labels, work_dir = [], session.work_dir
    monkeypatch.setattr(session, "work_dir", lambda s, label: labels.append(label) or work_dir(s, label))
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = Counter((r.doc_id, r.text) for r in stage(spark, docs, "").collect())
    assert "signatures" in labels and "keyed" not in labels
    again = Counter((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame(docs.collect(), docs.schema), "").collect())
    assert "keyed" in labels and {d for d, _ in got} == {d for d, _ in again} and sum(got.values()) == sum(again.values())
    labels.clear()
    twice = docs.withColumn("n_words", F.explode(F.array(F.lit("a"), F.lit("b"))))
    assert {d for d, _ in got} == {r.doc_id for r in stage(spark, twice, "").collect()}
    assert "keyed" in labels


def test_large_near_group_makes_one_candidate_per_text(spark, monkeypatch):
    """Near copies whose buckets have many smallest members are not compared with each of these."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for i in rnd.sample(range(1000), 150):
        w = list(base)
        for at in rnd.sample(range(400), 3):
            w[at] = f"x{i}-{at}"
        docs.append((i, " ".join(w)))
    made = []

    def counted(df, label="cut"):
        out = cut_lineage(df, label)
        if label == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "cut_lineage", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: c for d, _, c, _ in brute.near_duplicates(docs)}
    assert len(set(got.values())) == 1 and sum(made) < 2 * len(docs)


def test_katz_counts_take_the_room_of_small_numbers():
    """One large count among many small ones does not widen them; zeros and repeated weights take little."""
    n = np.ones(10_000, np.int64)
    n[5] = 3_000_000_000
    raw = katz._small(n)
    assert len(raw) < 2_000 and (katz._from_small(raw, len(n)) == n).all()
    w = np.zeros(10_000)
    w[::50] = 1 / 3
    raw = katz._reals(w)
    assert len(raw) < 4_000 and (katz._from_reals(raw) == w).all()
    none = np.zeros(0, np.int64)
    assert len(katz._from_small(katz._small(none), 0)) == 0
