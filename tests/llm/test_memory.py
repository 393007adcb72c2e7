"""What the operators hold in the driver and send to Python workers."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm import scan, toxicity


def test_training_brings_no_texts_or_words_to_the_driver(spark, small, monkeypatch):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    for name in ("toArrow", "toPandas", "collect", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **b: pytest.fail("rows in the driver"))
        monkeypatch.setattr(type(docs), name, lambda *a, **b: pytest.fail("rows in the driver"))
    monkeypatch.setattr(toxicity, "train", lambda *a: pytest.fail("training in the driver"))
    monkeypatch.setattr(type(docs), "first", lambda df: seen.append(df.columns))
    seen = []
    with pytest.raises(BaseException, match="training in the driver"):  # without any text there is nothing for a task
        toxicity.learn(docs, labels)
    assert seen == [["weight", "bias"]]


def test_model_does_not_depend_on_partitions(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert a.bias == b.bias and (a.weight == b.weight).all() and a.weight.any()


@pytest.mark.parametrize("stage", ["toxicity", "benchmark_decontamination"])
def test_a_text_travels_once(spark, small, monkeypatch, stage):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen, kind = [], type(docs)
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a, f=kind.mapInArrow, **b: seen.append(df.columns) or f(df, *a, **b))
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(small))
    assert got.columns == docs.columns and got.count() > 0
    assert ["row"] in seen and not [c for c in seen if "row" in c and "text" in c]


def test_keys_by_place_start_no_rdd_workers(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("a list became an RDD of Python"))
    keyed = scan.with_key(docs)
    assert keyed.select(F.count_distinct("key")).first()[0] == docs.count()
