"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("marketframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for tables, sinks and stream checkpoints of one run.

    Taken under ``spark.checkpoint.dir``, the shared folder the cluster names. Only a local
    session without that setting falls back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.applicationId in _LOCAL:
        base = _LOCAL[spark.sparkContext.applicationId]
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(base, f"{label}-{uuid.uuid4().hex[:12]}")


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark drops the shuffle files of what is written meanwhile, once it is written.

    Otherwise they lie on the executors' disks until the driver happens to collect garbage.
    """
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP)
        else:
            spark.conf.set(_DROP, before)


def cut_lineage(df, label: str = "cut"):
    """Write ``df`` to the shared work folder and read it back.

    Used where several branches read one expensive result: the table survives lost executors,
    which a cached or locally checkpointed frame does not.
    """
    path = work_dir(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df, *columns):
    """Deal rows by columns over all shuffle partitions.

    For few and small rows from which many are made next: a number of partitions that is given is one
    that adaptive execution does not merge.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
