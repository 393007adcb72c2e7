"""Append-only Parquet archive of bars and settles, with revisions kept and repeats skipped.

A row is identified by its content hash: the same key with another hash is a revision and both stay.
Writing again what is already stored changes nothing, so a failed job can simply be run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.consensus import state_rank

BAR_KEY = ["contract", "ts", "resolution", "sha"]
BAR_PARTS = ["root", "resolution", "year", "month"]
SETTLE_KEY = ["contract", "as_of_date", "settle_state", "sha"]
SETTLE_PARTS = ["root", "year"]
TEXT_PARTS = ("root", "resolution")


@dataclass(frozen=True)
class WriteResult:
    rows_written: int
    rows_skipped: int


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The archive at ``path``, or None where nothing was written yet.

    Folder names of text columns are read as text: a resolution ``1d`` is not the number 1.
    """
    try:
        found = spark.read.parquet(path)
        schema = StructType([StructField(f.name, StringType()) if f.name in TEXT_PARTS else f for f in found.schema])
        return found if schema == found.schema else spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _observed(o: Observation) -> int | None:
    try:
        return o.get["n"]
    except Py4JJavaError:
        return None


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by the given order."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*key, "__row.*").select(*df.columns)


#: A batch that touches more partitions than this is compared with all stored keys.
LISTED_PARTITIONS = 2_000


def new_rows(submitted: DataFrame, existing: DataFrame | None, key: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Submitted rows whose key is not stored; a null key part equals a null.

    The batch's partition values become literals, so the scan of stored keys opens only their folders.
    """
    if existing is None:
        return submitted
    touched = submitted.select(*parts).distinct().limit(LISTED_PARTITIONS + 1).collect()
    if len(touched) <= LISTED_PARTITIONS:
        for p in parts:
            values = sorted({r[p] for r in touched} - {None})
            has_null = any(r[p] is None for r in touched)
            within = F.col(p).isin(values) if values else F.lit(False)
            existing = existing.filter(within | F.col(p).isNull() if has_null else within)
    on = list(dict.fromkeys([*parts, *key]))
    known = existing.select(*[F.col(c).alias(f"__k_{c}") for c in on])
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}").cast(submitted.schema[c].dataType)) for c in on]
    return submitted.join(known, reduce(lambda a, b: a & b, same), "left_anti")


def archive_root(contract: Column) -> Column:
    """The contract without its last three characters, whatever they are: the rule of writer and readers."""
    return F.when(F.length(contract) > 3, F.substring(contract, F.lit(1), F.length(contract) - 3))


def root_filter(contract: str) -> Column:
    return F.col("root") == contract[:-3] if len(contract) > 3 else F.col("root").isNull()


def append_new(df: DataFrame, path: str, key: Sequence[str], parts: Sequence[str], order: Sequence[str], sort: Sequence[str]) -> WriteResult:
    """Store the rows of ``df`` that are new. Large partitions are split over files by AQE."""
    spark = df.sparkSession
    seen, fresh = Observation(), Observation()
    submitted = keep_last(df.observe(seen, F.count(F.lit(1)).alias("n")), key, order)
    new = new_rows(submitted, stored(spark, path), key, parts).hint("rebalance", *parts)
    new = new.sortWithinPartitions(*parts, *sort).observe(fresh, F.count(F.lit(1)).alias("n"))
    new.write.mode("append").partitionBy(*parts).parquet(path)
    written, total = _observed(fresh), _observed(seen)
    if written is None or total is None:
        # nothing was new: AQE cut the plan down to an empty one and its counters with it
        written, total = 0, df.count()
    return WriteResult(written, total - written)


def with_bar_parts(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"root": archive_root(F.col("contract")), "year": F.year("ts"), "month": F.month("ts")})


def with_settle_parts(settles: DataFrame) -> DataFrame:
    return settles.withColumns({"root": archive_root(F.col("contract")), "year": F.year("as_of_date")})


def write_bars(bars: DataFrame, path: str) -> WriteResult:
    return append_new(with_bar_parts(bars), f"{path}/bars", BAR_KEY, BAR_PARTS, ["as_of"], ["ts", "sha"])


def write_settles(settles: DataFrame, path: str) -> WriteResult:
    return append_new(with_settle_parts(settles), f"{path}/settles", SETTLE_KEY, SETTLE_PARTS, ["as_of"], ["as_of_date", "sha"])


def read_bars(spark: SparkSession, path: str, contract: str, resolution: str, start: str, end: str, inclusive_end: bool = False) -> DataFrame:
    """Bars of one contract in [start, end) or [start, end], ordered by time and hash.

    Year and month limits are derived from the window, so files outside it are not opened.
    """
    df = stored(spark, f"{path}/bars")
    if df is None:
        from ..schemas import SCHEMAS

        return spark.createDataFrame([], SCHEMAS["bar"])
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    ym = F.col("year") * 100 + F.col("month")
    df = df.filter(root_filter(contract) & (F.col("resolution") == resolution))
    df = df.filter((ym >= int(start[:4]) * 100 + int(start[5:7])) & (ym <= int(end[:4]) * 100 + int(end[5:7])))
    until = F.col("ts") <= hi if inclusive_end else F.col("ts") < hi
    return df.filter((F.col("contract") == contract) & (F.col("ts") >= lo) & until).orderBy("ts", "sha")


def read_settles(spark: SparkSession, path: str, contract: str, first: str, last: str) -> DataFrame:
    """Settles of one contract from ``first`` to ``last``, both included, in canonical order."""
    if last < first:
        raise ValueError("last day before first day")
    df = stored(spark, f"{path}/settles")
    if df is None:
        from ..schemas import SCHEMAS

        return spark.createDataFrame([], SCHEMAS["settle"])
    df = df.filter(root_filter(contract) & F.col("year").between(int(first[:4]), int(last[:4])))
    df = df.filter((F.col("contract") == contract) & F.col("as_of_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return df.orderBy("as_of_date", state_rank(F.col("settle_state")), "sha")


def register(spark: SparkSession, path: str) -> list[str]:
    """Expose the archive as temporary views ``bars`` and ``settles``; returns those that exist."""
    found = []
    for name in ("bars", "settles"):
        df = stored(spark, f"{path}/{name}")
        if df is not None:
            df.createOrReplaceTempView(name)
            found.append(name)
    return found


def query(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """Any SQL query over the registered views, with named parameters (``:name``).

    The text is read as a subquery, so statements that write or change anything do not parse.
    """
    return spark.sql(f"SELECT * FROM (\n{text.strip().rstrip(';')}\n)", args=args or {})


def query_table(spark: SparkSession, path: str, table: str, select: str = "*", where: str | None = None, args: dict | None = None) -> DataFrame:
    """``SELECT select FROM table [WHERE where]``; an archive without the table gives an empty frame."""
    if table not in register(spark, path):
        return spark.createDataFrame([], "empty string").drop("empty")
    return query(spark, f"SELECT {select} FROM {table}" + (f" WHERE {where}" if where else ""), args)
