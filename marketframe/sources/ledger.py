"""Session ledger as JSON lines beside a table of last states: append, read, running profit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import segmented
from ..operators.rolls import month_of
from ..schemas import SCHEMAS

MONEY = "decimal(28,6)"
SCHEMA = "sleeve string, " + SCHEMAS["session"]


STATE = f"sleeve string, session_date date, cumulative_pnl {MONEY}, batch int, slot int"


def _read(spark: SparkSession, schema: str, form: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The log with typed amounts and the number of the append (``batch``, a folder) that wrote each row."""
    money = {c: F.col(c).cast(MONEY) for c in ("entry_price", "exit_price", "session_pnl", "cost", "cumulative_pnl")}
    return _read(spark, SCHEMA + ", batch int", "json", path).withColumns(money)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All sessions with typed amounts; an absent ledger is empty."""
    return _log(spark, path).drop("batch")


def _state_path(path: str) -> str:
    return path.rstrip("/") + ".last"


def last_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Last session_date and cumulative_pnl of each sleeve, the last append they know, and the slot to write next.

    Read from the newer of two state tables beside the log; of the log only appends after that one are
    read, of which there are none unless a job ended between its two writes.
    """
    both = _read(spark, STATE, "parquet", _state_path(path))
    newer = both.agg(F.max(F.struct("batch", "slot"))).first()[0]
    known, slot = newer or (-1, 1)
    tail = _log(spark, path).filter(F.col("batch") > known)
    newest = tail.agg(F.max("batch")).first()[0]
    # a folder: the other slot's files are not read, and may be overwritten meanwhile
    rows = both.filter(F.col("slot") == slot).select("sleeve", "session_date", "cumulative_pnl")
    if newest is None:
        return rows, known, 1 - slot
    rows = rows.unionByName(tail.select("sleeve", "session_date", "cumulative_pnl"))
    return _latest(rows), newest, 1 - slot


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sleeve").agg(F.max("session_date").alias("session_date"), F.max_by("cumulative_pnl", "session_date").alias("cumulative_pnl"))


def _keep_state(spark: SparkSession, path: str, before: DataFrame, batch: int, slot: int) -> None:
    """Write the state after append ``batch`` to the slot that does not hold the state before it."""
    added = _log(spark, path).filter(F.col("batch") == batch).select("sleeve", "session_date", "cumulative_pnl")
    _latest(before.unionByName(added)).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{_state_path(path)}/slot={slot}")


def record_sessions(sessions: DataFrame, path: str, strict: bool = True) -> DataFrame:
    """Append sessions (sleeve, session_date, qualified, contracts, prices, session_pnl, cost).

    Cumulative profit continues from what is stored. A date that repeats or does not come after the
    sleeve's last stored one fails when strict, else the row is left out. Returns the appended rows.

    An append is a folder of the log and reads one row per sleeve, not the log. Appends to one ledger
    follow each other; a job that fails before its log folder is committed leaves the ledger as it was.
    """
    spark = sessions.sparkSession
    known, batch, slot = last_sessions(spark, path)
    last = known.select("sleeve", F.col("session_date").alias("__last"), F.col("cumulative_pnl").alias("__carried"))
    s = sessions.join(last, "sleeve", "left")
    s = segmented(s, ["sleeve"], ["session_date"], month_of(F.col("session_date")), {"__before": ("lag", F.col("session_date"))})
    late = (F.col("session_date") <= F.col("__last")) | (F.col("session_date") == F.col("__before"))
    bad = F.coalesce(late, F.lit(False))
    if strict:
        s = s.filter(F.when(bad, F.raise_error(F.lit("session date is not after the last one"))).otherwise(F.lit(True)))
    else:
        s = s.filter(~bad)
    s = segmented(s, ["sleeve"], ["session_date"], month_of(F.col("session_date")), {"__run": ("sum", F.col("session_pnl").cast("decimal(18,6)"))})
    total = (F.col("__run") + F.coalesce("__carried", F.lit(0).cast(MONEY))).cast(MONEY)
    out = s.withColumn("cumulative_pnl", total)
    text = {c: F.col(c).cast("string") for c in ("entry_price", "exit_price", "session_pnl", "cost", "cumulative_pnl")}
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    out.withColumns(text).select(*cols).write.mode("append").json(f"{path}/batch={batch + 1}")
    written = _log(spark, path).filter(F.col("batch") == batch + 1)
    _keep_state(spark, path, known, batch + 1, slot)
    return written.select(*cols)
