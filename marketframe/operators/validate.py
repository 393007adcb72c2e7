"""Rule checks over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import rules


def check(df: DataFrame, kind: str) -> DataFrame:
    """Add ``broken``: the names of the rules a row violates."""
    tests = F.array(*[F.when(test, F.lit(name)) for name, test in rules(kind).items()])
    return df.withColumn("broken", F.filter(tests, lambda x: x.isNotNull()))


def split(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with what is wrong."""
    c = check(df, kind)
    return c.filter(F.size("broken") == 0).drop("broken"), c.filter(F.size("broken") > 0)


def require(df: DataFrame, kind: str) -> DataFrame:
    """Fail the job on the first invalid row."""
    c = check(df, kind)
    ok = F.when(F.size("broken") > 0, F.raise_error(F.concat_ws(", ", F.lit(kind), "broken"))).otherwise(F.lit(True))
    return c.filter(ok).drop("broken")


def header_signature(headers: Column) -> Column:
    """Hash of an ordered header list."""
    return F.sha2(F.to_json(headers), 256)


def schema_drift(df: DataFrame, expected: str) -> dict[str, list[str]]:
    """Columns missing from, added to, or typed unlike a DDL schema. Looks at metadata only."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(expected).fields}
    have = dict(df.dtypes)
    return {
        "missing": sorted(set(want) - set(have)),
        "added": sorted(set(have) - set(want)),
        "changed": sorted(c for c in want if c in have and want[c] != have[c]),
    }
