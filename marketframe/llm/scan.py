"""Run a scan over whole texts inside Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage

Scan = Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, dict]]]

#: The columns of the documents table.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def fields(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def give_back() -> None:
    """Workers live on between tasks: what a task has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _with_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``text`` of a ``row`` beside it, without a copy, where it does not travel as a column of its own."""
    for batch in batches:
        yield batch if "text" in batch.schema.names else batch.append_column("text", batch.column("row").field("text"))


def scan_texts(df: DataFrame, scan: Scan, new: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` and those that ``scan`` adds to each part of a batch (DDL ``new``).

    The scan finds texts in ``text``; a ``df`` without that column has them in its struct ``row``.
    """
    added = fields(new)
    schema = T.StructType([df.schema[c] for c in keep] + list(added))
    arrow = to_arrow_schema(schema)
    names = [f.name for f in added]

    def run(batches):
        for part, out in scan(_with_text(batches) if "row" in keep else batches):
            columns = [part.column(c) for c in keep] + [out[n] for n in names]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=arrow.names).cast(arrow)
        give_back()

    return df.mapInArrow(run, schema)


def as_row(docs: DataFrame) -> DataFrame:
    """Every row whole in ``row``: extra columns of any name pass through a scan, and a text travels once."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def with_row(docs: DataFrame) -> DataFrame:
    """``as_row`` beside the row's text and id."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def with_key(docs: DataFrame) -> DataFrame:
    """``with_row`` and a ``key`` of each row, ascending with its place, that is the same at every reading.

    Rows of Parquet files are known by their file and place in it, so no text is written again; other
    rows, or ones that were multiplied after reading, get their keys in a stored copy.
    """
    if "_metadata" not in docs.columns:
        try:
            at = with_row(docs).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        except AnalysisException:
            at = None
        if at is not None:
            names = sorted(r["file"] for r in at.select("file").distinct().toLocalIterator())
            files = docs.sparkSession.createDataFrame(pa.table({"file": pa.array(names, pa.string()), "base": pa.array([i << 40 for i in range(len(names))], pa.int64())}))  # a list would start Python workers of another kind
            keyed = at.join(F.broadcast(files), "file").select("row", "doc_id", "text", (F.col("base") + F.col("place")).alias("key"))
            if keyed.groupBy("key").count().filter("count > 1").isEmpty():
                return keyed
    return cut_lineage(with_row(docs).withColumn("key", F.monotonically_increasing_id()), "keyed")
