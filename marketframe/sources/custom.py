"""Feeds of the caller's own as Spark data sources, for batch and stream reads.

    spark.dataSource.register(feed_source(LandedFolder(path, SCHEMAS["bar"]), "my_bars"))
    spark.read.format("my_bars").option("starts", "2024-01-01").load()
    spark.readStream.format("my_bars").load()
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FIRST, LAST = "1900-01-01", "2200-01-01"
BATCH_ROWS = 10_000


class Feed:
    """What a feed must offer. An object of it travels to the tasks, so it holds settings, not connections.

    ``schema`` is a DDL string; ``required`` columns may not be null; ``time`` is the column of event time.
    """

    schema: str
    time = "ts"
    required: tuple[str, ...] = ("contract", "ts")

    def latest(self) -> dt.datetime:
        """End (exclusive) of the time for which the feed is complete: what streams may read."""
        raise NotImplementedError

    def slices(self, starts: dt.datetime, ends: dt.datetime) -> Iterable[Any]:
        """Pieces of the window that tasks can read apart. Together they hold each of its rows once."""
        raise NotImplementedError

    def read(self, piece: Any) -> Iterable[pa.RecordBatch]:
        """Rows of one piece, in batches; rows outside the window are left out by the caller."""
        raise NotImplementedError


class LandedFolder(Feed):
    """Parquet files under ``path/day=YYYY-MM-DD/``, one piece per file, on any file system pyarrow can open.

    A day is complete once a later one has landed, or with ``final``.
    """

    def __init__(self, path: str, schema: str, final: bool = False):
        self.path, self.schema, self.final = path, schema, final

    def _opened(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if ":" in self.path else (pafs.LocalFileSystem(), self.path)

    def _days(self) -> list[tuple[dt.datetime, str]]:
        system, root = self._opened()
        found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted((_time(f.base_name[4:]), f.path) for f in found if f.base_name.startswith("day="))

    def latest(self) -> dt.datetime:
        days = self._days()
        if not days:
            return _time(FIRST)
        return days[-1][0] + dt.timedelta(days=int(self.final))

    def slices(self, starts, ends):
        system, _ = self._opened()
        for day, folder in self._days():
            if starts < day + dt.timedelta(days=1) and day < ends:
                for f in system.get_file_info(pafs.FileSelector(folder)):
                    if f.base_name.endswith(".parquet"):
                        yield f.path

    def read(self, piece):
        system, _ = self._opened()
        with system.open_input_file(piece) as f:
            yield from pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(BATCH_ROWS)


def _time(text: str) -> dt.datetime:
    t = dt.datetime.fromisoformat(text)
    return t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t.astimezone(dt.timezone.utc)


_KINDS = (pa.types.is_integer, pa.types.is_floating, pa.types.is_decimal, pa.types.is_timestamp, pa.types.is_date)


def _same_kind(a: pa.DataType, b: pa.DataType) -> bool:
    """Whether a cast only changes width, scale or unit, not what a value means."""
    text = pa.types.is_string, pa.types.is_large_string
    return a == b or any(k(a) and k(b) for k in _KINDS) or (any(k(a) for k in text) and any(k(b) for k in text))


class _Piece(NamedTuple):
    what: Any
    starts: dt.datetime
    ends: dt.datetime


def checked(feed: Feed, want: pa.Schema, batch: pa.RecordBatch, starts: dt.datetime, ends: dt.datetime) -> pa.RecordBatch:
    """The batch in the feed's schema (``want``) and window.

    Fails, naming the column, where one is missing or unknown, is of another kind, cannot be cast without
    loss, or is required and null. Column order is free.
    """
    if set(batch.schema.names) != set(want.names) or batch.num_columns != len(want):
        raise ValueError(f"columns of the feed: missing {sorted(set(want.names) - set(batch.schema.names))}, unknown {sorted(set(batch.schema.names) - set(want.names))}")
    columns = []
    for f in want:
        c = batch.column(f.name)
        if f.name in feed.required and c.null_count:
            raise ValueError(f"null in required column {f.name}")
        if not _same_kind(c.type, f.type):
            raise ValueError(f"column {f.name} is no {f.type} but {c.type}")
        try:
            columns.append(c.cast(f.type))
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
            raise ValueError(f"column {f.name} is no {f.type}: {e}") from e
    out = pa.RecordBatch.from_arrays(columns, schema=want)
    at = out.column(feed.time)
    inside = pc.and_(pc.greater_equal(at, pa.scalar(starts, at.type)), pc.less(at, pa.scalar(ends, at.type)))
    return out.filter(inside)


def _partitions(feed: Feed, starts: dt.datetime, ends: dt.datetime) -> list[InputPartition]:
    return [InputPartition(_Piece(p, starts, ends)) for p in feed.slices(starts, ends)] if starts < ends else []


def _rows(feed: Feed, want: pa.Schema, partition: InputPartition) -> Iterator[pa.RecordBatch]:
    piece = partition.value
    for batch in feed.read(piece.what):
        yield checked(feed, want, batch, piece.starts, piece.ends)


def feed_source(feed: Feed, label: str) -> type[DataSource]:
    """A data source named ``label``. Options ``starts`` and ``ends`` (ISO times, half-open) bound the window.

    A stream's offset is a time: a batch holds what the feed has completed since the last one, so a restart
    goes on from its checkpoint. Rows that land later, in time already read, are not seen by the stream.
    """

    declared = StructType.fromDDL(feed.schema)  # parsed here, since tasks have no session
    want = to_arrow_schema(declared)

    class Reader(DataSourceReader):
        def __init__(self, starts: str, ends: str):
            self.window = _time(starts), _time(ends)

        def partitions(self):
            return _partitions(feed, *self.window) or [InputPartition(None)]

        def read(self, partition):
            return _rows(feed, want, partition) if partition is not None and partition.value is not None else iter(())

    class StreamReader(DataSourceStreamReader):
        def __init__(self, starts: str, ends: str):
            self.starts, self.ends = _time(starts), _time(ends)

        def initialOffset(self):
            return {"before": self.starts.isoformat()}

        def latestOffset(self):
            return {"before": max(self.starts, min(feed.latest(), self.ends)).isoformat()}

        def partitions(self, start, end):
            return _partitions(feed, _time(start["before"]), _time(end["before"])) or [InputPartition(None)]

        def read(self, partition):
            return _rows(feed, want, partition) if partition.value is not None else iter(())

    class FeedSource(DataSource):
        @classmethod
        def name(cls):
            return label

        def schema(self):
            return declared

        def reader(self, schema):
            return Reader(self.options.get("starts", FIRST), self.options.get("ends", LAST))

        def streamReader(self, schema):
            return StreamReader(self.options.get("starts", FIRST), self.options.get("ends", LAST))

    return FeedSource
