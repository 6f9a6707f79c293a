"""Rows and time spans of parquet files from their footers."""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file_path string, file_name string, rows long, first_micros long, last_micros long, complete boolean"
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def _store(path: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _micros(value: object) -> int | None:
    """Microseconds of a statistic; a time without an offset is UTC, a date its midnight."""
    if isinstance(value, datetime.datetime):
        at = value if value.tzinfo else value.replace(tzinfo=datetime.timezone.utc)
    elif isinstance(value, datetime.date):
        at = datetime.datetime(value.year, value.month, value.day, tzinfo=datetime.timezone.utc)
    else:
        return None
    return (at - _EPOCH) // datetime.timedelta(microseconds=1)


class FooterReader(DataSourceReader):
    """One partition per file; a task reads its footer and no page of data."""

    def __init__(self, paths: Sequence[str], column: str) -> None:
        self.paths, self.column = paths, column

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files = []
        for path in self.paths:
            store, root = _store(path)
            scheme = path[:-len(root)] if path.endswith(root) and path != root else ""
            if store.get_file_info(root).type == fs.FileType.File:
                files.append(scheme + root)
                continue
            below = store.get_file_info(fs.FileSelector(root, recursive=True))
            files += sorted(scheme + i.path for i in below if i.type == fs.FileType.File and i.path.endswith(".parquet") and not i.base_name.startswith(("_", ".")))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        store, path = _store(partition.value)
        with store.open_input_file(path) as file:
            meta = pq.ParquetFile(file).metadata
        place = next((i for i in range(meta.num_columns) if meta.schema.column(i).path.lower() == self.column.lower()), None)
        low, high, complete = [], [], place is not None
        for g in range(meta.num_row_groups if complete else 0):
            chunk = meta.row_group(g).column(place)
            stats = chunk.statistics
            if stats is not None and stats.has_min_max:
                low.append(_micros(stats.min))
                high.append(_micros(stats.max))
            elif meta.row_group(g).num_rows and (stats is None or stats.null_count != meta.row_group(g).num_rows):
                complete = False
        complete = complete and None not in low + high
        yield (partition.value, os.path.basename(path), meta.num_rows, min(low) if complete and low else None, max(high) if complete and high else None, complete)


class Footers(DataSource):
    """Source ``parquet_footers`` with options ``paths`` (one per line) and ``column``."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FooterReader:
        return FooterReader(self.options["paths"].split("\n"), self.options["column"])


def footers(spark: SparkSession, paths: Sequence[str], column: str) -> DataFrame:
    """Per file: rows and the span of ``column``; not ``complete`` where the footer does not tell the span."""
    spark.dataSource.register(Footers)
    return spark.read.format("parquet_footers").option("paths", "\n".join(paths)).option("column", column).load()


def file_spans(spark: SparkSession, paths: Sequence[str], column: str) -> DataFrame:
    """(file_name, first_epoch, last_epoch, rows) from footers.

    Files whose footers have no statistics of the column (old timestamps of 96 bits) are scanned,
    and only these. Paths are files or folders that pyarrow can open.
    """
    found = footers(spark, paths, column)
    told = found.filter("complete").select("file_name", F.floor(F.col("first_micros") / 1_000_000).alias("first_epoch"), F.floor(F.col("last_micros") / 1_000_000).alias("last_epoch"), "rows")
    untold = [r.file_path for r in found.filter("not complete").select("file_path").collect()]
    if not untold:
        return told
    rows = spark.read.parquet(*untold).select(F.col("_metadata.file_name").alias("file_name"), F.col(column).cast("timestamp").alias("t"))
    scanned = rows.groupBy("file_name").agg(F.unix_timestamp(F.min("t")).alias("first_epoch"), F.unix_timestamp(F.max("t")).alias("last_epoch"), F.count("*").alias("rows"))
    return told.unionByName(scanned)
