"""Running totals written by triggers, in folders that stay few.

A trigger's totals go to ``batches/batch_id=N``, so a replayed trigger overwrites its own. Every so
many triggers the batches since the last time are folded into the dates they touch: each such date
gets a new version ``days/<date>/upto=N``, then ``done/N`` commits them, then the folded batches and
the versions that were replaced are removed. Whatever a crash leaves behind, readers count each
batch once: versions above the last commit do not count, nor do batches up to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``."""
    fs, hadoop = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(hadoop(path)) if s.isDirectory()] if fs.exists(hadoop(path)) else []


def _committed(spark: SparkSession, path: str) -> int:
    return max((int(n) for n in _listed(spark, f"{path}/done")), default=-1)


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in _listed(spark, f"{path}/batches") if n.startswith("batch_id="))


def _versions(spark: SparkSession, path: str, date: str, upto: int) -> dict[str, int]:
    """The version of each date that counts: the last committed one."""
    out = {}
    for folder in _listed(spark, f"{path}/days"):
        if folder.startswith(f"{date}="):
            ids = [int(n.split("=")[1]) for n in _listed(spark, f"{path}/days/{folder}")]
            kept = [i for i in ids if i <= upto]
            if kept:
                out[folder] = max(kept)
    return out


def _read(spark: SparkSession, path: str, keys: Sequence[str], date: str, sums: Sequence[str], touched: set[str] | None = None) -> DataFrame | None:
    """All totals that count, not added up yet; of the dates alone those in ``touched``, if given."""
    upto = _committed(spark, path)
    parts = []
    versions = {d: v for d, v in _versions(spark, path, date, upto).items() if touched is None or d in touched}
    if versions:
        parts.append(spark.read.option("basePath", f"{path}/days").parquet(*[f"{path}/days/{d}/upto={v}" for d, v in versions.items()]))
    fresh = [n for n in _batches(spark, path) if n > upto]
    if fresh:
        parts.append(spark.read.parquet(*[f"{path}/batches/batch_id={n}" for n in fresh]))
    parts = [p.select(*keys, F.col(date).cast("date").alias(date), *sums) for p in parts]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None


def _added(df: DataFrame, keys: Sequence[str], date: str, sums: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, date).agg(*[F.sum(c).alias(c) for c in sums])


def compact(spark: SparkSession, path: str, keys: Sequence[str], date: str, sums: Sequence[str]) -> None:
    """Fold all batches into their dates and remove what is no longer read."""
    before, batches = _committed(spark, path), _batches(spark, path)
    fresh = [n for n in batches if n > before]
    fs, hadoop = _fs(spark, path)
    if fresh:
        upto = fresh[-1]
        dates = spark.read.parquet(*[f"{path}/batches/batch_id={n}" for n in fresh]).select(F.col(date).cast("string")).distinct()
        touched = {f"{date}={r[0]}" for r in dates.collect()}  # as many as days are still receiving rows
        merged = _added(_read(spark, path, keys, date, sums, touched), keys, date, sums)
        merged.withColumn("upto", F.lit(upto)).repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date, "upto").parquet(f"{path}/days")
        fs.mkdirs(hadoop(f"{path}/done/{upto}"))
    upto = _committed(spark, path)
    for n in batches:
        if n <= upto:
            fs.delete(hadoop(f"{path}/batches/batch_id={n}"), True)
    for folder, kept in _versions(spark, path, date, upto).items():
        for name in _listed(spark, f"{path}/days/{folder}"):
            if int(name.split("=")[1]) != kept:
                fs.delete(hadoop(f"{path}/days/{folder}/{name}"), True)
    for name in _listed(spark, f"{path}/done"):
        if int(name) < upto:
            fs.delete(hadoop(f"{path}/done/{name}"), True)


def append_totals(path: str, totals: Callable[[DataFrame], DataFrame], keys: Sequence[str], date: str, sums: Sequence[str], compact_every: int = 50) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: sums per keys and date of a trigger, under its batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= _committed(spark, path):
            return  # a replay of what is folded already
        _added(totals(batch), keys, date, sums).write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}")
        if len(_batches(spark, path)) >= compact_every:
            compact(spark, path, keys, date, sums)

    return write


def read_totals(spark: SparkSession, path: str, keys: Sequence[str], date: str, sums: Sequence[str]) -> DataFrame:
    """The totals over all triggers. There must be one trigger at least."""
    return _added(_read(spark, path, keys, date, sums), keys, date, sums)
