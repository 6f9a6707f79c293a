"""Session defaults and lineage control."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import rideops

# Folds and streaming state run in Python workers. Sending them by value means that the workers
# need not have this package installed.
cloudpickle.register_pickle_by_value(rideops)


_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(app: str = "rideops", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, AQE with skew handling."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The scoring plan alone generates more classes than the default cache of 100 holds.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder, one per application, removed
    when Python ends; on a cluster a missing setting is an error, because an executor-local folder does not survive its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.TemporaryDirectory(prefix="rideops-shared-", ignore_cleanup_errors=True)
        folder = _LOCAL[app].name
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
