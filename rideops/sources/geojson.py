"""Frames as GeoJSON: one document per bin, and a sink that writes one file per document."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from rideops.functions import times
from rideops.operators.trip_features import airport_zone
from rideops.sources.zones import zones_from_features

# Fixed value: how a zone is drawn.
STYLE = {"opacity": 0, "weight": 0, "fillOpacity": 0.82}


def frame_time(epoch: Column) -> Column:
    """The wall clock of a bin as ISO text without an offset."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss")


def _properties(shadow: Sequence[str]) -> Column:
    color = F.col("color_citywide_v3")
    style = F.struct(color.alias("color"), *[F.lit(v).alias(k) for k, v in STYLE.items()], color.alias("fillColor"))
    return F.struct(
        F.col("zone_id").alias("LocationID"), "zone_name", F.col("borough_name").alias("borough"),
        airport_zone(F.col("zone_id"), F.col("zone_name"), F.col("borough_name")).alias("airport_excluded"),
        F.coalesce("rating_citywide_v3", F.lit(1)).alias("rating"), F.col("bucket_citywide_v3").alias("bucket"),
        F.coalesce("pickups_now", F.lit(0)).alias("pickups"), F.col("median_driver_pay").alias("avg_driver_pay"), F.lit(None).cast("double").alias("avg_tips"),
        style.alias("style"), *[F.col(c).alias(f"{c}_shadow") for c in shadow])


def frame_documents(scored: DataFrame, features: DataFrame, shadow: Sequence[str] = ()) -> DataFrame:
    """(bin_local_epoch, frame_time, n_features, document): one FeatureCollection per bin.

    ``features`` is the zone map (properties and geometry as JSON text): names, boroughs and
    geometry come from it, and zones without geometry are left out. ``shadow`` names further
    columns of ``scored`` that become properties. Zones stand in order of their id; a bin has one
    row per zone, so a document is bounded by the zone map.
    """
    zones = zones_from_features(features).filter(F.col("geometry").isNotNull()).dropDuplicates(["zone_id"])
    rows = scored.drop("zone_name", "borough_name").join(zones, "zone_id")
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.col("geometry"), F.lit(',"properties":'),
                       F.to_json(_properties(shadow), {"ignoreNullFields": "false"}), F.lit("}"))
    parts = rows.groupBy("bin_local_epoch").agg(F.sort_array(F.collect_list(F.struct("zone_id", feature.alias("text")))).alias("_f"))
    document = F.concat(F.lit('{"time":"'), frame_time(F.col("bin_local_epoch")), F.lit('","polygons":{"type":"FeatureCollection","features":['),
                        F.array_join(F.transform("_f", lambda f: f.text), ","), F.lit("]}}"))
    return parts.select("bin_local_epoch", frame_time(F.col("bin_local_epoch")).alias("frame_time"), F.size("_f").alias("n_features"), document.alias("document"))


def collections(documents: DataFrame) -> DataFrame:
    """The documents' FeatureCollections alone, as :func:`rideops.sources.zones.read_zones` takes them."""
    return documents.withColumn("document", F.get_json_object("document", "$.polygons"))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FileWriter(DataSourceWriter):
    """Each row (name, document) becomes a file.

    Tasks write below a folder of their own; when all have ended, the files are moved to their
    places, so a failed or repeated task leaves nothing behind. Paths are those pyarrow knows
    (local, HDFS, object stores).
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(self.path))

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._open()
        folder, files = f"{root}/_pending-{self.job}/{uuid.uuid4().hex}", []
        for name, document in iterator:
            target = f"{folder}/{name}"
            store.create_dir(os.path.dirname(target), recursive=True)
            with store.open_output_stream(target) as out:
                out.write(document.encode())
            files.append(target)
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        from pyarrow import fs

        store, root = self._open()
        moved = {f.split(f"_pending-{self.job}/")[1].split("/", 1)[1]: f for m in messages if m for f in m.files}
        there = [n for n, i in zip(moved, store.get_file_info([f"{root}/{n}" for n in moved])) if i.type != fs.FileType.NotFound] if moved else []
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{there[0]} and {len(there) - 1} more are there already; use overwrite")
        for name, file in moved.items():
            store.create_dir(os.path.dirname(f"{root}/{name}"), recursive=True)
            store.move(file, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = self._open()
        if store.get_file_info(f"{root}/_pending-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_pending-{self.job}")


class DocumentFiles(DataSource):
    """Sink ``documents``: rows (name string, document string), one file per row below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "name string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if [f.name for f in schema.fields] != ["name", "document"]:
            raise ValueError("the sink takes columns name and document")
        return FileWriter(self.options["path"], overwrite)


def write_documents(documents: DataFrame, path: str) -> None:
    """One GeoJSON file per bin: <path>/<date>/<hh-mm>.geojson. Files of the same bins are replaced."""
    documents.sparkSession.dataSource.register(DocumentFiles)
    date = times.epoch_date(F.col("bin_local_epoch")).cast("string")
    name = F.concat(date, F.lit("/"), F.date_format(F.timestamp_seconds("bin_local_epoch"), "HH-mm"), F.lit(".geojson"))
    documents.select(name.alias("name"), "document").write.format("documents").mode("overwrite").save(path)
