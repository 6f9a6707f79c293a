"""GeoJSON, the month store and the inventory."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from rideops.session import shared_folder
from rideops.sources import footers, geojson, store
from rideops.sources.trips import read_trips
from rideops.sources.zones import read_zones


def _square(x, y, half):
    return [[x - half, y - half], [x + half, y - half], [x + half, y + half], [x - half, y + half], [x - half, y - half]]


def test_read_zones(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"LocationID": "7", "zone": "Astoria", "borough": "Queens"},
         "geometry": {"type": "Polygon", "coordinates": [_square(0, 0, 0.01), _square(0, 0, 0.005)]}},
        {"type": "Feature", "properties": {"LocationID": 132, "Name": "JFK Airport", "Boro": "Queens"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[_square(0, 0, 0.01)], [_square(1, 0, 0.01)]]}},
        {"type": "Feature", "properties": {"zone": "no id"}, "geometry": {"type": "Polygon", "coordinates": [_square(0, 0, 1)]}},
    ]
    path = tmp_path / "zones.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = {r.zone_id: r for r in read_zones(spark, str(path)).collect()}
    assert set(rows) == {7, 132}
    assert (rows[7].zone_name, rows[132].borough_name, rows[132].airport_excluded) == ("Astoria", "Queens", True)
    one = (0.02 * 69.0) ** 2
    assert rows[7].zone_area_sq_miles == pytest.approx(one * 0.75, rel=1e-6)
    assert rows[132].zone_area_sq_miles == pytest.approx(one * 2, rel=1e-6)
    assert not rows[7].airport_excluded


def test_month_store_replaces_only_its_months(spark, tmp_path):
    path = str(tmp_path / "store")
    jan, feb = 1736121600, 1738800000
    store.write_month(spark.createDataFrame([(1, jan, 5), (1, feb, 6)], "zone_id int, bin_local_epoch long, n int"), path)
    store.write_month(spark.createDataFrame([(2, feb, 9)], "zone_id int, bin_local_epoch long, n int"), path)
    got = {(r.zone_id, r.n) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 5), (2, 9)}
    one = store.read_bin(spark, path, "2025-02", feb)
    assert [r.n for r in one.collect()] == [9]
    assert "PartitionFilters: [isnotnull(month_key" in one._jdf.queryExecution().executedPlan().toString()


def test_inventory_from_footers(spark, tmp_path):
    """Months in names, spans from statistics; a file with 96-bit timestamps and one of nulls alone are scanned or told apart."""
    t = datetime.datetime(2025, 1, 3, 7, 30, 1, 900_000)
    names = ("trips_2025-01.parquet", "copy_202501.parquet", "trips_2025-02.parquet", "old.parquet", "nulls.parquet")
    for i, name in enumerate(names):
        when = None if name.startswith("nulls") else t + datetime.timedelta(days=31 * (i == 2))
        spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96" if name.startswith("old") else "TIMESTAMP_MICROS")
        spark.createDataFrame([(when,), (None,), (when and when + datetime.timedelta(seconds=9),)], "pickup_datetime timestamp").coalesce(1).write.parquet(f"{tmp_path}/{name}-dir")
        part = next((tmp_path / f"{name}-dir").glob("*.parquet"))
        part.rename(tmp_path / name)
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    first = int(t.replace(tzinfo=datetime.timezone.utc).timestamp())
    out = store.parquet_inventory(spark, [str(tmp_path / n) for n in names])
    got = {r.file_name: (r.first_epoch, r.last_epoch, r.rows, r.month_key, r.same_month, r.same_span) for r in out.collect()}
    month = 31 * 86400
    assert got == {names[0]: (first, first + 9, 3, "2025-01", True, True), names[1]: (first, first + 9, 3, "2025-01", True, True),
                   names[2]: (first + month, first + month + 9, 3, "2025-02", False, False), names[3]: (first, first + 9, 3, None, False, True),
                   names[4]: (None, None, 3, None, False, False)}
    told = footers.file_spans(spark, [str(tmp_path / n) for n in names[:3]], "pickup_datetime")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "parquet_footers" in plan
    folder = footers.footers(spark, [str(tmp_path / f"{names[0]}-dir"), f"file://{tmp_path / names[1]}"], "PICKUP_datetime").collect()
    assert [r.rows for r in folder] == [3]


def _frames(spark):
    rows = [(7, 1736154000, 3, 2, 12.5, 40, "blue", "#0000ff"), (132, 1736154000, 0, None, None, None, None, None), (7, 1736155200, 4, 1, 8.0, 90, "green", "#00ff00")]
    scored = spark.createDataFrame(rows, "zone_id int, bin_local_epoch long, pickups_now long, pickups_next long, median_driver_pay double, rating_citywide_v3 int, bucket_citywide_v3 string, color_citywide_v3 string")
    shapes = [({"LocationID": "7", "zone": "A \"b\"", "borough": "Queens"}, {"type": "Polygon", "coordinates": [_square(0, 0, 0.01)]}),
              ({"LocationID": 132, "Name": "JFK Airport", "Boro": "Queens"}, {"type": "MultiPolygon", "coordinates": [[_square(1, 0, 0.01)]]}),
              ({"LocationID": 8, "zone": "no geometry"}, None)]
    features = spark.createDataFrame([(json.dumps(p), g and json.dumps(g)) for p, g in shapes], "properties string, geometry string")
    return geojson.frame_documents(scored, features, ["pickups_next"]), shapes


def test_frame_documents(spark):
    documents, shapes = _frames(spark)
    first, second = [json.loads(r.document) for r in documents.orderBy("bin_local_epoch").collect()]
    assert (first["time"], second["time"]) == ("2025-01-06T09:00:00", "2025-01-06T09:20:00")
    assert first["polygons"]["type"] == "FeatureCollection" and len(second["polygons"]["features"]) == 1
    one, two = first["polygons"]["features"]
    assert one["geometry"] == shapes[0][1] and two["geometry"] == shapes[1][1]
    assert one["properties"] == {
        "LocationID": 7, "zone_name": 'A "b"', "borough": "Queens", "airport_excluded": False, "rating": 40, "bucket": "blue", "pickups": 3, "avg_driver_pay": 12.5, "avg_tips": None,
        "style": {"color": "#0000ff", "opacity": 0, "weight": 0, "fillOpacity": 0.82, "fillColor": "#0000ff"}, "pickups_next_shadow": 2}
    assert (two["properties"]["rating"], two["properties"]["airport_excluded"], two["properties"]["pickups_next_shadow"]) == (1, True, None)


def test_written_frames_are_zone_maps_again(spark, tmp_path):
    documents, _ = _frames(spark)
    path = str(tmp_path / "frames")
    geojson.write_documents(geojson.collections(documents), path)
    geojson.write_documents(geojson.collections(documents), path)  # again: the same files
    files = sorted(str(p.relative_to(path)) for p in (tmp_path / "frames").rglob("*") if p.is_file())
    assert files == ["2025-01-06/09-00.geojson", "2025-01-06/09-20.geojson"]
    rows = {r.zone_id: r for r in read_zones(spark, f"{path}/2025-01-06/09-00.geojson").collect()}
    assert set(rows) == {7, 132} and rows[7].borough_name == "Queens"
    assert rows[7].zone_area_sq_miles == pytest.approx((0.02 * 69.0) ** 2, rel=1e-6)


def test_existing_documents_stay_without_overwrite(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.dataSource.register(geojson.DocumentFiles)
    one = spark.createDataFrame([("a/x.json", "1"), ("y.json", "ü")], "name string, document string")
    one.write.format("documents").mode("append").save(path)
    with pytest.raises(Exception, match="are there already"):
        one.withColumn("document", F.lit("2")).write.format("documents").mode("append").save(path)
    assert sorted((str(p.relative_to(path)), p.read_text()) for p in (tmp_path / "docs").rglob("*") if p.is_file()) == [("a/x.json", "1"), ("y.json", "ü")]


def test_months_with_other_schemas(spark, tmp_path):
    """Types, columns and spelling change from month to month; two months share a schema."""
    t = datetime.datetime(2025, 1, 3, 12)
    base = "PULocationID {0}, DOLocationID {0}, pickup_datetime {1}, driver_pay {2}, trip_time {3}, trip_miles double"
    months = {
        "m1": ([(1, 2, t, 10.0, 600, 2.0)], base.format("long", "timestamp", "double", "long")),
        "m2": ([("3", "x", t, "12.5", 700.0, 1.0), ("bad", "4", t, "1", 1.0, 1.0)], base.format("string", "timestamp_ntz", "string", "double") + ", "),
        "m3": ([(5, 6, "2025-01-03 12:00:00", 9.0, 60, 1.5, 1, 2.5), (5, None, "no time", 9.0, 60, 1.5, 1, 2.5)], base.format("int", "string", "float", "int").lower() + ", shared_request_flag int, airport_fee double"),
        "m4": ([(7, 8, t, 11.0, 500, 2.0)], base.format("long", "timestamp", "double", "long")),
    }
    for name, (rows, schema) in months.items():
        spark.createDataFrame(rows, schema.rstrip(", ")).coalesce(1).write.parquet(str(tmp_path / name))
    out = read_trips(spark, [str(tmp_path / m) for m in months], "2025-01-01", "2025-02-01")
    got = sorted(tuple(r) for r in out.select("zone_id", "drop_zone_id", F.unix_timestamp("pickup_datetime"), "driver_pay", "trip_time", "shared_flag", "airport_fee").collect())
    at = int(t.replace(tzinfo=datetime.timezone.utc).timestamp())
    assert got == [(1, 2, at, 10.0, 600.0, 0, None), (3, None, at, 12.5, 700.0, 0, None), (5, 6, at, 9.0, 60.0, 1, 2.5), (7, 8, at, 11.0, 500.0, 0, None)]
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 3
    assert read_trips(spark, [str(tmp_path / m) for m in months], "2025-02-01").count() == 0


class _Session:
    """The two parts of a session that the shared folder depends on."""

    def __init__(self, master, settings):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: settings.get(key, default))})()


def test_shared_folder_comes_from_the_session():
    cluster = _Session("spark://host", {"spark.checkpoint.dir": "hdfs://shared/"})
    assert shared_folder(cluster) == "hdfs://shared/"
    assert store.scratch_path(cluster, "x").startswith("hdfs://shared/x-")
    with pytest.raises(ValueError):
        shared_folder(_Session("spark://host", {}))
