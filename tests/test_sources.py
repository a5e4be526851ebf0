"""Readers and feeds over small files of each shape."""

from __future__ import annotations

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds, readers

QUAKES = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "id": "uw1", "properties": {"mag": 2.5, "place": "5 km N", "time": 1700000000000, "title": "M 2.5 - 5 km N"}, "geometry": {"type": "Point", "coordinates": [-122.3, 47.6, 10]}},
    {"type": "Feature", "id": "uw2", "properties": {"mag": 1.0, "place": "far", "time": "n/a"}, "geometry": None},
]}


@pytest.mark.parametrize(("doc", "n"), [([{"a": 1}, {"a": 2}], 2), ({"items": [{"a": 1}]}, 1), (QUAKES, 2), ({"a": 1}, 1), ([], 0)])
def test_records(spark, tmp_path, doc, n):
    (tmp_path / "x.json").write_text(json.dumps(doc, indent=1))
    assert readers.json_records(spark, str(tmp_path / "x.json")).count() == n


def test_gzip_and_budget(spark, tmp_path):
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        json.dump([{"a": i} for i in range(9)], f)
    assert readers.json_records(spark, str(tmp_path / "x.json.gz"), budget=4).count() == 4


def test_earthquakes(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps(QUAKES))
    got = {r.source_record_id: r for r in feeds.observations(feeds.read(spark, "earthquakes", str(tmp_path / "q.json")), "earthquakes", F.lit("2024-01-01").cast("timestamp")).collect()}
    a, b = got["uw1"], got["uw2"]
    assert a.place.lon == -122.3 and a.payload["mag"] == "2.5" and a.event_time.year == 2023 and a.spatial_quality == 0.9
    assert b.place is None and b.event_time is None and b.spatial_quality == 0.5 and a.observation_id.startswith("obs_")


def test_news_retyping(spark, tmp_path):
    items = [{"title": "Blaze on <b>Pine</b>", "guid": "1", "pub_date": "Tue, 02 Jan 2024 10:00:00 +0000"}, {"title": "Council meets", "guid": "2"}, {"title": "I-5 closed", "guid": "3"}]
    (tmp_path / "n.json").write_text(json.dumps(items))
    got = {r.source_record_id: r for r in feeds.observations(feeds.read(spark, "news", str(tmp_path / "n.json")), "news").collect()}
    assert [got[k].observation_type for k in "123"] == ["fire_dispatch", "news_article", "road_closure"]
    assert got["1"].headline == "Blaze on Pine" and got["1"].event_time.hour == 10


def test_delimited_dialects_and_gtfs(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Report_Number,Date_Occ,Latitude,Longitude,Offense\n7,01/05/2024,47.6,-122.3,"theft, petty"\n8,,0,0,NA\n')
    rows = feeds.unify_dialects(readers.delimited(spark, str(tmp_path / "c.csv")))
    got = {r.source_record_id: r for r in feeds.observations(rows, "municipal_crime").collect()}
    assert got["7"].headline == "theft, petty" and got["7"].place.lat == 47.6 and got["7"].event_time.day == 5
    assert got["8"].headline is None and got["8"].place is None
    (tmp_path / "g").mkdir()
    (tmp_path / "g/routes.txt").write_text("route_id,route_short_name\n1,44\n")
    (tmp_path / "g/stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon\n9,Pine,47.6,-122.3\n")
    (tmp_path / "g/trips.txt").write_text("trip_id,route_id\n5,1\n")
    table = readers.gtfs(spark, str(tmp_path / "g"))
    assert {r.record_kind for r in table.collect()} == {"route", "stop", "trip"}
    assert feeds.observations(table, "transit_static").where("place IS NOT NULL").count() == 1


def test_every_feed_projects(spark):
    row = spark.createDataFrame([('{"x": 1}',), (None,)], "record string")
    for name, feed in feeds.FEEDS.items():
        out = feeds.observations(row, name, F.lit("2024-01-01").cast("timestamp")).collect()
        assert len(out) == 2 and all(r.observation_type in feed.kinds for r in out)
    assert sum(feeds.coverage().values()) == len(feeds.FEEDS)


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Country</t></si><si><t>US</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="B1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    got = sorted((r.sheet[-10:], r.row, r.cells) for r in readers.workbook(spark, str(tmp_path / "b.xlsx")).collect())
    assert got == [("sheet1.xml", 0, ["Country", None, "5"]), ("sheet1.xml", 1, ["US"]), ("sheet2.xml", 0, [None, "in"])]


def test_layout_discovery(spark):
    rows = [(str(1000 + i), "20200530", "x", str(30 + i % 10), str(-100.5 + i % 20), f"http://n.example/{i}", str(i % 7)) for i in range(300)]
    table = spark.createDataFrame(rows, ", ".join(f"col_{i} string" for i in range(7)))
    assert readers.discover_layout(table, (-170, 15, -50, 75)) == {"id": 0, "date": 1, "url": 5, "latitude": 3, "longitude": 4}
    assert readers.discover_layout(table, (0, 0, 1, 1))["latitude"] is None


def test_admission_health_series(spark):
    at = spark.createDataFrame([(1, -122.3, 47.6, True, False), (2, None, None, True, False), (3, 2.0, 48.0, True, True), (4, 2.0, 48.0, True, False), (5, -122.3, 47.6, False, True)], "i int, lon double, lat double, ok boolean, cmp boolean")
    point = F.when(F.col("lon").isNotNull(), F.struct("lon", "lat"))
    got = {r.i: r.a for r in at.select("i", readers.admission(point, F.col("ok"), (-123, 47, -122, 48), F.col("cmp")).alias("a")).collect()}
    assert got == {1: "region", 2: "unlocated", 3: "comparator", 4: None, 5: None}
    polls = spark.sql("SELECT 'a' source_id, timestamp '2024-01-01 00:00:00' at, true ok, 5L records UNION ALL SELECT 'b', timestamp '2024-01-01 00:00:00', false, 0L UNION ALL SELECT 'c', timestamp '2024-01-01 00:09:00', true, 1L UNION ALL SELECT 'd', timestamp '2023-12-31 00:00:00', true, 1L")
    states = {r.source_id: r.state for r in feeds.health(polls, F.lit("2024-01-01 00:10:00").cast("timestamp"), 240.0, 3600.0).collect()}
    assert states == {"a": "delayed", "b": "unknown", "c": "healthy", "d": "offline"}
    wide = spark.createDataFrame([("x", "1.5", "."), ("y", "na", "2")], "k string, a string, b string")
    assert {(r.k, r.name, r.value) for r in feeds.series(wide, ["k"], ["a", "b"]).collect()} == {("x", "a", 1.5), ("y", "b", 2.0)}
