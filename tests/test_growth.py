"""Work that follows the input's classes and rows, not their pairs or copies."""

from __future__ import annotations

import shutil
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import ordered as od, similarity as sim
from tidemark.operators.graph import shared
from tidemark.plans import catalogue, files
from tidemark.sources import feeds, readers

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def copied(spark, sf_dir, tmp_path_factory):
    """The tables with every supplier twelve times, at one place under other keys."""
    root = tmp_path_factory.mktemp("copied")
    shutil.copy(f"{sf_dir}/events.parquet", root)
    with duckdb.connect() as con:
        con.sql(f"COPY (SELECT s_suppkey + 97000 * i AS s_suppkey, s_name, s_nationkey, s_acctbal FROM '{sf_dir}/supplier.parquet', range(12) r(i)) TO '{root}/supplier.parquet'")
    return root


def checked(spark, copied, name):
    """(key's name, different keys) of each cover that a query wrote, once its rows are those of its SQL."""
    root = Path(urlparse(shared(spark)).path)
    before = set(root.iterdir())
    got = QUERIES[name](spark, str(copied))
    cols = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*cols).collect()), key=str)
    with duckdb.connect() as con:
        con.sql("SET TimeZone='UTC'")
        for t in ("events", "supplier"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{copied}/{t}.parquet'")
        assert rows == sorted(con.sql(ORACLES[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=str) and rows
    tables = [spark.read.parquet(str(f)) for f in set(root.iterdir()) - before if f.name.startswith("tidemark-")]
    return [(t.columns[0], t.select(t.columns[0]).distinct().count()) for t in tables if "cx" in t.columns]


@pytest.mark.parametrize("name", ["areas_cover", "areas_meet", "overlaps", "route_exposure", "nearest_area", "user_presentations"])
def test_shapes_of_one_form_are_covered_once(spark, copied, name):
    covers = checked(spark, copied, name)
    places = spark.read.parquet(f"{copied}/supplier.parquet")
    at = places.select(F.col("s_suppkey") % 97, "s_nationkey").distinct().count()
    assert at * 12 == places.count()
    seen = [n for key, n in covers if key in ("place_id", "way_id", "facility")]
    assert seen and all(0 < n <= at for n in seen)


def test_users_of_one_site_are_written_once(spark, copied):
    root = Path(urlparse(shared(spark)).path)
    before = set(root.iterdir())
    checked(spark, copied, "incremental_users")
    (live,) = (f for f in set(root.iterdir()) - before if f.name.startswith("live-"))
    users = spark.read.parquet(f"{copied}/supplier.parquet").count()
    for name in ("exposures", "priorities", "items", "alerts"):
        written = spark.read.parquet(f"{live}/tables/{name}")
        assert 0 < written.select("site").distinct().count() <= users / 12


def test_grid_is_not_joined_on_the_driver(spark, tmp_path):
    spark.createDataFrame([(k, t) for k in range(5) for t in (0, 7, 100, 950, 5000)], "k long, us long").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")  # small as a file, unlike its grid
    grid = od.grid_counts(rows, "k", "us", 10, {"soon": 5, "later": 25})
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    times = [0, 7, 100, 950, 5000]
    want = [(k, at, sum(t <= at for t in times), *(sum(at < t <= at + h for t in times) for h in (5, 25))) for k in range(5) for at in range(0, 5001, 10)]
    assert sorted(map(tuple, grid.collect())) == want


def test_nearest_of_copies(spark, monkeypatch):
    rows = [(i, [float(i % 11), float(i % 3)]) for i in range(120)] + [(500, None)]
    lib = spark.createDataFrame(rows, "n long, e array<double>")
    targets = lib.where("n % 5 = 0 AND e IS NOT NULL").select(F.col("n").alias("q"), F.col("e").alias("qe"))
    monkeypatch.setattr(sim, "BLOCK_ROWS", 10)
    weights = [1 / 3, 1 / 7]
    got = sim.nearest(targets, lib, "q", "n", sim.weighted_l1(F.col("qe"), F.col("e"), weights), 4, digits=6, same=["e"])
    want = set()
    for q, qe in rows:
        if q % 5 == 0 and qe:
            near = sorted((round(sum(w * abs(a - b) for w, a, b in zip(weights, qe, e)), 6), n) for n, e in rows if e and n != q)
            want |= {(q, n, d) for d, n in near[:4]}
    assert {(r.q, r.n, r.dist) for r in got.collect()} == want
    few = sim.nearest(targets.limit(1), lib.where("n IN (0, 500)"), "q", "n", sim.weighted_l1(F.col("qe"), F.col("e"), weights), 4)
    assert [r.n for r in few.collect()] in ([500], [0, 500])  # a row without a distance comes last


def test_a_record_is_read_once(spark):
    rows = spark.createDataFrame([('{"properties":{"AlertID":7,"x":-122.5,"y":47.5},"HeadlineDescription":"Road closed","StartTime":"2024-01-02T03:04:05Z","Route":"5"}',), ('{"id":"b","geometry":{"type":"LineString","coordinates":[[-122.25,47.25],[0,0]]}}',), ('{"id":"c","PointCoordinate":[47.75,-122.75]}',), ("{",), (None,)], "record string")
    seen = feeds.observations(rows, "highway_alerts", F.lit("2024-02-15").cast("timestamp"))
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") <= 40 and "$.AlertID" not in plan  # paths into the geometry alone
    got = sorted(((r.source_record_id or "", r.observation_type, r.place and tuple(r.place), r.payload.get("Route")) for r in seen.collect()), key=str)
    assert got == sorted([("7", "road_closure", (-122.5, 47.5), "5"), ("b", "traffic_condition", (-122.25, 47.25), None), ("c", "traffic_condition", (-122.75, 47.75), None), ("", "traffic_condition", None, None), ("", "traffic_condition", None, None)], key=str)


def test_feeds_share_one_reading_of_the_ledger(spark, sf_dir, tmp_path):
    with duckdb.connect() as con:  # ids that come twice, and rows without a time
        con.sql(f"COPY (SELECT event_id // 2 AS event_id, CASE WHEN event_id % 7 > 0 THEN ts END AS ts, user_id, event_type, value, props FROM '{sf_dir}/events.parquet') TO '{tmp_path}/events.parquet'")
        con.sql("SET TimeZone='UTC'")
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        got = QUERIES["feeds_projected"](spark, str(tmp_path))
        want = con.sql(ORACLES["feeds_projected"]).project(", ".join(got.columns)).fetchall()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want, key=str) and all(0 < r[5] < r[4] for r in rows)
    assert len(rows) == sum(1 + (name in files.WORDS) for name in feeds.FEEDS)


def test_columns_say_what_a_json_record_says(spark):
    row = {"id": " 7 ", "AlertID": "NA", "Description": "<b>Ramp</b> closed", "StartTime": "2024-01-02T03:04:05Z", "Route": "5", "latitude": "47.5", "LON": "-122.5"}
    table = spark.createDataFrame([tuple(row.values())], list(row))
    texts = table.select(F.to_json(F.struct(*row)).alias("record"))
    shown = ("observation_id", "source_record_id", "observation_type", "headline", "event_time", "payload", "observed_at")
    got = [feeds.observations(rows, "highway_alerts", F.lit("2024-02-15").cast("timestamp")).select(*shown).first() for rows in (table, texts)]
    assert got[0] == got[1] and (got[0].source_record_id, got[0].observation_type) == ("7", "road_closure")
    said = feeds.said("highway_alerts", readers.named({f: F.col(f) for f in row}), False)
    assert table.select(said.record_id, said.kind, said.payload["Route"], said.place.lon, said.place.lat).first() == ("7", "road_closure", "5", -122.5, 47.5)


def test_iso_times_are_read_as_by_their_form(spark):
    texts = [f"2024-{x}" for x in ("01-02T03:04:05Z", "01-02T03:04:05.678Z", "02-30T03:04:05Z", "13-01T00:00:00Z", "01-02T24:00:00Z", "01-02T03:04:60Z", "01-02T03:04:05.6Z", "01-02T03:04Z", "01-02T03:04:05", "1-2T03:04:05Z", "01-02t03:04:05z", "01-02T03:04:05+02:00")]
    texts += ["0000-01-01T00:00:00Z", "0001-01-01T00:00:00Z", "1582-10-10T00:00:00Z", "9999-12-31T23:59:59.999Z", "12024-01-02T03:04:05Z", " 2024-01-02T03:04:05Z ", None]
    rows = spark.createDataFrame([(x,) for x in texts], "said string")
    form = F.try_to_timestamp(F.trim("said"), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"))
    got = rows.select(F.unix_micros(tx.feed_time(F.col("said"))), F.unix_micros(form)).collect()
    assert all(a == b for a, b in got) and sum(a is not None for a, _ in got) == 10
