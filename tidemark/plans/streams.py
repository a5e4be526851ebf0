"""Streaming queries run over all files there are, so their results can be held against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.graph import shared
from ..streaming import ledger_stream as ls
from ..streaming import timers as tm
from . import claims  # noqa: F401  (its statement is used here)
from .registry import ORACLES, Tables, query

DAY = 86_400_000_000


def _folder(t: Tables) -> str:
    return f"{shared(t.spark)}/stream-{uuid.uuid4().hex}"


def events(t: Tables) -> DataFrame:
    schema = t.events.schema
    stream = ls.read_files(t.spark, t.sf_dir, schema, pathGlobFilter="events.parquet", recursiveFileLookup="false")
    at = F.col("ts").cast("timestamp")
    return stream.select("event_id", "user_id", "event_type", "value", at.alias("ts"))


def _drained(t: Tables, stream: DataFrame) -> DataFrame:
    folder = _folder(t)
    return ls.drain(stream, "q" + uuid.uuid4().hex, folder + "/checkpoint", folder + "/out")


@query()
def stream_tumbling(t: Tables) -> DataFrame:
    """Hourly counts by type; the last open windows wait for the watermark, so rows-only."""
    return _drained(t, ls.tumbling(events(t), "ts", "1 hour", "10 minutes", ["event_type"]))


@query("SELECT user_id % 7 AS user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id % 7 AS user_id, event_type FROM events) GROUP BY ALL")
def stream_dedupe(t: Tables) -> DataFrame:
    """Keys of a stream once each within a watermark that spans the table."""
    rows = events(t).withColumn("user_id", F.col("user_id") % 7)
    out = _drained(t, ls.deduped(rows, ["user_id", "event_type"], "ts", "90 days"))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, count(*) AS versions FROM f WHERE b IS NULL OR b <> event_type GROUP BY user_id")
def stream_versions(t: Tables) -> DataFrame:
    """Change capture by keyed state: how often each record's fingerprint changed."""
    out = _drained(t, ls.versions(events(t), "user_id", "event_type", "ts", "event_id"))
    return out.groupBy("user_id").agg(F.max("version").alias("versions"))


def _timed(t: Tables, rows: DataFrame, make) -> DataFrame:
    """Rows written to a folder and streamed through an operator with timers."""
    folder = _folder(t)
    rows.write.parquet(f"{folder}/in")
    with tm.timed_state(t.spark):
        return ls.drain(make(ls.read_files(t.spark, f"{folder}/in", rows.schema)), "q" + uuid.uuid4().hex, f"{folder}/checkpoint", f"{folder}/out")


@query()
def stream_resolver(t: Tables) -> DataFrame:
    """Observations resolved to the events of their cell by keyed state; events close by timer, reopen and leave the state
    (order-dependent; no SQL form)."""
    rows = t.obs.select(geo.geo_cell(F.col("lon"), F.col("lat")).alias("cell"), "observation_id", "us", "lon", "lat", (F.col("k") >= 95).alias("final"))
    return _timed(t, rows, lambda s: tm.resolve(s, "cell", 3_600_000_000, 10_800_000_000, 500.0, "1 hour")).where("observation_id IS NOT NULL")


@query(ORACLES["reopened_events"])
def stream_reopened(t: Tables) -> DataFrame:
    """Reports after an event closed, from keyed state with timers: the same as ``reopened_events`` over the whole table."""
    rows = t.obs.select("source_id", "observation_id", "us", "lon", "lat", (F.col("k") >= 95).alias("final"))
    out = _timed(t, rows, lambda s: tm.resolve(s, "source_id", DAY, 400 * DAY, None, "1 hour"))
    return out.where("outcome IN ('reopened', 'new')").select("observation_id", "source_id", "outcome")


@query(f""", p AS (SELECT event_key, k, us // {DAY} * {DAY} AS us, max({{'us': us, 'o': observation_id, 'kind': kind}}).kind AS fp FROM obs GROUP BY ALL),
w AS (SELECT *, lag(us) OVER q AS old, lag(fp) OVER q AS oldfp, lead(us) OVER q AS next FROM p WINDOW q AS (PARTITION BY event_key, k ORDER BY us)),
v AS (SELECT *, 1 + sum(CASE WHEN oldfp <> fp THEN 1 ELSE 0 END) OVER (PARTITION BY event_key, k ORDER BY us) AS version FROM w)
SELECT event_key, k, CASE WHEN old IS NULL THEN 'created' WHEN us - old > {3 * DAY} THEN 'returned' ELSE 'revised' END AS change, version::BIGINT AS version, us FROM v WHERE old IS NULL OR us - old > {3 * DAY} OR oldfp <> fp
UNION ALL SELECT event_key, k, 'ended', version::BIGINT, us + {3 * DAY} FROM v WHERE coalesce(next, (SELECT max(us) FROM p)) - us > {3 * DAY}""", obs=True)
def stream_tombstones(t: Tables) -> DataFrame:
    """Daily polls of records: versions, ends after three missed polls (by timer where nothing follows) and returns."""
    last = F.max(F.struct("us", "observation_id", "kind")).alias("m")
    polls = t.obs.groupBy("event_key", "k", (F.floor(F.col("us") / DAY) * DAY).alias("day")).agg(last).select("event_key", "k", F.col("day").alias("us"), F.col("m.kind").alias("fingerprint"))
    return _timed(t, polls, lambda s: tm.presence(s, ["event_key", "k"], 3 * DAY, 400 * DAY, "1 hour"))
