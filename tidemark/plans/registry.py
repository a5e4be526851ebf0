"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables, read on demand, and the ledger that they stand for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def obs(self) -> DataFrame:
        """The observation ledger over ``events``; us is the event time in microseconds."""
        at = F.col("ts").cast("timestamp")
        return self.__getattr__("events").select(
            F.col("event_id").alias("observation_id"), at.alias("event_time"), F.unix_micros(at).alias("us"), F.col("user_id").alias("source_id"),
            (F.col("user_id") % 50).alias("event_key"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"),
            (F.lit(-122.335) + (F.col("user_id") % 200 - 100) * F.lit(0.001)).alias("lon"), (F.lit(47.608) + (F.col("event_id") % 200 - 100) * F.lit(0.001)).alias("lat"),
        )


#: The same ledger in SQL, as the first of a statement's common table expressions.
OBS_SQL = """WITH obs AS (SELECT event_id AS observation_id, ts AS event_time, epoch_us(ts) AS us, user_id AS source_id, user_id % 50 AS event_key, event_type AS kind,
  value, CAST(props->>'$.k' AS BIGINT) AS k, CAST(-122.335 AS DOUBLE) + (user_id % 200 - 100) * CAST(0.001 AS DOUBLE) AS lon,
  CAST(47.608 AS DOUBLE) + (event_id % 200 - 100) * CAST(0.001 AS DOUBLE) AS lat FROM events)"""


def query(sql: str | None = None, obs: bool = False) -> Callable:
    """Registers a function of ``Tables``; with ``obs`` the SQL starts after the ledger's expression."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = (OBS_SQL + sql) if obs else sql
        return fn

    return add


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"
