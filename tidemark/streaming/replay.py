"""The latest messages of each topic, kept from a stream for consumers that join late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .incremental import exists

#: Messages that a topic keeps (fixed value).
KEPT = 2000


class TopicLog:
    """The last ``keep`` messages of each topic by (at, message), whatever order they came in.

    The latest so many of two sets are the latest so many of both sets' latest, so a batch is merged into what is held.  A topic
    is first cut by a hash of its messages into as many parts as there are shuffle partitions, each of which leaves its
    latest, so a hot topic meets in one task with that many times ``keep`` rows at most.  A batch writes a whole new log, topics times ``keep`` rows;
    the newest committed one counts, so a batch that runs again changes nothing."""

    def __init__(self, spark: SparkSession, root: str, rows: StructType, topic: str, at: str, message: str, keep: int = KEPT):
        self.spark, self.root, self.rows, self.topic, self.at, self.message, self.keep = spark, root.rstrip("/"), rows, topic, at, message, keep

    def _last(self) -> int:
        path = f"{self.root}/commits"
        return self.spark.read.parquet(path).agg(F.max("number")).first()[0] if exists(self.spark, path) else -1

    def _log(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.rows).parquet(f"{self.root}/log/batch={number}") if number >= 0 else self.spark.createDataFrame([], self.rows)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merges one micro-batch; to be given to ``foreachBatch``.  Messages without a topic are not kept."""
        last = self._last()
        if number <= last:
            return
        columns = self.rows.fieldNames()
        staged = f"{self.root}/staged/batch={number}"
        batch.where(F.col(self.topic).isNotNull()).select(*columns).write.mode("overwrite").parquet(staged)
        both = self._log(last).unionByName(self.spark.read.schema(self.rows).parquet(staged))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        both = both.withColumn("__part", F.pmod(F.xxhash64(self.message, self.at), F.lit(parts)))
        for keys in ([self.topic, "__part"], [self.topic]):
            newest = Window.partitionBy(*keys).orderBy(F.col(self.at).desc_nulls_last(), F.col(self.message).desc_nulls_last())
            both = both.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= self.keep).drop("__r")
        merged = both.select(*columns)
        merged.write.mode("overwrite").parquet(f"{self.root}/log/batch={number}")
        self.spark.createDataFrame([(number,)], "number int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={number}")

    def run(self, stream: DataFrame) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def replay(self, topic: str | None = None, user: str | None = None, user_id: object = None) -> DataFrame:
        """What a consumer gets on joining: a topic's messages or all, for one user those addressed to it or to nobody."""
        out = self._log(self._last())
        if topic is not None:
            out = out.where(F.col(self.topic) == topic)
        if user is not None:
            out = out.where(F.col(user).isNull() | (F.col(user) == user_id))
        return out
