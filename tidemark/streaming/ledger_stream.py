"""Structured Streaming: change capture, windows, topic fan-out; ``timers`` holds the operators whose state ends by timer."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options: str) -> DataFrame:
    """Files of a folder as a stream: each is read once; what was read is in the checkpoint."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def deduped(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, time: str, width: str, delay: str, by: list[str], **aggregates) -> DataFrame:
    """Counts and aggregates of event-time windows, late rows accepted for ``delay``."""
    out = stream.withWatermark(time, delay).groupBy(F.window(time, width), *by)
    return out.agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in aggregates.items())).select(F.col("window.start").alias("start"), *by, "n", *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, delay: str, by: list[str]) -> DataFrame:
    """Sessions that end after a gap of silence."""
    out = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def _in_order(batches: Iterator[pd.DataFrame], order: list[str], columns: list[str]) -> Iterator[tuple]:
    """All of a key's rows of a micro-batch in order, as tuples of ``columns``, which start with ``order``.

    Spark hands them over in chunks that are not in order.  A lone chunk is sorted; more are sorted runs in a temporary
    file, merged piece by piece, so memory holds a chunk and a piece of each run."""
    sort = lambda chunk: chunk.sort_values(order, kind="stable")[columns].itertuples(index=False, name=None)
    first = next(batches, None)
    if first is None:
        return
    second = next(batches, None)
    if second is None:
        yield from sort(first)
        return
    with tempfile.TemporaryFile() as file:
        ends: list[tuple[int, int]] = []

        def spill(chunk: pd.DataFrame) -> None:
            start, rows = file.tell(), list(sort(chunk))
            for i in range(0, len(rows), 256):
                pickle.dump(rows[i : i + 256], file)
            ends.append((start, file.tell()))

        def read(at: int, end: int) -> Iterator[tuple]:
            while at < end:
                file.seek(at)
                piece = pickle.load(file)
                at = file.tell()
                yield from piece

        for chunk in (first, second):
            spill(chunk)
        del first, second, chunk
        for chunk in batches:
            spill(chunk)
        yield from heapq.merge(*(read(*span) for span in ends), key=lambda row: row[: len(order)])


#: Rows of a key that a state function returns at once.
PIECE = 10_000


def versions(stream: DataFrame, key: str, fingerprint: str, time: str, tie: str | None = None, forget: str | None = None) -> DataFrame:
    """(key, fingerprint, version): a row whenever a record's fingerprint changes; the state is the last one seen.

    Rows of a micro-batch are taken by ``time``, then ``tie``; a row that comes in a later micro-batch counts as later.  With
    ``forget`` (a duration; ``time`` must be a timestamp) a record that was not seen for so long leaves the state and starts
    again at version one; without it every key stays."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    order = [time] if tie is None else [time, tie]
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000) if forget else None

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, version, seen = state.get if state.exists else (None, 0, None)
        out = []
        for row in _in_order(batches, order, [*order, fingerprint]):
            at = int(pd.Timestamp(row[0]).value // 1_000_000) if forget_ms is not None else None
            if forget_ms is not None and seen is not None and at - seen > forget_ms:  # settled by time, not by when a timer runs
                last, version = None, 0
            seen = at
            if row[-1] != last:
                last, version = row[-1], version + 1
                out.append((k[0], last, version))
                if len(out) == PIECE:
                    yield pd.DataFrame(out, columns=[key, fingerprint, "version"])
                    out = []
        state.update((last, version, seen))
        if forget_ms is not None:
            state.setTimeoutTimestamp(max(seen + forget_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[key, fingerprint, "version"])

    rows = stream if forget is None else stream.withWatermark(time, forget)
    kind = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.EventTimeTimeout
    return rows.select(*dict.fromkeys([key, fingerprint, *order])).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {fingerprint} {kinds[fingerprint]}, version long", f"last {kinds[fingerprint]}, version long, seen long", "append", kind
    )


def fan_out(stream: DataFrame, topic: str, topics: list[str], root: str, checkpoint: str) -> StreamingQuery:
    """Rows to one folder a topic; a batch that is run again writes its folder again, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for name in topics:
            held.where(F.col(topic) == name).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        held.where(~F.col(topic).isin(*topics) | F.col(topic).isNull()).write.mode("overwrite").parquet(f"{root}/dead_letter/batch={number}")
        held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, table: str, checkpoint: str, path: str, mode: str = "append", before: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs the stream over all files there are and returns what it wrote."""
    out = before(stream) if before else stream
    query = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).queryName(table).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(path)
