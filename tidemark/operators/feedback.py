"""Alert policies whose decisions feed back: an alert counts against the next ones only if it was sent."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Decisions in the order in which they are taken; the first that applies stands.
DUPLICATE, EQUIVALENT, LIMITED, BYPASS, SENT = "duplicate_dedupe_key", "equivalent_recent_alert", "rate_limited", "official_bypass", "sent"


class Policy:
    """What has been sent to one user, as far back as the windows reach."""

    def __init__(self, limit: int, limit_us: int, repeat_us: int, dedupe_us: int):
        self.limit, self.limit_us, self.repeat_us, self.dedupe_us = limit, limit_us, repeat_us, dedupe_us
        self.sent: deque[int] = deque()
        self.by_event: dict[object, tuple[int, int]] = {}
        self.keys: dict[object, int] = {}
        self.swept = 0

    def decide(self, at: int, event: object, key: object, urgency: int, official: bool) -> str:
        while self.sent and self.sent[0] < at - self.limit_us:
            self.sent.popleft()
        if len(self.by_event) + len(self.keys) > 2 * self.swept + 64:  # what the windows have left behind goes
            self.by_event = {e: v for e, v in self.by_event.items() if v[0] >= at - self.repeat_us}
            self.keys = {k: v for k, v in self.keys.items() if v >= at - self.dedupe_us}
            self.swept = len(self.by_event) + len(self.keys)
        if self.keys.get(key, at - self.dedupe_us - 1) >= at - self.dedupe_us:
            return DUPLICATE
        before, rank = self.by_event.get(event, (at - self.repeat_us - 1, 0))
        if not official:
            if before >= at - self.repeat_us and urgency <= rank:
                return EQUIVALENT
            if 0 < self.limit <= len(self.sent):
                return LIMITED
        self.sent.append(at)
        self.by_event[event] = (at, urgency)
        self.keys[key] = at
        return BYPASS if official else SENT


def segments(rows: DataFrame, user: str, time_us: str, reach_us: int) -> DataFrame:
    """``rows`` with the column segment: a user's rows fall into segments with more than ``reach_us`` of silence between them.

    Found over counted buckets of ``reach_us``: two empty-sided runs of buckets are apart by more than the reach, so a user's
    rows are never sorted as a whole and a busy user is cut wherever it rests."""
    bucketed = rows.withColumn("__bucket", F.floor(F.col(time_us) / reach_us).cast("long"))
    buckets = bucketed.select(F.col(user).alias("__u"), F.col("__bucket").alias("__b")).distinct()
    by = Window.partitionBy("__u").orderBy("__b")
    starts = buckets.withColumn("__s", F.coalesce(F.col("__b") - F.lag("__b").over(by) > 1, F.lit(True)).cast("int"))
    numbered = starts.select("__u", "__b", F.sum("__s").over(by).cast("long").alias("segment"))
    return bucketed.join(numbered, F.col(user).eqNullSafe(F.col("__u")) & (F.col("__bucket") == F.col("__b"))).drop("__bucket", "__u", "__b")


def sent_alerts(candidates: DataFrame, limit: int, limit_us: int, repeat_us: int, dedupe_us: int) -> DataFrame:
    """(alert_id, user_id, decision) of candidates (alert_id, user_id, us, event_id, dedupe_key, urgency, official).

    * A dedupe key that was sent in ``dedupe_us`` is refused, officials included.
    * An alert on an event that the user was sent one about in ``repeat_us`` is refused unless it is more urgent.
    * More than ``limit`` alerts sent in ``limit_us`` are refused; a limit of zero or less refuses none.  Windows hold both ends.
    * Officials pass the last two and count as sent.

    Only sent alerts count, which no window function can say.  Each segment of a user between silences longer than every window
    is one ordered pass over sorted partitions, with the windows' sent alerts as its state; a user without such silences is one
    pass, as the recursion demands.  Ties in time go by alert_id.  A candidate without a time has no decision; a null user is a
    user, a null urgency the lowest, a null official none."""
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    shown = candidates.where(F.col("us").isNotNull()).select("alert_id", "user_id", "us", "event_id", "dedupe_key", F.coalesce("urgency", F.lit(-(2**31))).cast("int").alias("urgency"), F.coalesce("official", F.lit(False)).alias("official"))
    cut = segments(shown, "user_id", "us", max(limit_us, repeat_us, dedupe_us) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, policy = None, None
        for batch in batches:
            out = []
            for alert, user, segment, at, event, key, urgency, official in zip(*(c.to_pylist() for c in batch.columns)):
                if policy is None or held != (user, segment):
                    held, policy = (user, segment), Policy(limit, limit_us, repeat_us, dedupe_us)
                out.append(policy.decide(at, event, key, urgency, official))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["alert_id", "user_id", "decision"])

    order = cut.select("alert_id", "user_id", "segment", "us", "event_id", "dedupe_key", "urgency", "official")
    order = order.repartition("user_id", "segment").sortWithinPartitions("user_id", "segment", "us", "alert_id")
    return order.mapInArrow(run, f"alert_id {kinds['alert_id']}, user_id {kinds['user_id']}, decision string")
