"""The status machine of deliveries: only legal transitions change a delivery's status; the others are emitted as refused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The statuses that may follow a status; a delivery begins with none.
LEGAL = {"": ["PENDING"], "PENDING": ["SKIPPED", "ACCEPTED", "FAILED"], "ACCEPTED": ["PROCESSED", "FAILED"], "SKIPPED": [], "PROCESSED": [], "FAILED": []}

OUT = "deliveryId string, at timestamp, status string, before string, accepted boolean"
#: How long an event may come late; as long it waits for earlier ones.
WATERMARK = "1 hour"
#: Entries of a stream's state at most; a call, which costs some 10 ms by itself, takes all deliveries of one.
BUCKETS = 1 << 11
_STATE = "ids array<string>, statuses array<string>, waiting array<string>, times array<long>, wanted array<string>"


def _accepts(before: Column, wanted: Column) -> Column:
    """Whether a status follows another one; false for statuses without followers, and null for none."""
    out = F.lit(False)
    for status, followers in LEGAL.items():
        if followers:
            out = F.when(before == status, wanted.isin(followers)).otherwise(out)
    return out


def _depth(status: str = "") -> int:
    """The longest run of legal transitions."""
    return max((1 + _depth(s) for s in LEGAL.get(status, [])), default=0)


def transitions(events: DataFrame) -> DataFrame:
    """T5 over a table (deliveryId, at, status): each event with the status before it and whether it was accepted. Repeated events
    are steps of their own; null keys, times and statuses are left out. A delivery's events meet in one task, which sorts
    them and passes over them once for each step of the machine: the first event that may follow a step's status is the next."""
    earlier = Window.partitionBy("deliveryId").orderBy("at", "status").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.select("deliveryId", "at", "status").dropna().withColumn("s0", F.lit(""))
    for n in range(_depth()):
        rows = rows.withColumn(f"s{n + 1}", F.first(F.when(_accepts(F.col(f"s{n}"), F.col("status")), F.col("status")), ignorenulls=True).over(earlier))
    before = F.coalesce(*(F.col(f"s{n}") for n in reversed(range(_depth() + 1))))
    rows = rows.select("deliveryId", "at", "status", before.alias("before"))
    return rows.withColumn("accepted", F.coalesce(_accepts(F.col("before"), F.col("status")), F.lit(False)))


def transition_stream(events: DataFrame, watermark: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """T5 over a stream (deliveryId, at, status): the same rows, once the watermark has passed an event, so that events which come
    in another order than they happened are taken in order. The state of a delivery is its status and what waits; events
    that come behind the watermark are dropped with it. Deliveries are dealt to buckets, one call and one entry of the state
    each, so a batch costs no call for each delivery; the number of buckets stays with a checkpoint."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, known, *held = state.get if state.exists else ([], [], [], [], [])
        now, waiting = dict(zip(ids, known, strict=True)), list(zip(*held, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                times = f["at"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
                waiting += zip(f["deliveryId"].tolist(), times, f["status"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        rows = []
        for delivery, at, wanted in sorted(e for e in waiting if e[1] <= passed):
            before = now.get(delivery, "")
            accepted = wanted in LEGAL.get(before, ())
            rows.append((delivery, at, wanted, before, accepted))
            if accepted:
                now[delivery] = wanted
        waiting = [e for e in waiting if e[1] > passed]
        state.update((list(now), list(now.values()), *([e[i] for e in waiting] for i in range(3))))
        if waiting:
            state.setTimeoutTimestamp(max(min(e[1] for e in waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if rows:
            d, at, wanted, before, accepted = zip(*rows, strict=True)
            yield pd.DataFrame({"deliveryId": d, "at": np.array(at, "datetime64[us]"), "status": wanted, "before": before, "accepted": np.array(accepted)})

    rows = events.select("deliveryId", "at", "status").dropna().withWatermark("at", watermark)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("deliveryId"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(run, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
