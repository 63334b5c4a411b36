"""Upload queues as a stream: events fold into a state a device, and what is pending comes out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_ATTEMPTS, TTL_MS = 5, 24 * 60 * 60 * 1000


def is_pending(status: Column, attempts: Column, most: int = MAX_ATTEMPTS) -> Column:
    """Queued, or an error that may be tried again; an upload that a restart cut short counts as queued."""
    return status.isin("queued", "uploading") | ((status == "error") & (attempts < most))


def next_pending(items: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Each device's first pending item, in order of arrival."""
    row = F.struct(*items.columns)
    return items.filter(is_pending(F.col("status"), F.col("attempts"), most)).groupBy("device").agg(F.min_by(row, F.struct("created_ms", "id")).alias("r")).select("r.*")


def pending_count(items: DataFrame) -> DataFrame:
    return items.groupBy("device").agg(F.count_if(F.col("status") != "done").alias("pending"))


def prune(items: DataFrame, now_ms: int, ttl_ms: int = TTL_MS) -> DataFrame:
    return items.filter((F.col("status") != "done") | (F.lit(now_ms) - F.col("created_ms") < ttl_ms))


def retry_all(items: DataFrame) -> DataFrame:
    """Every item in error is queued again; attempts stay."""
    return items.withColumn("status", F.when(F.col("status") == "error", "queued").otherwise(F.col("status")))


def fold(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """A stream of (device, id, action, at_ms) -> for each device and batch: pending, next_id, dropped.

    Actions: enqueue, done, error (one more attempt), remove, retry (attempts from 0), retry_all (whatever its
    id: all items in error are queued again, attempts stay). Items that are done go after
    their time to live, by the latest event's clock. State is one small list a device.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items = {r[0]: list(r) for r in (state.get[0] if state.exists else [])}
        now = 0
        rows = pd.concat(list(frames)).sort_values(["at_ms", "id"], kind="stable")
        for id_, action, at in zip(rows["id"], rows["action"], rows["at_ms"], strict=True):
            now = max(now, int(at))
            if action == "enqueue":
                items.setdefault(int(id_), [int(id_), "queued", 0, int(at)])
            elif action == "retry_all":
                for item in items.values():
                    item[1] = "queued" if item[1] == "error" else item[1]
            elif int(id_) in items:
                if action == "remove":
                    del items[int(id_)]
                    continue
                item = items[int(id_)]
                item[1] = {"done": "done", "error": "error", "retry": "queued"}[action]
                item[2] = item[2] + 1 if action == "error" else 0 if action == "retry" else item[2]
        keep = [i for i in items.values() if i[1] != "done" or now - i[3] < ttl_ms]
        state.update(([tuple(i) for i in keep],))
        waiting = sorted((i[3], i[0]) for i in keep if i[1] == "queued" or i[1] == "error" and i[2] < MAX_ATTEMPTS)
        yield pd.DataFrame({"device": [key[0]], "pending": [sum(i[1] != "done" for i in keep)], "next_id": pd.array([waiting[0][1] if waiting else None], "Int64"), "dropped": [len(items) - len(keep)]})

    return events.groupBy("device").applyInPandasWithState(step, "device long, pending long, next_id long, dropped long", "items array<struct<id:long,status:string,attempts:int,created_ms:long>>", "update", GroupStateTimeout.NoTimeout)
