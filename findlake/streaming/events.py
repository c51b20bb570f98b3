"""Event streams: the batch measures kept up to date with Structured Streaming.

State is bounded by watermarks (deduplication, windows) or by the number of keys (running totals). Sinks that must not
count twice go through foreachBatch with the batch id as part of what is written."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(EVENT).option("maxFilesPerTrigger", files_per_batch).load(path)


def running_totals(events: DataFrame) -> DataFrame:
    """Calls, completed calls and cost per class (complete or update mode); state: one row per class."""
    done = F.col("value") >= 5
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(done).alias("n_completed"), F.sum("value").alias("cost"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per class and window; later events than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def once_each(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once, however often it is sent within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def plateau_stream(events: DataFrame, seconds: int, new_type: str = "signup", late: str = "1 day") -> DataFrame:
    """user_id, at: the moment at which a user has gone `seconds` of event time without a new_type event, once per spell.

    A spell begins with a new_type event and ends with the next one. It is told as soon as it is known to have lasted
    `seconds`: by any later event of the user or, for a silent user, by the watermark (event-time timeout). Events may come
    in any order within `late` and may be sent again: a spell is known by its beginning and never told twice; one that is
    told is not taken back by an event that comes late. State: the beginnings since the watermark and the last one before
    it; it ends when the watermark has passed a told spell and nothing is newer. Null users, times and types don't count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"told": {}, "newest": None}
        told, newest = {float(k): v for k, v in kept["told"].items()}, kept["newest"]
        for pdf in batches:
            for ts, kind in pdf[["ts", "event_type"]].itertuples(index=False):
                t = ts.timestamp()
                newest = t if newest is None else max(newest, t)
                if kind == new_type:
                    told.setdefault(t, False)
        mark = state.getCurrentWatermarkMs() / 1000
        begins, out = sorted(told), []
        for begin, end in zip(begins, [*begins[1:], max(newest if newest is not None else mark, mark)]):
            if end - begin >= seconds and not told[begin]:
                told[begin] = True
                out.append((key[0], pd.Timestamp(begin + seconds, unit="s")))
        passed = [t for t in begins if t < mark]
        for begin in passed[:-1]:  # behind the watermark only the last one can still go on
            del told[begin]
        if all(told.values()) and (newest is None or newest < mark):
            state.remove()
        else:
            state.update((json.dumps({"told": told, "newest": newest}),))
            open_ones = [t + seconds for t, done in told.items() if not done]
            state.setTimeoutTimestamp(int(max(min(open_ones, default=newest), mark) * 1000) + 1)
        yield pd.DataFrame({"user_id": pd.Series([u for u, _ in out], dtype="int64"), "at": pd.Series([t for _, t in out], dtype="datetime64[ns]")})

    usable = events.where("user_id is not null and ts is not null and event_type is not null").withWatermark("ts", late)
    return usable.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, at timestamp", "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def append_log(df: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """An append-only log; every input row is written once."""
    return df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def upsert_counts(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch's counts into a Parquet table of parts: a batch that is repeated overwrites its own part."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("event_type").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_line(df: DataFrame, name: str, every: str = "2 seconds") -> StreamingQuery:
    """A status that is refreshed at most so often, as an in-memory table."""
    return df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(processingTime=every).start()
