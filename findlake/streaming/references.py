"""Orphan references over a stream: the keyed state is a table per batch in the shared folder.

A batch reads the state of the batch before, writes its own and what it found; a batch that is repeated after a failure
overwrites its own parts, so nothing is counted twice. State: one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from findlake.operators import orphans

LOG = "key string, at timestamp_ntz, kind int, n int, row long"


def follow(log: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """log(LOG): kind 0 an arrival, 1 a deletion, 2 a reference (row its id). See latest_state and found_so_far."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(orphans.STATE).parquet(f"{folder}/state/{batch_id - 1}") if batch_id else spark.createDataFrame([], orphans.STATE)
        rows = batch.where(F.col("key").isNotNull() & F.col("at").isNotNull()).persist()
        new, found = orphans.advance(state, rows.where("kind < 2").drop("row"), rows.where("kind = 2").select("row", "key", "at"))
        found.write.mode("overwrite").parquet(f"{folder}/found/batch={batch_id}")
        new.write.mode("overwrite").parquet(f"{folder}/state/{batch_id}")
        rows.unpersist()

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report(spark, folder: str, last_batch: int) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(settled orphans, open count) after the given batch."""
    state = spark.read.schema(orphans.STATE).parquet(f"{folder}/state/{last_batch}")
    found = spark.read.parquet(f"{folder}/found").where(F.col("batch") <= last_batch).drop("batch")
    return orphans.settle(found, state), orphans.open_count(state)
