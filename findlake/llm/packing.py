"""Filling fixed-capacity containers with items by cost-balanced packing.

The cost of a sequence is estimated as linear in its tokens plus quadratic in each of its items (attention stays
within an item). Items are assigned in descending size to the sequence of lowest cost that has room for them. The
number of sequences starts at the fewest that could hold all items, so the costs come out even and nearly all room
is used; only what fits nowhere opens further sequences.

An item longer than the capacity is split: its full pieces fill containers of their own, and the rest is packed like
any other item. No other item is split.

Scale: items are spread by a hash of their key over shards of about SHARD items, which are packed independently; a
shard leaves at most a few containers partly filled, i.e. some thousandths of its room. Nothing is collected beyond a
shard, and one key is one item, so there is no hot group.

Defined cases: null and empty texts are items of size 0, which take a place in a container but no room; items of equal
size are taken in the order of their keys, so the result doesn't depend on row order; rows that repeat a key are items
of their own. Items with a null key are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: Items per shard.
SHARD = 20_000
#: Weights of the cost: per token, and per squared token of an item.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def assign(sizes: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[int]:
    """The sequence of each item; sizes descend and are at most the capacity."""
    total = sum(sizes)
    n = max(1, -(-total // capacity)) if sizes else 0
    room = [capacity] * n
    heap: list[tuple[float, int]] = [(0.0, i) for i in range(n)]
    #: sequences without room for the present size, by the room they have
    parked: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    out: list[int] = []
    present = capacity
    for size in sizes:
        while present > size:  # sizes have fallen: sequences with that much room are open again
            present -= 1
            for entry in parked[present]:
                heapq.heappush(heap, entry)
            parked[present] = []
        while heap and room[heap[0][1]] < size:
            entry = heapq.heappop(heap)
            parked[room[entry[1]]].append(entry)
        if heap:
            cost, k = heapq.heappop(heap)
        else:
            cost, k = 0.0, len(room)
            room.append(capacity)
        room[k] -= size
        heapq.heappush(heap, (cost + linear * size + quadratic * size * size, k))
        out.append(k)
    return out


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """shard, key, n of each item -> a row per piece; see pack."""
    shard = int(pdf["shard"].iloc[0])
    pdf = pdf.sort_values(["key"], kind="stable")
    full = (pdf["n"] // capacity).to_numpy()
    rest = (pdf["n"] % capacity).to_numpy()
    has_rest = (rest > 0) | (full == 0)
    # full pieces: a container each
    owner = np.repeat(np.arange(len(pdf)), full)
    piece = np.concatenate([np.arange(k) for k in full]) if len(owner) else np.array([], dtype=np.int64)
    rows = [pd.DataFrame({"i": owner, "piece_no": piece, "container": np.arange(len(owner)), "place": 1, "start_token": 0, "n_tokens": capacity})]
    items = np.flatnonzero(has_rest)
    items = items[np.argsort(-rest[items], kind="stable")]
    sizes = rest[items]
    container = np.array(assign(sizes.tolist(), capacity), dtype=np.int64) + len(owner)
    packed = pd.DataFrame({"i": items, "piece_no": full[items], "container": container, "n_tokens": sizes})
    grouped = packed.groupby("container")["n_tokens"]
    packed["place"] = grouped.cumcount() + 1
    packed["start_token"] = grouped.cumsum() - packed["n_tokens"]
    out = pd.concat([*rows, packed], ignore_index=True)
    keys = pdf["key"].to_numpy()[out["i"].to_numpy(dtype=np.int64)]
    return pd.DataFrame(
        {
            "key": keys, "piece_no": out["piece_no"].astype("int32") + 1, "container_id": (np.int64(shard) << 32) + out["container"].astype("int64"),
            "place": out["place"].astype("int32"), "start_token": out["start_token"].astype("int32"), "n_tokens": out["n_tokens"].astype("int32"),
        }
    )


def pack(sizes: DataFrame, key: str, size: str = "n_tokens", capacity: int = CAPACITY, shard_items: int = SHARD, n_items: int | None = None) -> DataFrame:
    """key, piece_no, container_id, place, start_token, n_tokens: where each piece of each item lies.

    n_items: the number of items if it is known (else they are counted); it only sets the number of shards."""
    kind = sizes.schema[key].dataType.simpleString()
    n = sizes.count() if n_items is None else n_items
    shards = max(1, -(-n // shard_items))
    items = sizes.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    packed = items.groupBy("shard").applyInPandas(lambda pdf: pack_shard(pdf, capacity), f"key {kind}, piece_no int, container_id long, place int, start_token int, n_tokens int")
    return packed.withColumnRenamed("key", key)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_containers, n_tokens, unused_share of a packing."""
    return packed.agg(
        F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"),
        (1 - F.sum("n_tokens") / (F.countDistinct("container_id") * capacity)).alias("unused_share"),
    )


def audit(packed: DataFrame, docs: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """n_documents, n_missing, n_over_capacity, n_overlapping, n_split_needlessly: what a packing must keep. Documents
    without a place, containers above their capacity, pieces that don't begin where the one before ends, and documents in
    more pieces than their length needs; all but the first are 0 in a right packing."""
    pieces = packed.groupBy(key).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    missing = docs.select(key).where(F.col(key).isNotNull()).distinct().join(pieces.select(key), key, "left_anti").agg(F.count("*").alias("n_missing"))
    needless = pieces.agg(F.count("*").alias("n_documents"), F.count_if(F.col("n") > F.greatest(F.ceil(F.col("t") / capacity), F.lit(1))).alias("n_split_needlessly"))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("container_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = packed.withColumn("gap", F.col("start_token") != before).groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count_if("gap").alias("gaps"))
    rooms = places.agg(F.count_if(F.col("t") > capacity).alias("n_over_capacity"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("n_overlapping"))
    return needless.crossJoin(missing).crossJoin(rooms)  # one row each
