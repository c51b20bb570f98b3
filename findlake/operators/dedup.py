"""Deduplication and retention: rank-then-latest winners, keyed overwrites, newest-N, eviction.

Spark keeps no row order, so every operator takes explicit ordinals; where the ordinal ties, the largest row id wins.
Winners are struct maxima (partial aggregation before the shuffle), not windows, so a hot key is reduced map-side.
Null keys form a group of their own; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far a status has progressed; a higher rank carries more information.
STATUS_RANK = {
    "exploitable": 7, "confirmed_constrained": 6, "confirmed_blocked": 6, "confirmed_unverified": 5, "confirmed": 5,
    "ruled_out": 4, "disproven": 4, "false_positive": 4, "test_code": 4, "dead_code": 4, "mitigated": 4, "unreachable": 4,
    "poc_success": 3, "not_disproven": 2,
}


def lookup(col: Column, table: dict, default: object = None) -> Column:
    """The value of a fixed mapping, default for other keys and null."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, col), F.lit(default))


def best_rows(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row per key: the one with the greatest order (compared column by column, nulls least)."""
    best = F.max(F.struct(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("o"), F.struct(*keep).alias("r"))).alias("m")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"m.r.{c}").alias(c) for c in keep])


def merge_by_status(df: DataFrame, keys: list[str], status: str, run: str, row: str, refs: str) -> DataFrame:
    """keys, status, run, row, refs: per key the most progressed row, of equals the latest; refs of all rows united.

    References are made distinct per key before they are gathered, so a hot key gathers each of them once."""
    best = F.max(F.struct(lookup(F.col(status), STATUS_RANK, 0).alias("_rank"), F.col(run).alias("run"), F.col(row).alias("row"), F.col(status).alias("status"))).alias("m")
    winners = df.groupBy(*keys).agg(best).select(*keys, F.col("m.status").alias(status), F.col("m.run").alias(run), F.col("m.row").alias(row))
    named = df.select(*keys, F.explode(refs).alias("_ref")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("_ref")).alias("refs"))
    same = [winners[k].eqNullSafe(named[k]) for k in keys]
    joined = winners.join(named, same, "left")
    return joined.select(*[winners[c] for c in winners.columns], F.coalesce(named["refs"], F.array().cast("array<string>")).alias("refs"))


def numbered(df: DataFrame, keys: list[str], bucket: list[Column], order: list[Column], name: str) -> DataFrame:
    """df with a running number per key in the order (bucket, order).

    The window runs per key and bucket, and the rows of the buckets before are counted beforehand, so no task sorts all
    rows of a hot key; `bucket` must never decrease along the order (nulls first)."""
    cols = [f"_b{k}" for k in range(len(bucket))]
    marked = df.withColumns(dict(zip(cols, bucket)))
    sizes = marked.groupBy(*keys, *cols).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_first(c) for c in cols]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"_o{c}") for c in [*keys, *cols]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy(*keys, *cols).orderBy(*order))
    met = marked.withColumn("_k", own)
    joined = met.join(offsets, [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in [*keys, *cols]])
    return joined.select(*df.columns, (F.col("_k") + F.col("_off")).alias(name))


def keep_newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n newest rows of each key, with their rank; the limit is applied before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_no", F.row_number().over(window)).where(F.col("rank_no") <= n)


def first_seen(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Distinct keys with the position of their first row."""
    return df.groupBy(*keys).agg(F.min(position).alias(position))


def evict(df: DataFrame, living: DataFrame, key: str, keep: Column) -> DataFrame:
    """Rows whose key still lives, and rows that are kept whatever happened to their key."""
    alive = living.select(key).distinct().withColumn("_alive", F.lit(True))
    return df.join(alive, key, "left").where(F.col("_alive") | keep).drop("_alive")


def union_flagged(first: DataFrame, second: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows of both by key, the first list's first row winning; `in_second` marks keys that the second has too."""
    both = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))
    keep = [c for c in first.columns if c not in keys]
    best = F.min(F.struct("_src", F.col(position).alias("_pos"), F.struct(*keep).alias("r"))).alias("m")
    return both.groupBy(*keys).agg(best, F.max("_src").alias("_any")).select(*keys, *[F.col(f"m.r.{c}").alias(c) for c in keep], (F.col("_any") == 1).alias("in_second"))
