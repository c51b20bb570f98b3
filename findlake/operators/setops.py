"""Comparisons of two versions of a keyed table, and inclusion between sets.

Full outer joins on the key after both sides were reduced to one row per key; a hash that is missing has a meaning of
its own, given per operator. Null keys match nothing. Two empty sides give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, old_value, new_value, change: added, removed, changed or unchanged (two nulls are unchanged)."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, "old_value", "new_value", change.alias("change"))


def diff_hashes(old: DataFrame, new: DataFrame, keys: list[str], value: str, *, missing_changes: bool) -> DataFrame:
    """diff, where a missing hash on either side counts as changed (missing_changes) or as unchanged."""
    compared = diff(old, new, keys, value)
    missing = F.col("old_value").isNull() | F.col("new_value").isNull()
    both = F.col("change").isin("changed", "unchanged") & missing
    return compared.withColumn("change", F.when(both, "changed" if missing_changes else "unchanged").otherwise(F.col("change")))


def set_diff(old: DataFrame, new: DataFrame, bucket: str, item: str) -> DataFrame:
    """bucket, added, removed: the sorted items that only the new or only the old version of a bucket has."""
    sides = old.select(bucket, item, F.lit(1).alias("o")).unionByName(new.select(bucket, item, F.lit(2).alias("o"))).groupBy(bucket, item).agg(F.collect_set("o").alias("s"))
    only = lambda k: F.array_sort(F.collect_list(F.when((F.size("s") == 1) & F.array_contains("s", k), F.col(item))))
    return sides.groupBy(bucket).agg(only(2).alias("added"), only(1).alias("removed"))


def subsumed(victims: DataFrame, survivors: DataFrame, victim: str, items: list[str]) -> DataFrame:
    """victim, n_items, n_lost, lossless: how many of a victim's items no survivor has."""
    kept = survivors.select(*items).distinct().withColumn("_kept", F.lit(1))
    own = victims.select(victim, *items).distinct().join(kept, items, "left")
    lost = F.count_if(F.col("_kept").isNull())
    return own.groupBy(victim).agg(F.count("*").alias("n_items"), lost.alias("n_lost"), (lost == 0).alias("lossless"))


def overlap_counts(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """n_only_base, n_only_other, n_common, suppressed_share (share of the base that is gone; null for an empty base)."""
    sides = base.select(key).distinct().withColumn("_a", F.lit(True)).join(other.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    only_a, only_b = F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())
    common = F.count_if(F.col("_a") & F.col("_b"))
    return sides.agg(only_a.alias("n_only_base"), only_b.alias("n_only_other"), common.alias("n_common"), F.round(F.try_divide(only_a, only_a + common), 6).alias("suppressed_share"))


