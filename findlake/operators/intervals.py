"""Interval algebra over covered lines: coalescing, deltas, percentages, who looked at what.

marks(file, tool, lo, hi): inclusive integer intervals; overlapping and adjacent ones (5 and 6) are one. Distinct marks
are taken first; per file they are bounded by its lines. Marks with a null or with lo > hi are none. Empty input gives
empty output, an unknown total gives 0 percent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesce(marks: DataFrame, by: list[str]) -> DataFrame:
    """by, lo, hi: disjoint intervals that are not adjacent."""
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = marks.where("lo is not null and hi is not null and lo <= hi").select(*by, "lo", "hi").distinct()
    starts = rows.withColumn("_s", (F.col("lo") > F.coalesce(F.max("hi").over(before) + 1, F.col("lo") - 1)).cast("int"))
    return starts.withColumn("_g", F.sum("_s").over(order)).groupBy(*by, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def length(lo: str = "lo", hi: str = "hi") -> Column:
    return F.col(hi) - F.col(lo) + 1


def covered(marks: DataFrame, by: list[str]) -> DataFrame:
    """by, n_lines: covered lines."""
    return coalesce(marks, by).groupBy(*by).agg(F.sum(length()).alias("n_lines"))


def delta(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """by, n_new: lines that the new marks add to the old ones."""
    both = covered(old.select(*by, "lo", "hi").unionByName(new.select(*by, "lo", "hi")), by)
    was = covered(old, by).withColumnRenamed("n_lines", "_was")
    return both.join(was, by, "left").join(new.select(*by).distinct(), by, "left_semi").select(*by, (F.col("n_lines") - F.coalesce("_was", F.lit(0))).alias("n_new"))


def percent(marks: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """by, n_lines, percent of the total; 0 where the total is unknown or 0."""
    done = covered(marks, by).join(totals.select(*by, "total"), by, "left")
    return done.select(*by, "n_lines", F.round(F.coalesce(F.try_divide(100.0 * F.col("n_lines"), F.col("total")), F.lit(0.0)), 4).alias("percent"))


def meets(marks: DataFrame, spans: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Lines of each span that the (coalesced) marks of `by` cover: key, name, span_lines, by, n_lines.

    Blocked on the key and on blocks of 256 lines, so a span meets only the marks near it."""
    block = lambda lo, hi: F.explode(F.sequence(F.floor(lo / 256), F.floor(hi / 256)))
    m = coalesce(marks, [key, *by]).select(key, *by, F.col("lo").alias("m_lo"), F.col("hi").alias("m_hi")).withColumn("_b", block(F.col("m_lo"), F.col("m_hi")))
    s = spans.select(key, "name", "lo", "hi").withColumn("_b", block(F.col("lo"), F.col("hi")))
    both = s.join(m, [key, "_b"])
    edge = F.col("_b") * 256
    met = F.least("hi", "m_hi", edge + 255) - F.greatest("lo", "m_lo", edge) + 1
    return both.where(met > 0).groupBy(key, "name", *by).agg(F.first(length()).alias("span_lines"), F.sum(met).alias("n_lines"))


def line_set(marks: DataFrame, by: list[str]) -> DataFrame:
    """The same answer as `covered` from sets of lines: the representation for files with many short marks."""
    rows = marks.where("lo is not null and hi is not null and lo <= hi").select(*by, F.explode(F.sequence("lo", "hi")).alias("line")).distinct()
    bits = rows.groupBy(*by, F.bitmap_bucket_number(F.col("line")).alias("_k")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("line")))).alias("n"))
    return bits.groupBy(*by).agg(F.sum("n").alias("n_lines"))
