"""Measures over labelled and counted rows. Ratios with an empty denominator are null unless a docstring says 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: mean length of a month in days.
MONTH_DAYS = 30.44


def ratio(num: Column, den: Column, digits: int = 6) -> Column:
    """num / den rounded; null for an empty denominator."""
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), digits)


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1; rows with a null on either side don't count."""
    both = lambda p, a: F.count_if((predicted == p) & (actual == a))
    out = df.groupBy(*(by or [])).agg(both(True, True).alias("tp"), both(True, False).alias("fp"), both(False, False).alias("tn"), both(False, True).alias("fn"))
    return out.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def census(df: DataFrame, dims: list[str], sets: list[list[str]]) -> DataFrame:
    """dims, n: counts of each grouping set in one pass; dims outside a set are null. level tells the set."""
    df.createOrReplaceTempView("_findlake_census")
    listed = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    return df.sparkSession.sql(f"SELECT {', '.join(dims)}, grouping_id({', '.join(dims)}) AS level, count(*) AS n FROM _findlake_census GROUP BY {', '.join(dims)} GROUPING SETS ({listed})")


def decay_weight(month: Column, now: str, half_life_days: float | None) -> Column:
    """0.5 ^ (age / half life) of a YYYY-MM bucket; the present month and later ones weigh 1, as all do without decay."""
    months = (F.lit(int(now[:4])) - F.substring(month, 1, 4).cast("int")) * 12 + F.lit(int(now[5:7])) - F.substring(month, 6, 2).cast("int")
    if not half_life_days or half_life_days <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(months, F.lit(0)) * MONTH_DAYS / half_life_days)


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, rho: rank correlation with ties averaged; null for fewer than two rows or a constant side.

    Ranks come from counted values, so the windows see distinct values per group, not rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(*by, c).agg(F.count("*").alias("_k"))
        below = F.sum("_k").over(Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        return counts.select(*by, c, (F.coalesce(below, F.lit(0)) + (F.col("_k") + 1) / 2).alias(f"_r{c}"))

    ranked = rows.join(ranks(x), [*by, x]).join(ranks(y), [*by, y])
    rho = F.try_divide(F.covar_pop(f"_r{x}", f"_r{y}"), F.stddev_pop(f"_r{x}") * F.stddev_pop(f"_r{y}"))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("rho"), F.countDistinct(x).alias("_dx"), F.countDistinct(y).alias("_dy"))
    constant = (F.col("_dx") < 2) | (F.col("_dy") < 2)
    return out.select(*by, "n", F.when(~constant, F.round("rho", 6)).alias("rho"))


def top_precision(df: DataFrame, by: list[str], order: list[Column], positive: Column, n: int) -> DataFrame:
    """by, n_taken, precision of the n best rows of each group (the limit is applied before the shuffle); 0 if empty."""
    window = Window.partitionBy(*by).orderBy(*order)
    top = df.withColumn("_k", F.row_number().over(window)).where(F.col("_k") <= n)
    return top.groupBy(*by).agg(F.count("*").alias("n_taken"), F.round(F.coalesce(F.avg(positive.cast("int")), F.lit(0.0)), 6).alias("precision"))


def majority_deviation(df: DataFrame, by: list[str], value: str, *, least_rows: int, least_values: int, share: float) -> DataFrame:
    """by, value, n, share of the values that deviate from the majority of their group, where the group has enough rows
    and values and its most frequent value at least `share` of them."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    wide = counts.withColumns({"total": F.sum("n").over(group), "top": F.max("n").over(group), "kinds": F.count("*").over(group)})
    ok = (F.col("total") >= least_rows) & (F.col("kinds") >= least_values) & (F.col("top") / F.col("total") >= share) & (F.col("n") < F.col("top"))
    return wide.where(ok).select(*by, value, "n", ratio(F.col("n"), F.col("total")).alias("share"))
