"""What a panel of models agrees on: agreement signals, clusters, EM label aggregation, Beta posteriors.

votes(item, cls, model, verdict): a null verdict is an abstention, never a vote. One row per item and model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.session import bounded, written


def signal(yes: Column, votes: Column) -> Column:
    """no-verdict, high, high-negative or disputed."""
    return F.when(votes == 0, "no-verdict").when(yes == votes, "high").when(yes == 0, "high-negative").otherwise("disputed")


def agreement(votes: DataFrame) -> DataFrame:
    """item, n_models, n_yes, n_no, signal of the items that two models or more have judged."""
    yes, no = F.count_if(F.col("verdict")), F.count_if(~F.col("verdict"))
    out = votes.groupBy("item").agg(F.count("*").alias("n_models"), yes.alias("n_yes"), no.alias("n_no")).where("n_models >= 2")
    return out.withColumn("signal", signal(F.col("n_yes"), F.col("n_yes") + F.col("n_no")))


def minority(votes: DataFrame) -> DataFrame:
    """item, model, verdict of the models in the minority of a disputed item (of equal sides the negative one)."""
    disputed = agreement(votes).where("signal = 'disputed'").select("item", (F.col("n_yes") < F.col("n_no")).alias("minor"))
    return votes.join(disputed, "item").where(F.col("verdict") == F.col("minor")).select("item", "model", "verdict")


def clusters(votes: DataFrame) -> DataFrame:
    """pattern, n_items, unanimous: vectors of (model, verdict) that at least two items share."""
    vector = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "model", F.coalesce(F.col("verdict").cast("string"), F.lit("-"))))), ",")
    per_item = votes.groupBy("item").agg(vector.alias("pattern"), F.count("*").alias("k"), F.countDistinct(F.coalesce(F.col("verdict").cast("string"), F.lit("-"))).alias("d")).where("k >= 2")
    return per_item.groupBy("pattern").agg(F.count("*").alias("n_items"), (F.max("d") == 1).alias("unanimous")).where("n_items >= 2")


def evidence_aggregate(df: DataFrame, by: list[str], verdict: str) -> DataFrame:
    """The common verdict of all evidence, else (also for none) inconclusive."""
    same = F.when(F.countDistinct(verdict) == 1, F.max(verdict)).otherwise("inconclusive")
    return df.groupBy(*by).agg(F.when(F.count_if(F.col(verdict).isNull()) > 0, "inconclusive").otherwise(same).alias("verdict"), F.count("*").alias("n"))


#: Votes in distinct patterns up to which a class is iterated in one task.
LOCAL_PATTERNS = 200_000


def _em_class(pdf: pd.DataFrame, a: float, b: float, start: float, max_iter: int, tol: float, eps: float) -> pd.DataFrame:
    """The rates of one class's models after EM over its weighted patterns."""
    models, m = np.unique(pdf["model"].to_numpy(dtype=str), return_inverse=True)
    _, p = np.unique(pdf["p"].to_numpy(), return_inverse=True)
    yes, w = pdf["verdict"].to_numpy(dtype=bool), pdf["w"].to_numpy(dtype=float)
    se, sp = np.full(len(models), start), np.full(len(models), start)
    logit = math.log(a / b) if a != b else 0.0
    for _ in range(max_iter):
        x, y = np.clip(se, eps, 1 - eps)[m], np.clip(sp, eps, 1 - eps)[m]
        odds = np.bincount(p, np.where(yes, np.log(x) - np.log(1 - y), np.log(1 - x) - np.log(y)))
        q = (1 / (1 + np.exp(-(odds + logit))))[p] * w
        new_se = (np.bincount(m, q * yes, len(models)) + a) / (np.bincount(m, q, len(models)) + a + b)
        new_sp = (np.bincount(m, (w - q) * ~yes, len(models)) + b) / (np.bincount(m, w - q, len(models)) + a + b)
        moved = max(np.abs(new_se - se).max(), np.abs(new_sp - sp).max())
        se, sp = new_se, new_sp
        if moved < tol:
            break
    return pd.DataFrame({"cls": pdf["cls"].iloc[0], "model": models, "se": se, "sp": sp})


def dawid_skene(votes: DataFrame, prior: tuple[float, float] = (1.0, 1.0), start: float = 0.8, max_iter: int = 50, tol: float = 1e-4, eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(items: cls, item, posterior, n_models; models: cls, model, sensitivity, specificity) by EM per class.

    Items with the same class and votes are one pattern with a weight, so an iteration works on patterns. The class
    rate stays at the prior's mean; the prior also smooths the models' rates. Stops when no rate moves by tol. Up to
    LOCAL_PATTERNS patterns (counted) each class is one task that iterates in memory, stopping by itself; beyond, each
    iteration is two aggregations over the patterns."""
    a, b = prior
    logit = math.log(a / b) if a != b else 0.0
    cast = votes.where(F.col("verdict").isNotNull())
    vector = F.array_sort(F.collect_set(F.struct("model", "verdict"))).alias("v")
    items = written(cast.groupBy("cls", "item").agg(vector), "panel")
    patterns = items.groupBy("cls", "v").agg(F.count("*").alias("w")).withColumn("p", F.xxhash64("cls", F.to_json("v")))
    long = written(patterns.select("cls", "p", "w", F.inline("v")), "patterns")
    if long.count() <= LOCAL_PATTERNS:
        run = lambda pdf: _em_class(pdf, a, b, start, max_iter, tol, eps)
        rates = written(long.groupBy("cls").applyInPandas(run, "cls string, model string, se double, sp double"), "rates")
        max_iter = 0
    else:
        rates = written(long.select("cls", "model").distinct().select("cls", "model", F.lit(start).alias("se"), F.lit(start).alias("sp")), "rates")
    clip = lambda c: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), c))

    def posteriors(rates: DataFrame) -> DataFrame:
        se, sp = clip(F.col("se")), clip(F.col("sp"))
        odds = F.when(F.col("verdict"), F.ln(se) - F.ln(1 - sp)).otherwise(F.ln(1 - se) - F.ln(sp))
        scored = long.join(bounded(rates), ["cls", "model"]).groupBy("cls", "p").agg(F.sum(odds).alias("o"))
        return scored.select("cls", "p", (1 / (1 + F.exp(-(F.col("o") + logit)))).alias("q"))

    for _ in range(max_iter):
        q = F.col("q") * F.col("w")
        n = (1 - F.col("q")) * F.col("w")
        fresh = (
            long.join(posteriors(rates), ["cls", "p"]).groupBy("cls", "model")
            .agg(((F.sum(F.when(F.col("verdict"), q).otherwise(0.0)) + a) / (F.sum(q) + a + b)).alias("se"), ((F.sum(F.when(~F.col("verdict"), n).otherwise(0.0)) + b) / (F.sum(n) + a + b)).alias("sp"))
        )
        old = rates.select("cls", "model", F.col("se").alias("o_se"), F.col("sp").alias("o_sp"))
        moved = F.greatest(F.abs(F.col("se") - F.col("o_se")), F.abs(F.col("sp") - F.col("o_sp")))
        rates = written(fresh.join(old, ["cls", "model"]).select("cls", "model", "se", "sp", moved.alias("moved")), "rates")
        if (rates.agg(F.max("moved")).first()[0] or 0.0) < tol:
            break
    judged = items.withColumn("p", F.xxhash64("cls", F.to_json("v"))).join(posteriors(rates), ["cls", "p"])
    return (
        judged.select("cls", "item", F.col("q").alias("posterior"), F.size("v").alias("n_models")),
        rates.select("cls", "model", F.col("se").alias("sensitivity"), F.col("sp").alias("specificity")),
    )


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    safe = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d = 1.0, 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    total = d
    for m in range(1, 500):
        change = 1.0
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / safe(1.0 + num * d)
            c = safe(1.0 + num / c)
            change = c * d
            total *= change
        if abs(change - 1.0) < 1e-14:
            break
    return front * total


def beta_quantile(a: float, b: float, p: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def with_interval(df: DataFrame, successes: str, failures: str, prior: tuple[float, float] = (1.0, 1.0), level: float = 0.95) -> DataFrame:
    """df with posterior_mean, lower, upper of Beta(prior + counts): equal-tailed interval. Distinct pairs are computed once."""
    tail = (1 - level) / 2
    pairs = df.select(F.col(successes).cast("double").alias("_s"), F.col(failures).cast("double").alias("_f")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ab = [(prior[0] + s, prior[1] + f) for s, f in zip(pdf["_s"], pdf["_f"])]
            yield pdf.assign(lower=[beta_quantile(a, b, tail) for a, b in ab], upper=[beta_quantile(a, b, 1 - tail) for a, b in ab])

    bounds = pairs.mapInPandas(run, "_s double, _f double, lower double, upper double")
    mean = (F.col(successes) + prior[0]) / (F.col(successes) + F.col(failures) + prior[0] + prior[1])
    return df.withColumns({"_s": F.col(successes).cast("double"), "_f": F.col(failures).cast("double"), "posterior_mean": F.round(mean, 6)}).join(bounds, ["_s", "_f"]).drop("_s", "_f")


def posterior_verdict(mean: Column, confirm: float = 0.8, refute: float = 0.2) -> Column:
    return F.when(mean > confirm, "confirmed").when(mean < refute, "refuted").otherwise("inconclusive")
