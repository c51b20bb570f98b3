"""Queries that measure: censuses, confusion, reliability, calibration, agreement, telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions.findings import SQL as F_SQL
from findlake.operators import aggregates as agg
from findlake.operators import consensus, dedup
from findlake.plans.findings import SEVERITY_ORDER, findings
from findlake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Statuses that say yes and no to a finding; all others abstain.
YES = ("exploitable", "confirmed", "confirmed_constrained", "confirmed_blocked", "confirmed_unverified")
NO = ("false_positive", "disproven", "ruled_out", "unreachable", "test_code", "mitigated")
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_VERDICT = f"CASE WHEN status IN {_IN(YES)} THEN true WHEN status IN {_IN(NO)} THEN false END"
_SEV = "CASE lower(trim(severity)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_ORDER.items()) + " END"
_V = f""", v AS (SELECT finding_id AS item, model, max({{'a': recorded_at, 'b': row_id, 'v': {_VERDICT}, 'k': kind}}).v AS verdict, max({{'a': recorded_at, 'b': row_id, 'v': {_VERDICT}, 'k': kind}}).k AS cls
  FROM f WHERE finding_id IS NOT NULL AND model IS NOT NULL AND recorded_at IS NOT NULL GROUP BY 1, 2)"""


def query(sql: str | None = None, with_findings: bool = True):  # noqa: ANN201
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (F_SQL if with_findings else "") + sql
        return f

    return add


def verdict(status: Column) -> Column:
    return F.when(status.isin(*YES), True).when(status.isin(*NO), False)


def votes(spark: SparkSession, d: str) -> DataFrame:
    """item, cls, model, verdict: each model's latest verdict on each finding."""
    rows = findings(spark, d).where("finding_id is not null and model is not null and recorded_at is not null")
    last = F.max(F.struct("recorded_at", "row_id", verdict(F.col("status")).alias("v"), F.col("kind").alias("k"))).alias("m")
    return rows.groupBy(F.col("finding_id").alias("item"), "model").agg(last).select("item", F.col("m.k").alias("cls"), "model", F.col("m.v").alias("verdict"))


_AGREE = _V + """, a AS (SELECT item, count(*) AS n_models, count(*) FILTER (verdict) AS n_yes, count(*) FILTER (NOT verdict) AS n_no FROM v GROUP BY 1 HAVING count(*) >= 2),
  g AS (SELECT *, CASE WHEN n_yes + n_no = 0 THEN 'no-verdict' WHEN n_no = 0 THEN 'high' WHEN n_yes = 0 THEN 'high-negative' ELSE 'disputed' END AS signal FROM a)"""


@query(_AGREE + " SELECT item, n_models, n_yes, n_no, signal FROM g")
def agreement_signals(spark: SparkSession, d: str) -> DataFrame:
    """How far the models agree on each finding; abstentions are no votes."""
    return consensus.agreement(votes(spark, d))


@query(_AGREE + " SELECT v.item, v.model, v.verdict FROM v JOIN g ON v.item = g.item AND g.signal = 'disputed' WHERE v.verdict = (g.n_yes < g.n_no)")
def minority_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The models in the minority of each disputed finding."""
    return consensus.minority(votes(spark, d))


@query(_V + """, p AS (SELECT item, array_to_string(list_sort(list(model || '=' || coalesce(verdict::varchar, '-'))), ',') AS pattern, count(DISTINCT coalesce(verdict::varchar, '-')) AS k, count(*) AS n FROM v GROUP BY 1)
SELECT pattern, count(*) AS n_items, max(k) = 1 AS unanimous FROM p WHERE n >= 2 GROUP BY 1 HAVING count(*) >= 2""")
def verdict_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Findings grouped by their whole verdict vector."""
    return consensus.clusters(votes(spark, d))


@query(_V + """ SELECT item, count(*) AS n_models, arg_max(model, {'a': verdict IS NOT NULL, 'b': model}) AS primary_model, list_sort(list(model)) AS models FROM v GROUP BY 1""")
def panel_merge(spark: SparkSession, d: str) -> DataFrame:
    """Results of all models merged per finding; the primary one has a verdict."""
    best = F.max(F.struct(F.col("verdict").isNotNull().alias("a"), "model")).alias("m")
    return votes(spark, d).groupBy("item").agg(F.count("*").alias("n_models"), best, F.array_sort(F.collect_list("model")).alias("models")).select("item", "n_models", F.col("m.model").alias("primary_model"), "models")


@query(_V + """, s AS (SELECT item, list(model) AS ms FROM v WHERE verdict GROUP BY 1)
SELECT model, count(*) AS n_found, count(*) FILTER (len(ms) = 1) AS n_unique, round(count(*) / (SELECT count(*) FROM s), 6) AS recall FROM (SELECT unnest(ms) AS model, ms FROM s) GROUP BY 1""")
def found_by_model(spark: SparkSession, d: str) -> DataFrame:
    """What each model found of all that any found, and what only it found."""
    items = votes(spark, d).where("verdict").groupBy("item").agg(F.collect_list("model").alias("ms"))
    total = items.agg(F.count("*").alias("total"))
    found = items.select(F.explode("ms").alias("model"), (F.size("ms") == 1).alias("alone")).groupBy("model").agg(F.count("*").alias("n_found"), F.count_if("alone").alias("n_unique"))
    return found.crossJoin(F.broadcast(total)).select("model", "n_found", "n_unique", agg.ratio(F.col("n_found"), F.col("total")).alias("recall"))  # one row


@query(None)
def dawid_skene_items(spark: SparkSession, d: str) -> DataFrame:
    """Posterior of each finding by EM over its panel, per kind."""
    items, _ = consensus.dawid_skene(votes(spark, d))
    return items.select("cls", "item", F.round("posterior", 4).alias("posterior"), "n_models")


@query(None)
def dawid_skene_models(spark: SparkSession, d: str) -> DataFrame:
    """Sensitivity and specificity of each model by EM, per kind."""
    _, models = consensus.dawid_skene(votes(spark, d))
    return models.select("cls", "model", F.round("sensitivity", 4).alias("sensitivity"), F.round("specificity", 4).alias("specificity"))


@query(None)
def model_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Beta posterior of each model's rate of positive verdicts, with its interval and the verdict that follows."""
    counts = votes(spark, d).where("verdict is not null").groupBy("model").agg(F.count_if("verdict").alias("n_yes"), F.count_if(~F.col("verdict")).alias("n_no"))
    out = consensus.with_interval(counts, "n_yes", "n_no")
    return out.select("model", "n_yes", "n_no", "posterior_mean", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), consensus.posterior_verdict(F.col("posterior_mean")).alias("verdict"))


@query(_V + """, c AS (SELECT cls, model, count(*) FILTER (verdict) AS n_yes, count(*) FILTER (NOT verdict) AS n_no FROM v GROUP BY 1, 2)
SELECT cls, model, n_yes + n_no AS n_events, CASE WHEN n_yes + n_no >= 5 THEN round(least(0.99, greatest(0.01, (1 + n_yes) / (2 + n_yes + n_no))), 6) END AS reliability FROM c""")
def reliability_cells(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed rate of each class and model, clipped; null below five events."""
    counts = votes(spark, d).groupBy("cls", "model").agg(F.count_if("verdict").alias("y"), F.count_if(~F.col("verdict")).alias("n"))
    n = F.col("y") + F.col("n")
    rate = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), (1 + F.col("y")) / (2 + n))), 6)
    return counts.select("cls", "model", n.alias("n_events"), F.when(n >= 5, rate).alias("reliability"))


@query(_V + """, r AS (SELECT model, least(0.99, greatest(0.01, (1.0 + count(*) FILTER (verdict)) / (2 + count(*) FILTER (verdict IS NOT NULL)))) AS r, count(*) FILTER (verdict IS NOT NULL) AS n FROM v GROUP BY 1 HAVING n >= 5),
  o AS (SELECT item, count(*) AS n_votes, round(sum(CASE WHEN verdict THEN 1 ELSE -1 END * ln(r / (1 - r))), 6) AS log_odds FROM v JOIN r USING (model) WHERE verdict IS NOT NULL GROUP BY 1)
SELECT item, n_votes, CASE WHEN n_votes >= 2 AND log_odds <> 0 THEN log_odds END AS log_odds FROM o""")
def panel_log_odds(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated merge: sum of the models' log-odds signed by their verdicts; null for fewer than two votes or a tie."""
    cast = votes(spark, d)
    n = F.count_if(F.col("verdict").isNotNull())
    rates = cast.groupBy("model").agg(n.alias("n"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), (1 + F.count_if("verdict")) / (2 + n))).alias("r")).where("n >= 5")
    term = F.when(F.col("verdict"), 1).otherwise(-1) * F.ln(F.col("r") / (1 - F.col("r")))
    odds = cast.where("verdict is not null").join(rates.drop("n"), "model").groupBy("item").agg(F.count("*").alias("n_votes"), F.round(F.sum(term), 6).alias("o"))
    return odds.select("item", "n_votes", F.when((F.col("n_votes") >= 2) & (F.col("o") != 0), F.col("o")).alias("log_odds"))


@query(f""", m AS (SELECT tool, strftime(recorded_at, '%Y-%m') AS month, count(*) FILTER ({_VERDICT}) AS c, count(*) FILTER (NOT {_VERDICT}) AS i FROM f WHERE recorded_at IS NOT NULL GROUP BY 1, 2),
  w AS (SELECT *, pow(0.5, greatest(0, (2026 - substr(month, 1, 4)::int) * 12 + 1 - substr(month, 6, 2)::int) * 30.44 / 180) AS w FROM m)
SELECT tool, round(sum(c * w), 4) AS correct, round(sum(i * w), 4) AS incorrect FROM w GROUP BY 1""")
def decayed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Positive and negative verdicts per tool, weighted by the age of their month (half life 180 days)."""
    v = verdict(F.col("status"))
    months = findings(spark, d).where("recorded_at is not null").groupBy("tool", F.date_format("recorded_at", "yyyy-MM").alias("month")).agg(F.count_if(v).alias("c"), F.count_if(~v).alias("i"))
    w = agg.decay_weight(F.col("month"), "2026-01", 180)
    return months.groupBy("tool").agg(F.round(F.sum(F.col("c") * w), 4).alias("correct"), F.round(F.sum(F.col("i") * w), 4).alias("incorrect"))


@query(f""", x AS (SELECT kind, score, {_SEV} AS sev FROM f WHERE score IS NOT NULL AND {_SEV} IS NOT NULL),
  r AS (SELECT kind, rank() OVER (PARTITION BY kind ORDER BY score) + (count(*) OVER (PARTITION BY kind, score) - 1) / 2 AS a, rank() OVER (PARTITION BY kind ORDER BY sev) + (count(*) OVER (PARTITION BY kind, sev) - 1) / 2 AS b, score, sev FROM x)
SELECT kind, count(*) AS n, CASE WHEN count(DISTINCT score) > 1 AND count(DISTINCT sev) > 1 THEN round(corr(a, b), 6) END AS rho FROM r GROUP BY 1""")
def score_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of score and severity per kind, ties averaged."""
    sev = dedup.lookup(F.lower(F.trim("severity")), SEVERITY_ORDER, None)
    rows = findings(spark, d).select("kind", "score", sev.cast("int").alias("sev"))
    return agg.spearman(rows, "score", "sev", ["kind"])


@query(f""", t AS (SELECT tool, {_VERDICT} AS v, row_number() OVER (PARTITION BY tool ORDER BY score DESC NULLS LAST, row_id) AS k FROM f)
SELECT tool, count(*) AS n_taken, round(coalesce(avg(coalesce(v, false)::int), 0.0), 6) AS precision FROM t WHERE k <= 20 GROUP BY 1""")
def top20_precision(spark: SparkSession, d: str) -> DataFrame:
    """Share of positives among the 20 highest scores of each tool."""
    return agg.top_precision(findings(spark, d), ["tool"], [F.desc_nulls_last("score"), F.asc("row_id")], F.coalesce(verdict(F.col("status")), F.lit(False)), 20)


@query(f""" SELECT tool, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN {_VERDICT} THEN 1.0 WHEN NOT {_VERDICT} THEN 0.0 END), 6) AS positive_share FROM f GROUP BY ROLLUP (tool)""")
def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    """Scores and verdicts per tool and over all (null tool), by one rollup."""
    v = verdict(F.col("status")).cast("int").cast("double")
    return findings(spark, d).rollup("tool").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(v), 6).alias("positive_share"))


_CONF = f"""SELECT {{by}}, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (
  SELECT {{by}}, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (NOT p AND a) AS fn FROM (SELECT {{by}}, score >= 5 AS p, {_VERDICT} AS a FROM f) GROUP BY 1)"""


@query(" " + _CONF.format(by="tool"))
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A score of 5 or more as a prediction of the verdict, per tool; open verdicts don't count."""
    return agg.confusion(findings(spark, d), F.col("score") >= 5, verdict(F.col("status")), ["tool"])


@query(" SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM f), 6) AS share, count(*) / (SELECT count(*) FROM f) >= 0.1 AS passed FROM f GROUP BY 1")
def share_gate(spark: SparkSession, d: str) -> DataFrame:
    """Share of each kind, and whether it reaches a tenth."""
    kinds = findings(spark, d).groupBy("kind").agg(F.count("*").alias("n"))
    total = kinds.agg(F.sum("n").alias("total"))
    return kinds.crossJoin(F.broadcast(total)).select("kind", "n", agg.ratio(F.col("n"), F.col("total")).alias("share"), (F.col("n") / F.col("total") >= 0.1).alias("passed"))  # one row


@query(f""" SELECT kind, round(count(*) FILTER ({_VERDICT} IS NOT NULL) / count(*), 6) AS coverage, round(count(*) FILTER (score < 3 AND {_VERDICT}) / nullif(count(*) FILTER ({_VERDICT}), 0), 6) AS false_suppression,
  round(count(*) FILTER (score < 3 AND NOT {_VERDICT}) / nullif(count(*) FILTER (score < 3 AND {_VERDICT} IS NOT NULL), 0), 6) AS suppression_precision FROM f GROUP BY 1""")
def trust_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of verdicts, positives wrongly and negatives rightly suppressed by a score below 3, per kind."""
    v, low = verdict(F.col("status")), F.col("score") < 3
    out = findings(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count(v).alias("k"), F.count_if(v).alias("y"), F.count_if(low & v).alias("ly"), F.count_if(low & ~v).alias("ln"))
    return out.select("kind", agg.ratio(F.col("k"), F.col("n")).alias("coverage"), agg.ratio(F.col("ly"), F.col("y")).alias("false_suppression"), agg.ratio(F.col("ln"), F.col("ly") + F.col("ln")).alias("suppression_precision"))


@query(f", x AS (SELECT cwe, kind, tool FROM f WHERE NOT {_VERDICT}) SELECT cwe, kind, tool, grouping_id(cwe, kind, tool) AS level, count(*) AS n FROM x GROUP BY GROUPING SETS ((cwe), (kind), (kind, tool))")
def false_positive_census(spark: SparkSession, d: str) -> DataFrame:
    """Rejected findings counted by weakness, by kind and by kind and tool in one pass."""
    rows = findings(spark, d).where(~verdict(F.col("status"))).select("cwe", "kind", "tool")
    return agg.census(rows, ["cwe", "kind", "tool"], [["cwe"], ["kind"], ["kind", "tool"]])


@query(f", x AS (SELECT cwe, kind FROM f WHERE {_VERDICT} IS NULL) SELECT cwe, kind, grouping_id(cwe, kind) AS level, count(*) AS n FROM x GROUP BY GROUPING SETS ((cwe), (kind), (cwe, kind))")
def missed_census(spark: SparkSession, d: str) -> DataFrame:
    """Open findings counted by weakness, kind and both."""
    rows = findings(spark, d).where(verdict(F.col("status")).isNull()).select("cwe", "kind")
    return agg.census(rows, ["cwe", "kind"], [["cwe"], ["kind"], ["cwe", "kind"]])


@query(f" SELECT cwe, count(*) AS n_raw, count(*) FILTER (NOT coalesce(score < 3, false)) AS n_warm FROM f WHERE cwe IS NOT NULL GROUP BY 1")
def suppression_counts(spark: SparkSession, d: str) -> DataFrame:
    """Raw findings per weakness, and those left when low scores are suppressed."""
    return findings(spark, d).where("cwe is not null").groupBy("cwe").agg(F.count("*").alias("n_raw"), F.count_if(~F.coalesce(F.col("score") < 3, F.lit(False))).alias("n_warm"))


@query(f""" SELECT tool AS gate, count(*) FILTER (NOT {_VERDICT}) AS n_kills, count(*) FILTER (NOT {_VERDICT} AND refs[1] IS NOT NULL) AS n_sampled, count(*) FILTER (NOT {_VERDICT} AND score < 3) AS n_corroborated,
  count(*) FILTER (NOT {_VERDICT} AND score >= 7) AS n_contradicted FROM f GROUP BY 1""")
def prefilter_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Rejections per gate: how many were sampled, corroborated and contradicted."""
    no = ~verdict(F.col("status"))
    return findings(spark, d).groupBy(F.col("tool").alias("gate")).agg(
        F.count_if(no).alias("n_kills"), F.count_if(no & F.try_element_at("refs", F.lit(1)).isNotNull()).alias("n_sampled"),
        F.count_if(no & (F.col("score") < 3)).alias("n_corroborated"), F.count_if(no & (F.col("score") >= 7)).alias("n_contradicted"),
    )


@query(f""", s AS (SELECT tool AS strategy, count(*) FILTER ({_VERDICT}) AS wins, count(*) FILTER (NOT {_VERDICT}) AS misses FROM f GROUP BY 1)
SELECT strategy, wins, misses, CASE WHEN wins + misses < 10 THEN 1.0 ELSE round(0.5 + 1.5 * (wins + 1) / (wins + misses + 2), 6) END AS weight FROM s""")
def strategy_weights(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed win rate of each strategy as a weight between 0.5 and 2; 1 with fewer than ten samples."""
    v = verdict(F.col("status"))
    s = findings(spark, d).groupBy(F.col("tool").alias("strategy")).agg(F.count_if(v).alias("wins"), F.count_if(~v).alias("misses"))
    n = F.col("wins") + F.col("misses")
    return s.withColumn("weight", F.when(n < 10, 1.0).otherwise(F.round(0.5 + 1.5 * (F.col("wins") + 1) / (n + 2), 6)))


@query(f""", i AS (SELECT path, function, max(kind) AS kind, list(DISTINCT tool) AS by_tool, bool_or({_VERDICT} IS NOT NULL) AS checked FROM f GROUP BY 1, 2)
SELECT kind, count(*) AS n_items, count(*) FILTER (checked) AS n_checked, round(100.0 * coalesce(count(*) FILTER (checked) / nullif(count(*), 0), 0), 4) AS percent FROM i GROUP BY 1""")
def coverage_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Functions with a verdict per kind; the percentage is 0 where there are none."""
    items = findings(spark, d).groupBy("path", "function").agg(F.max("kind").alias("kind"), F.bool_or(verdict(F.col("status")).isNotNull()).alias("checked"))
    done = F.count_if("checked")
    return items.groupBy("kind").agg(F.count("*").alias("n_items"), done.alias("n_checked"), F.round(100 * F.coalesce(F.try_divide(done, F.count("*")), F.lit(0.0)), 4).alias("percent"))


@query(", i AS (SELECT DISTINCT path, function, tool FROM f) SELECT tool AS source, count(*) AS n_items FROM i GROUP BY 1")
def coverage_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Functions that each source has looked at; an item counts once per source."""
    return findings(spark, d).select("path", "function", "tool").distinct().groupBy(F.col("tool").alias("source")).agg(F.count("*").alias("n_items"))


#: Languages by file extension.
LANGUAGES = {"c": "c", "cpp": "cpp", "java": "java", "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "go": "go", "php": "php", "rs": "rust"}
_LANG = "CASE regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " END"


def language(path: Column) -> Column:
    return dedup.lookup(F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1), LANGUAGES, None)


@query(f" SELECT {_LANG} AS language, status, count(*) AS n FROM f GROUP BY 1, 2")
def verdict_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Statuses per language."""
    return findings(spark, d).groupBy(language(F.col("path")).alias("language"), "status").agg(F.count("*").alias("n"))


@query(f", l AS (SELECT repo_url, {_LANG} AS language, count(*) AS n FROM f GROUP BY 1, 2) SELECT repo_url, coalesce(arg_max(language, {{'a': n, 'b': language}}) FILTER (language IS NOT NULL), '') AS language FROM l GROUP BY 1")
def main_language(spark: SparkSession, d: str) -> DataFrame:
    """The most common language of each repository, '' if none is known."""
    counts = findings(spark, d).groupBy("repo_url", language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))
    best = F.max_by("language", F.when(F.col("language").isNotNull(), F.struct("n", "language")))
    return counts.groupBy("repo_url").agg(F.coalesce(best, F.lit("")).alias("language"))


@query(""", c AS (SELECT kind, cwe, count(*) AS n FROM f WHERE cwe IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY kind) AS total, max(n) OVER (PARTITION BY kind) AS top, count(*) OVER (PARTITION BY kind) AS kinds FROM c)
SELECT kind, cwe, n, round(n / total, 6) AS share FROM w WHERE total >= 3 AND kinds >= 2 AND top / total >= 0.6 AND n < top""")
def minority_labels(spark: SparkSession, d: str) -> DataFrame:
    """Weaknesses that deviate from the clear majority of their kind."""
    return agg.majority_deviation(findings(spark, d).where("cwe is not null"), ["kind"], "cwe", least_rows=3, least_values=2, share=0.6)


#: Detector families whose meeting makes a finding severe whatever its count.
HARD_PAIR = ("fuzzlantern", "flowquarry")


@query(""", s AS (SELECT path, kind, list_sort(list(DISTINCT tool)) AS families FROM f WHERE tool IS NOT NULL GROUP BY 1, 2)
SELECT path, kind, len(families) AS n_families, CASE WHEN list_has_all(families, ['fuzzlantern', 'flowquarry']) OR len(families) >= 4 THEN 'critical' WHEN len(families) = 3 THEN 'high' WHEN len(families) = 2 THEN 'medium' END AS floor FROM s""")
def composite_floor(spark: SparkSession, d: str) -> DataFrame:
    """Severity floor from the number of independent detector families, or from a pair that is telling by itself."""
    s = findings(spark, d).where("tool is not null").groupBy("path", "kind").agg(F.collect_set("tool").alias("s"))
    n = F.size("s")
    pair = F.size(F.array_except(F.array(*map(F.lit, HARD_PAIR)), "s")) == 0
    return s.select("path", "kind", n.alias("n_families"), F.when(pair | (n >= 4), "critical").when(n == 3, "high").when(n == 2, "medium").alias("floor"))


@query(""" SELECT coalesce(status, 'unknown') AS status, count(*) AS n, count(*) FILTER (score >= 7) AS n_severe FROM f GROUP BY 1""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings per status, with the severe ones."""
    return findings(spark, d).groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 7).alias("n_severe"))


@query(""", m AS (SELECT DISTINCT finding_id AS item, model, list_sort(list_distinct(regexp_extract_all(lower(r), '[a-z]+'))) AS toks FROM (SELECT finding_id, model, max({'a': recorded_at, 'b': row_id, 'r': reasoning}).r AS r FROM f
    WHERE finding_id IS NOT NULL AND model IS NOT NULL AND recorded_at IS NOT NULL AND length(reasoning) >= 20 GROUP BY 1, 2)),
  p AS (SELECT a.item, 1 - len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) AS d FROM m a JOIN m b ON a.item = b.item AND a.model < b.model)
SELECT item, count(*) AS n_pairs, round(avg(d), 6) AS divergence FROM p GROUP BY 1""")
def reasoning_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Mean pairwise Jaccard distance of the models' reasonings on a finding. Each model has one reasoning per finding, so
    the pairs within a row are bounded by the number of models; they are formed in the row, without a self-join."""
    rows = findings(spark, d).where("finding_id is not null and model is not null and recorded_at is not null and length(reasoning) >= 20")
    last = F.max(F.struct("recorded_at", "row_id", "reasoning")).alias("m")
    toks = F.array_distinct(F.regexp_extract_all(F.lower("m.reasoning"), F.lit("[a-z]+"), F.lit(0))).alias("t")
    sets = rows.groupBy(F.col("finding_id").alias("item"), "model").agg(last).select("item", toks).groupBy("item").agg(F.collect_list("t").alias("s"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.transform(F.slice("s", i + 1, F.size("s") - i), lambda b: 1 - F.size(F.array_intersect(F.get("s", i - 1), b)) / F.size(F.array_union(F.get("s", i - 1), b)))))
    return sets.where(F.size("s") >= 2).select("item", pairs.alias("p")).select("item", F.size("p").alias("n_pairs"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p"), 6).alias("divergence"))


@query(_V + " SELECT item, CASE WHEN count(*) FILTER (verdict IS NULL) > 0 OR count(DISTINCT verdict) <> 1 THEN 'inconclusive' WHEN bool_and(verdict) THEN 'confirmed' ELSE 'refuted' END AS verdict, count(*) AS n FROM v GROUP BY 1")
def evidence_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The verdict that all evidence on a finding shares, else inconclusive."""
    named = votes(spark, d).withColumn("named", F.when(F.col("verdict"), "confirmed").when(~F.col("verdict"), "refuted"))
    return consensus.evidence_aggregate(named, ["item"], "named")


@query(f""" SELECT cwe, count(*) FILTER ({_VERDICT}) AS n_confirmed, count(*) FILTER (NOT {_VERDICT}) AS n_refuted, round(count(*) FILTER ({_VERDICT}) / nullif(count(*) FILTER ({_VERDICT} IS NOT NULL), 0), 6) AS tp_rate,
  coalesce(count(*) FILTER ({_VERDICT}) / nullif(count(*) FILTER ({_VERDICT} IS NOT NULL), 0) >= 0.7, false) AS good FROM f WHERE cwe IS NOT NULL GROUP BY 1""")
def weakness_quality(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed and refuted findings per weakness; the rate is null without verdicts."""
    v = verdict(F.col("status"))
    out = findings(spark, d).where("cwe is not null").groupBy("cwe").agg(F.count_if(v).alias("n_confirmed"), F.count_if(~v).alias("n_refuted"))
    rate = F.try_divide(F.col("n_confirmed").cast("double"), (F.col("n_confirmed") + F.col("n_refuted")).cast("double"))
    return out.select("cwe", "n_confirmed", "n_refuted", F.round(rate, 6).alias("tp_rate"), F.coalesce(rate >= 0.7, F.lit(False)).alias("good"))


@query(_V + " SELECT cls, count(*) FILTER (verdict) + 1 AS alpha, count(*) FILTER (NOT verdict) + 1 AS beta FROM v GROUP BY 1")
def class_priors(spark: SparkSession, d: str) -> DataFrame:
    """Beta prior of each class from its verdicts."""
    return votes(spark, d).groupBy("cls").agg((F.count_if("verdict") + 1).alias("alpha"), (F.count_if(~F.col("verdict")) + 1).alias("beta"))


@query(_V + """, g AS (SELECT item, count(*) FILTER (verdict) > count(*) FILTER (NOT verdict) AS y, count(*) FILTER (verdict) < count(*) FILTER (NOT verdict) AS n FROM v GROUP BY 1)
SELECT v.cls, v.model, count(*) FILTER (v.verdict = g.y) AS n_correct, count(*) FILTER (v.verdict <> g.y) AS n_incorrect FROM v JOIN g ON v.item = g.item AND (g.y OR g.n) WHERE v.verdict IS NOT NULL GROUP BY 1, 2""")
def judge_events(spark: SparkSession, d: str) -> DataFrame:
    """Votes for and against the panel's majority per class and model; ties make no events."""
    cast = votes(spark, d)
    majority = consensus_majority(cast)
    judged = cast.where("verdict is not null").join(majority, "item")
    return judged.groupBy("cls", "model").agg(F.count_if(F.col("verdict") == F.col("majority")).alias("n_correct"), F.count_if(F.col("verdict") != F.col("majority")).alias("n_incorrect"))


def consensus_majority(cast: DataFrame) -> DataFrame:
    y, n = F.count_if("verdict"), F.count_if(~F.col("verdict"))
    return cast.groupBy("item").agg(y.alias("y"), n.alias("n")).where("y <> n").select("item", (F.col("y") > F.col("n")).alias("majority"))


@query(""" SELECT finding_id AS item, count(DISTINCT nullif(refs[1], '')) <= 1 AS uniform, max(nullif(refs[1], '')) AS reference FROM f WHERE finding_id IS NOT NULL GROUP BY 1""")
def provenance_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Whether the reports of a finding name at most one run."""
    ref = F.nullif(F.try_element_at("refs", F.lit(1)), F.lit(""))
    return findings(spark, d).where("finding_id is not null").groupBy(F.col("finding_id").alias("item")).agg((F.countDistinct(ref) <= 1).alias("uniform"), F.max(ref).alias("reference"))


@query(""", m AS (SELECT model, kind, count(*) AS n FROM f WHERE model IS NOT NULL GROUP BY 1, 2) SELECT kind, count(*) AS n_models, median(n) AS median_n FROM m GROUP BY 1""")
def scorecard_audit(spark: SparkSession, d: str) -> DataFrame:
    """Models per kind and the median of their observations."""
    cells = findings(spark, d).where("model is not null").groupBy("model", "kind").agg(F.count("*").alias("n"))
    return cells.groupBy("kind").agg(F.count("*").alias("n_models"), F.median("n").alias("median_n"))


@query(""" SELECT finding_id AS item, row_id, model, row_number() OVER (PARTITION BY finding_id ORDER BY recorded_at NULLS FIRST, row_id) AS ordinal FROM f WHERE finding_id IS NOT NULL AND model IS NOT NULL""")
def panel_order(spark: SparkSession, d: str) -> DataFrame:
    """Reports of a finding in the order in which they came."""
    rows = findings(spark, d).where("finding_id is not null and model is not null").select(F.col("finding_id").alias("item"), "row_id", "model", "recorded_at")
    order = [F.asc_nulls_first("recorded_at"), F.asc("row_id")]
    return dedup.numbered(rows, ["item"], [F.to_date("recorded_at")], order, "ordinal").drop("recorded_at")


@query("""SELECT event_type AS call_class, count(*) AS n_calls, count(*) FILTER (value >= 5) AS n_completed, round(sum(value), 4) AS cost, round(sum(value) FILTER (value >= 5) / nullif(count(*) FILTER (value >= 5), 0), 6) AS mean_cost FROM events GROUP BY 1""", False)
def telemetry_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Calls, completed calls and costs per class; the mean is over completed calls only."""
    done = F.col("value") >= 5
    return table(spark, d, "events").groupBy(F.col("event_type").alias("call_class")).agg(
        F.count("*").alias("n_calls"), F.count_if(done).alias("n_completed"), F.round(F.sum("value"), 4).alias("cost"), F.round(F.try_divide(F.sum(F.when(done, F.col("value"))), F.count_if(done)), 6).alias("mean_cost")
    )


@query("""WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS phase, sum(value) AS c, sum(value) FILTER (event_type <> 'error') AS a FROM events GROUP BY 1)
SELECT phase, round(c, 4) AS total, round(coalesce(a, 0), 4) AS attributed, round(c - coalesce(a, 0), 4) AS residual FROM p""", False)
def cost_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Spend per phase, the part attributed to calls and the rest."""
    paid = F.coalesce(F.sum(F.when(F.col("event_type") != "error", F.col("value"))), F.lit(0.0))
    out = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("phase")).agg(F.sum("value").alias("c"), paid.alias("a"))
    return out.select("phase", F.round("c", 4).alias("total"), F.round("a", 4).alias("attributed"), F.round(F.col("c") - F.col("a"), 4).alias("residual"))


@query("""WITH e AS (SELECT event_type, avg(value) AS cost, count(*) AS n FROM events GROUP BY 1) SELECT event_type AS model, n, CASE WHEN n >= 5 THEN round(cost * 100, 4) END AS estimated_cost, CASE WHEN n >= 5 THEN round(cost * 100 / 3, 4) END AS estimated_time FROM e""", False)
def run_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Cost and time of 100 further calls at three in parallel; null below five observed calls."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("cost"), F.count("*").alias("n"))
    enough = F.col("n") >= 5
    return e.select("model", "n", F.when(enough, F.round(F.col("cost") * 100, 4)).alias("estimated_cost"), F.when(enough, F.round(F.col("cost") * 100 / 3, 4)).alias("estimated_time"))


@query("""SELECT event_type AS reason, (user_id % 7)::int AS model, count(*) AS n, round(avg((value >= 5)::int), 6) AS success_share FROM events GROUP BY 1, 2""", False)
def dispatch_stats(spark: SparkSession, d: str) -> DataFrame:
    """Dispatch decisions by reason and model."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("reason"), (F.col("user_id") % 7).cast("int").alias("model")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") >= 5).cast("int")), 6).alias("success_share"))
