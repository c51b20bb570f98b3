"""Queries over findings: merging, diffs, matching, suppression, censuses, consensus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions.findings import SQL as F_SQL
from findlake.functions.findings import cwe_name, finding_path, normal_findings
from findlake.operators import dedup, joins, setops
from findlake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["path", "function", "line", "kind"]


def query(sql: str | None = None, with_findings: bool = True):  # noqa: ANN201
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (F_SQL if with_findings else "") + sql
        return f

    return add


def findings(spark: SparkSession, d: str) -> DataFrame:
    return normal_findings(table(spark, d, "finding"))


_RANK = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dedup.STATUS_RANK.items()) + " ELSE 0 END"


@query(f""", r AS (SELECT *, {_RANK} AS rank_no FROM f)
SELECT path, function, line, kind, arg_max(status, {{'a': rank_no, 'b': run_id, 'c': row_id}}) AS status, arg_max(run_id, {{'a': rank_no, 'b': run_id, 'c': row_id}}) AS run_id,
  arg_max(row_id, {{'a': rank_no, 'b': run_id, 'c': row_id}}) AS row_id, list_sort(list_distinct(flatten(list(refs)))) AS refs FROM r GROUP BY 1, 2, 3, 4""")
def merge_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all runs merged by location and kind: most progressed status, then latest run; provenance united."""
    return dedup.merge_by_status(findings(spark, d), KEY, "status", "run_id", "row_id", "refs")


@query(""", k AS (SELECT coalesce(nullif(id, ''), nullif(finding_id, ''), path || ':' || function || ':' || kind) AS k, run_id, row_id, status FROM f)
SELECT k, arg_max(row_id, {'a': run_id, 'b': row_id}) AS row_id, max(run_id) AS run_id, count(*) AS n_rows FROM k GROUP BY k""")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """One row per finding id (else per semantic group): the latest run overwrites."""
    key = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.nullif(F.col("finding_id"), F.lit("")), F.concat_ws(":", "path", "function", "kind")).alias("k")
    rows = findings(spark, d).select(key, "run_id", "row_id")
    best = F.max(F.struct("run_id", "row_id")).alias("m")
    return rows.groupBy("k").agg(best, F.count("*").alias("n_rows")).select("k", "m.row_id", "m.run_id", "n_rows")


@query(""", m AS (SELECT DISTINCT path, function, line, kind FROM f), g AS (SELECT DISTINCT path, function, kind FROM f)
SELECT (SELECT count(*) FROM g) AS n_unique, (SELECT count(*) FROM m) AS n_merged, (SELECT count(*) FROM f) AS n_total,
  (SELECT count(*) FROM g) <= (SELECT count(*) FROM m) AND (SELECT count(*) FROM m) <= (SELECT count(*) FROM f) AS ok""")
def merge_check(spark: SparkSession, d: str) -> DataFrame:
    """unique <= merged <= total after merging; counted in one pass over the distinct keys."""
    merged = findings(spark, d).groupBy(*KEY).agg(F.count("*").alias("n"))
    groups = merged.groupBy("path", "function", "kind").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    out = groups.agg(F.count("*").alias("n_unique"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_merged"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))
    return out.withColumn("ok", (F.col("n_unique") <= F.col("n_merged")) & (F.col("n_merged") <= F.col("n_total")))


@query(" SELECT path, function, kind, count(*) AS n_findings, count(DISTINCT line) AS n_lines FROM f GROUP BY 1, 2, 3")
def semantic_groups(spark: SparkSession, d: str) -> DataFrame:
    """Logical issues: groups of one file, function and kind, with the number of their findings and lines."""
    return findings(spark, d).groupBy("path", "function", "kind").agg(F.count("*").alias("n_findings"), F.countDistinct("line").alias("n_lines"))


@query(""" SELECT finding_id, model, row_id, rank_no FROM (SELECT finding_id, model, row_id, row_number() OVER (PARTITION BY finding_id, model ORDER BY recorded_at DESC NULLS LAST, row_id DESC) AS rank_no
  FROM f WHERE finding_id IS NOT NULL AND model IS NOT NULL) WHERE rank_no <= 2""")
def newest_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    """The two newest attempts of each finding and model."""
    rows = findings(spark, d).where("finding_id is not null and model is not null")
    order = [F.desc_nulls_last("recorded_at"), F.desc("row_id")]
    return dedup.keep_newest(rows, ["finding_id", "model"], order, 2).select("finding_id", "model", "row_id", "rank_no")


@query(""", r AS (SELECT tool, run_id, max(recorded_at) AS t, bool_or(status = 'not_disproven') AS live FROM f GROUP BY 1, 2),
  n AS (SELECT tool, run_id, row_number() OVER (PARTITION BY tool ORDER BY t DESC NULLS LAST, run_id DESC) AS rank_no FROM r WHERE NOT coalesce(live, false))
SELECT tool, run_id FROM n WHERE rank_no > greatest(3, 1)""")
def removable_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs beyond the newest three of each tool; live runs are outside the quota, and the last run is never removed."""
    runs = findings(spark, d).groupBy("tool", "run_id").agg(F.max("recorded_at").alias("t"), F.bool_or(F.col("status") == "not_disproven").alias("live"))
    quota = runs.where(~F.coalesce("live", F.lit(False))).select("tool", "run_id", "t")
    kept = dedup.keep_newest(quota, ["tool"], [F.desc_nulls_last("t"), F.desc("run_id")], max(3, 1))
    return quota.select("tool", "run_id").join(kept.select("tool", "run_id"), ["tool", "run_id"], "left_anti")


@query(" SELECT finding_id, min(row_id) AS row_id FROM f WHERE finding_id IS NOT NULL GROUP BY 1")
def first_seen_ids(spark: SparkSession, d: str) -> DataFrame:
    """Distinct finding ids with the row in which each is seen first."""
    return dedup.first_seen(findings(spark, d).where("finding_id is not null"), ["finding_id"], "row_id")


@query(""", t AS (SELECT path, function, kind, row_id, (evidence IS NOT NULL)::int + (status = 'confirmed')::int * 2 AS tier FROM (SELECT f.*, refs[1] AS evidence FROM f))
SELECT path, function, kind, arg_max(row_id, {'a': coalesce(tier, 0), 'c': row_id}) AS row_id, max(coalesce(tier, 0)) AS tier FROM t GROUP BY 1, 2, 3""")
def tier_merge(spark: SparkSession, d: str) -> DataFrame:
    """Per function and kind the row of the highest evidence tier; ties go to the newer row."""
    tier = F.coalesce(F.try_element_at("refs", F.lit(1)).isNotNull().cast("int") + (F.col("status") == "confirmed").cast("int") * 2, F.lit(0)).alias("tier")
    rows = findings(spark, d).select("path", "function", "kind", "row_id", tier)
    return dedup.best_rows(rows, ["path", "function", "kind"], [F.col("tier"), F.col("row_id")], ["row_id", "tier"])


@query(""", a AS (SELECT path, line, min(row_id) AS row_id FROM f WHERE tool = 'scanline' GROUP BY 1, 2), b AS (SELECT path, line, min(row_id) AS row_id FROM f WHERE tool = 'flowquarry' GROUP BY 1, 2)
SELECT path, line, coalesce(a.row_id, b.row_id) AS row_id, b.row_id IS NOT NULL AS in_second FROM a FULL JOIN b USING (path, line)""")
def union_of_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of two tools united by place: the first tool's row wins, places that the second has too are marked."""
    rows = findings(spark, d).select("path", "line", "row_id", F.col("row_id").alias("position"), "tool")
    first, second = (rows.where(F.col("tool") == t).drop("tool") for t in ("scanline", "flowquarry"))
    return dedup.union_flagged(first, second, ["path", "line"], "position").select("path", "line", "row_id", "in_second")


@query(""" SELECT path, function, arg_max(status, {'a': recorded_at, 'b': row_id}) AS status, max(recorded_at) IS NOT NULL AS dated FROM f WHERE status IS NOT NULL AND recorded_at IS NOT NULL GROUP BY 1, 2""")
def latest_entry(spark: SparkSession, d: str) -> DataFrame:
    """The newest verdict of each function."""
    rows = findings(spark, d).where("status is not null and recorded_at is not null")
    return dedup.best_rows(rows, ["path", "function"], [F.col("recorded_at"), F.col("row_id")], ["status"]).withColumn("dated", F.lit(True))


@query(""", l AS (SELECT DISTINCT path FROM f WHERE recorded_at >= TIMESTAMP '2025-01-01') SELECT row_id FROM f LEFT JOIN l USING (path) WHERE l.path IS NOT NULL OR coalesce(status IN ('exploitable', 'confirmed'), false)""")
def evict_stale(spark: SparkSession, d: str) -> DataFrame:
    """Findings whose file still has recent findings, and those whose tier keeps them in any case."""
    rows = findings(spark, d)
    living = rows.where(F.col("recorded_at") >= F.lit("2025-01-01").cast("timestamp_ntz"))
    return dedup.evict(rows, living, "path", F.coalesce(F.col("status").isin("exploitable", "confirmed"), F.lit(False))).select("row_id")


@query(""" SELECT row_id FROM f WHERE recorded_at >= (SELECT max(recorded_at) FROM f) - INTERVAL 180 DAY""")
def evict_expired(spark: SparkSession, d: str) -> DataFrame:
    """Entries that are at most 180 days older than the newest one."""
    rows = findings(spark, d).select("row_id", "recorded_at")
    newest = rows.agg(F.max("recorded_at").alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).where(F.expr("recorded_at >= newest - interval 180 days")).select("row_id")  # one row


_OLD = "recorded_at < TIMESTAMP '2024-07-01'"
_BEST = "arg_max(status, {'a': recorded_at, 'b': row_id})"


def _halves(spark: SparkSession, d: str, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    rows = findings(spark, d).where("recorded_at is not null")
    best = F.max(F.struct("recorded_at", "row_id", F.col(value).alias("v"))).alias("m")
    old = F.col("recorded_at") < F.lit("2024-07-01").cast("timestamp_ntz")
    return tuple(rows.where(c).groupBy(*keys).agg(best).select(*keys, F.col("m.v").alias(value)) for c in (old, ~old))  # type: ignore[return-value]


def _half_sql(keys: str, value: str, tail: str) -> str:
    best = f"max({{'a': recorded_at, 'b': row_id, 'v': {value}}}).v"
    return f""", o AS (SELECT {keys}, {best} AS old_value, true AS x FROM f WHERE recorded_at IS NOT NULL AND {_OLD} GROUP BY ALL),
  n AS (SELECT {keys}, {best} AS new_value, true AS y FROM f WHERE recorded_at IS NOT NULL AND NOT {_OLD} GROUP BY ALL)
SELECT {keys}, old_value, new_value, {tail} AS change FROM o FULL JOIN n USING ({keys})"""


_CHANGE = "CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN old_value IS NOT DISTINCT FROM new_value THEN 'unchanged' ELSE 'changed' END"


@query(_half_sql("path, function, line", "status", _CHANGE))
def run_diff(spark: SparkSession, d: str) -> DataFrame:
    """New, removed, changed and unchanged findings between two periods."""
    return setops.diff(*_halves(spark, d, ["path", "function", "line"], "status"), ["path", "function", "line"], "status")


@query(_half_sql("path", "cwe", "CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN old_value IS NULL OR new_value IS NULL OR old_value = new_value THEN 'unchanged' ELSE 'changed' END"))
def file_inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    """File inventory against an older one; a hash that is missing counts as unchanged."""
    return setops.diff_hashes(*_halves(spark, d, ["path"], "cwe"), ["path"], "cwe", missing_changes=False)


@query(_half_sql("path, function", "cwe", "CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN coalesce(old_value = new_value, false) THEN 'unchanged' ELSE 'changed' END"))
def function_inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    """Function inventory against an older one; a hash that is missing counts as changed."""
    return setops.diff_hashes(*_halves(spark, d, ["path", "function"], "cwe"), ["path", "function"], "cwe", missing_changes=True)


@query(f""", a AS (SELECT DISTINCT concat_ws(':', path, function, kind) AS k FROM f WHERE {_OLD}), b AS (SELECT DISTINCT concat_ws(':', path, function, kind) AS k FROM f WHERE NOT {_OLD}),
  j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT count(*) FILTER (y IS NULL) AS n_only_base, count(*) FILTER (x IS NULL) AS n_only_other, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_common,
  round(count(*) FILTER (y IS NULL) / nullif(count(*) FILTER (x IS NOT NULL), 0), 6) AS suppressed_share FROM j""")
def report_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many results of a base report are gone, new and common in another one, and the share suppressed."""
    rows = findings(spark, d).where("recorded_at is not null").select(F.concat_ws(":", "path", "function", "kind").alias("k"), "recorded_at")
    old = F.col("recorded_at") < F.lit("2024-07-01").cast("timestamp_ntz")
    return setops.overlap_counts(rows.where(old), rows.where(~old), "k")


@query(f""", o AS (SELECT cwe, count(*) AS n FROM f WHERE {_OLD} AND cwe IS NOT NULL GROUP BY 1), n AS (SELECT cwe, count(*) AS n FROM f WHERE NOT {_OLD} AND cwe IS NOT NULL GROUP BY 1)
SELECT cwe, coalesce(o.n, 0) AS n_old, coalesce(n.n, 0) AS n_new, coalesce(n.n, 0) - coalesce(o.n, 0) AS delta FROM o FULL JOIN n USING (cwe)""")
def delta_per_weakness(spark: SparkSession, d: str) -> DataFrame:
    """Findings per weakness in two periods and their difference; both counted in one pass."""
    old = F.col("recorded_at") < F.lit("2024-07-01").cast("timestamp_ntz")
    rows = findings(spark, d).where("cwe is not null and recorded_at is not null").groupBy("cwe").agg(F.count_if(old).alias("n_old"), F.count_if(~old).alias("n_new"))
    return rows.withColumn("delta", F.col("n_new") - F.col("n_old"))


@query(""", s AS (SELECT DISTINCT path, kind FROM f WHERE tool <> 'depsieve'), v AS (SELECT DISTINCT run_id, path, kind FROM f WHERE tool = 'depsieve')
SELECT run_id, count(*) AS n_items, count(*) FILTER (s.path IS NULL) AS n_lost, count(*) FILTER (s.path IS NULL) = 0 AS lossless FROM v LEFT JOIN s ON v.path = s.path AND v.kind = s.kind GROUP BY 1""")
def removable_without_loss(spark: SparkSession, d: str) -> DataFrame:
    """For each run of one tool, whether the runs of the others hold all of its findings."""
    rows = findings(spark, d)
    return setops.subsumed(rows.where("tool = 'depsieve'"), rows.where("tool <> 'depsieve'"), "run_id", ["path", "kind"])


@query(f""", o AS (SELECT DISTINCT tool, kind FROM f WHERE {_OLD}), n AS (SELECT DISTINCT tool, kind FROM f WHERE NOT {_OLD}), j AS (SELECT tool, kind, o.kind IS NOT NULL AND n.kind IS NULL AS gone, o.kind IS NULL AS come
  FROM (SELECT tool, kind FROM o UNION SELECT tool, kind FROM n) u LEFT JOIN o USING (tool, kind) LEFT JOIN n USING (tool, kind))
SELECT tool, coalesce(list_sort(list(kind) FILTER (come)), []) AS added, coalesce(list_sort(list(kind) FILTER (gone)), []) AS removed FROM (
  SELECT u.tool, u.kind, o.kind IS NULL AS come, n.kind IS NULL AS gone FROM (SELECT tool, kind FROM o UNION SELECT tool, kind FROM n) u LEFT JOIN o ON u.tool = o.tool AND u.kind = o.kind LEFT JOIN n ON u.tool = n.tool AND u.kind = n.kind) GROUP BY 1""")
def capability_diff(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of finding that each tool gained and lost between two periods."""
    rows = findings(spark, d).where("recorded_at is not null")
    old = F.col("recorded_at") < F.lit("2024-07-01").cast("timestamp_ntz")
    return setops.set_diff(rows.where(old), rows.where(~old), "tool", "kind")


@query(" SELECT kind, list_sort(list(DISTINCT tool)) AS tools, count(DISTINCT run_id) AS n_runs FROM f GROUP BY 1")
def pack_merge(spark: SparkSession, d: str) -> DataFrame:
    """Names united over all sources, with their provenance."""
    return findings(spark, d).groupBy("kind").agg(F.array_sort(F.collect_set("tool")).alias("tools"), F.countDistinct("run_id").alias("n_runs"))


@query(f""", a AS (SELECT DISTINCT cwe FROM f WHERE {_OLD} AND cwe IS NOT NULL), b AS (SELECT DISTINCT cwe FROM f WHERE NOT {_OLD} AND cwe IS NOT NULL) SELECT cwe FROM b EXCEPT SELECT cwe FROM a""")
def introduced(spark: SparkSession, d: str) -> DataFrame:
    """Weaknesses of the newer version that the older one has not."""
    rows = findings(spark, d).where("cwe is not null and recorded_at is not null")
    old = F.col("recorded_at") < F.lit("2024-07-01").cast("timestamp_ntz")
    return rows.where(~old).select("cwe").distinct().join(rows.where(old).select("cwe").distinct(), "cwe", "left_anti")


#: Weaknesses that count as one family when labels are compared.
FAMILIES = {"CWE-89": ["CWE-90"], "CWE-78": ["CWE-88"], "CWE-79": ["CWE-80"], "CWE-120": ["CWE-121", "CWE-122"]}
_FAMILY = " OR ".join(f"(e.cwe = '{k}' AND p.cwe IN ({', '.join(repr(x) for x in v)}))" for k, v in FAMILIES.items())
_SIDES = """, e AS (SELECT row_id AS expected_id, path AS file, cwe, line AS line_start, line + 2 AS line_end, regexp_extract(path, '([^/]*)$', 1) AS base FROM f WHERE status IN ('confirmed', 'exploitable') AND cwe IS NOT NULL),
  p AS (SELECT row_id AS produced_id, path AS file, cwe, line AS start_line, tool, regexp_extract(path, '([^/]*)$', 1) AS base FROM f WHERE status NOT IN ('confirmed', 'exploitable') AND cwe IS NOT NULL)"""
_MATCH = f""", m AS (SELECT e.expected_id, p.produced_id FROM e JOIN p ON e.base = p.base AND (ends_with(e.file, p.file) OR ends_with(p.file, e.file))
  AND p.start_line <= e.line_end + 10 AND p.start_line >= e.line_start - 10 AND (e.cwe = p.cwe OR {_FAMILY}))"""


def _tolerance(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = findings(spark, d).where("cwe is not null and status is not null")
    truth = F.col("status").isin("confirmed", "exploitable")
    expected = rows.where(truth).select(F.col("row_id").alias("expected_id"), F.col("path").alias("file"), "cwe", F.col("line").alias("line_start"), (F.col("line") + 2).alias("line_end"))
    produced = rows.where(~truth).select(F.col("row_id").alias("produced_id"), F.col("path").alias("file"), "cwe", F.col("line").alias("start_line"), F.lit(None).cast("int").alias("end_line"), "tool")
    return expected, produced, joins.tolerance_match(expected, produced, 10, FAMILIES)


@query(_SIDES + _MATCH + " SELECT expected_id, produced_id FROM m")
def tolerance_match(spark: SparkSession, d: str) -> DataFrame:
    """Expected and produced findings that agree on path, line and weakness within tolerance."""
    return _tolerance(spark, d)[2]


@query(_SIDES + _MATCH + """ SELECT e.cwe, count(DISTINCT e.expected_id) AS n_expected, count(DISTINCT m.expected_id) AS n_found, round(count(DISTINCT m.expected_id) / count(DISTINCT e.expected_id), 6) AS recall,
  coalesce(list_sort(list(DISTINCT p.tool) FILTER (p.tool IS NOT NULL)), []) AS tools FROM e LEFT JOIN m USING (expected_id) LEFT JOIN p USING (produced_id) GROUP BY 1""")
def recall_by_weakness(spark: SparkSession, d: str) -> DataFrame:
    """Expected and found labels per weakness, with the tools that found them."""
    expected, produced, pairs = _tolerance(spark, d)
    hits = pairs.join(produced.select("produced_id", "tool"), "produced_id").groupBy("expected_id").agg(F.collect_set("tool").alias("tools"))
    per = expected.join(hits, "expected_id", "left").groupBy("cwe")
    found = F.count("tools")
    return per.agg(F.count("*").alias("n_expected"), found.alias("n_found"), F.round(found / F.count("*"), 6).alias("recall"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tools")))).alias("tools"))


@query(_SIDES + _MATCH + """ SELECT count(DISTINCT e.expected_id) FILTER (m.expected_id IS NOT NULL) AS n_true, count(DISTINCT e.expected_id) FILTER (m.expected_id IS NULL) AS n_missed,
  (SELECT count(*) FROM p WHERE produced_id NOT IN (SELECT produced_id FROM m)) AS n_false FROM e LEFT JOIN m USING (expected_id)""")
def ground_truth_counts(spark: SparkSession, d: str) -> DataFrame:
    """True, missed and false findings against the labels."""
    expected, produced, pairs = _tolerance(spark, d)
    e = expected.join(pairs.select("expected_id").distinct().withColumn("hit", F.lit(True)), "expected_id", "left")
    p = produced.join(pairs.select("produced_id").distinct(), "produced_id", "left_anti").agg(F.count("*").alias("n_false"))
    return e.agg(F.count("hit").alias("n_true"), F.count_if(F.col("hit").isNull()).alias("n_missed")).crossJoin(p)  # one row each


_RULES = [
    (1, "accepted", "2025-06-30", None, "sql_injection", "scanline"),
    (2, "test code", None, "CWE-79", None, "patternmill"),
    (3, "old", "2023-12-31", None, "path_traversal", None),
    (4, "vendored", None, "CWE-120", "buffer_overflow", None),
    (5, "no keys", None, None, None, None),
]
_RULE_SQL = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in _RULES)


@query(f""", s(rule_no, reason, expires, cwe, kind, tool) AS (VALUES {_RULE_SQL})
SELECT row_id, min(rule_no) AS rule_no, arg_min(reason, rule_no) AS reason FROM f JOIN s ON (s.cwe IS NULL OR s.cwe = f.cwe) AND (s.kind IS NULL OR s.kind = f.kind) AND (s.tool IS NULL OR s.tool = f.tool)
  AND NOT (s.cwe IS NULL AND s.kind IS NULL AND s.tool IS NULL) AND (s.expires IS NULL OR NOT DATE '2025-06-30' > s.expires::date) GROUP BY 1""")
def suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Findings that a rule suppresses: null keys are wildcards, the first rule that has not expired wins."""
    rules = spark.createDataFrame(_RULES, "rule_no int, reason string, expires string, cwe string, kind string, tool string").withColumn("expires", F.col("expires").cast("date"))
    return joins.first_rule(findings(spark, d), rules, "row_id", ["cwe", "kind", "tool"], F.lit("2025-06-30").cast("date"))


#: Order of severities.
SEVERITY_ORDER = {"informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
_SEV = "CASE lower(trim(severity)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_ORDER.items()) + " ELSE 0 END"


@query(f""" SELECT kind, count(*) FILTER ({_SEV} >= CASE kind WHEN 'sql_injection' THEN 3 WHEN 'command_injection' THEN 4 ELSE 99 END) AS n_failing,
  count(*) FILTER ({_SEV} >= CASE kind WHEN 'sql_injection' THEN 3 WHEN 'command_injection' THEN 4 ELSE 99 END) = 0 AS passed FROM f GROUP BY 1""")
def threshold_gate(spark: SparkSession, d: str) -> DataFrame:
    """Findings at or above the severity floor of their class, and whether the class passes."""
    rank = dedup.lookup(F.lower(F.trim("severity")), SEVERITY_ORDER, 0)
    floor = dedup.lookup(F.col("kind"), {"sql_injection": 3, "command_injection": 4}, 99)
    failing = F.count_if(rank >= floor)
    return findings(spark, d).groupBy("kind").agg(failing.alias("n_failing"), (failing == 0).alias("passed"))


_SPANS = """, s AS (SELECT path, function AS name, min(line) AS lo, max(line) AS hi, min(row_id) AS position FROM f WHERE line IS NOT NULL GROUP BY 1, 2),
  q AS (SELECT row_id, path, line FROM f WHERE line IS NOT NULL)"""


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = findings(spark, d).where("line is not null")
    spans = rows.groupBy("path", F.col("function").alias("name")).agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.min("row_id").alias("position"))
    return rows.select("row_id", "path", "line"), spans


@query(_SPANS + """, w AS (SELECT q.row_id, s.name, row_number() OVER (PARTITION BY q.row_id ORDER BY s.lo DESC, s.position DESC) AS k FROM q JOIN s ON q.path = s.path AND q.line BETWEEN s.lo AND s.hi)
SELECT q.row_id, w.name FROM q LEFT JOIN w ON q.row_id = w.row_id AND w.k = 1""")
def innermost_item(spark: SparkSession, d: str) -> DataFrame:
    """The innermost span of its file around each finding."""
    points, spans = _spans(spark, d)
    return joins.innermost(points, spans, "path", "line", "row_id")


@query(_SPANS.replace("max(line) AS hi", "CASE WHEN count(*) > 1 THEN max(line) END AS hi") + """, w AS (SELECT q.row_id, s.name, row_number() OVER (PARTITION BY q.row_id ORDER BY s.hi IS NULL, CASE WHEN s.hi IS NOT NULL THEN s.position END, s.lo DESC, s.position) AS k
  FROM q JOIN s ON q.path = s.path AND s.lo <= q.line AND (s.hi IS NULL OR s.hi >= q.line)) SELECT q.row_id, w.name FROM q LEFT JOIN w ON q.row_id = w.row_id AND w.k = 1""")
def containing_function(spark: SparkSession, d: str) -> DataFrame:
    """The first span in list order around each finding, else the nearest open-ended one before it."""
    rows = findings(spark, d).where("line is not null")
    hi = F.when(F.count("*") > 1, F.max("line")).alias("hi")
    spans = rows.groupBy("path", F.col("function").alias("name")).agg(F.min("line").alias("lo"), hi, F.min("row_id").alias("position"))
    return joins.first_containing(rows.select("row_id", "path", "line"), spans, "path", "line", "row_id")


@query(""", r AS (SELECT DISTINCT regexp_replace(path, '^[^/]+/', '') AS p FROM f WHERE path IS NOT NULL), k AS (SELECT DISTINCT path AS known FROM f WHERE tool = 'scanline'),
  m AS (SELECT p, known FROM r JOIN k ON known = p OR ends_with(known, '/' || p) OR ends_with(p, '/' || known))
SELECT r.p AS path, coalesce(max(CASE WHEN known = r.p THEN known END), CASE WHEN count(DISTINCT known) = 1 THEN max(known) END) AS resolved FROM r LEFT JOIN m USING (p) GROUP BY r.p""")
def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortened paths resolved to the one known path that ends with them, null where that is ambiguous."""
    rows = findings(spark, d)
    raw = rows.where("path is not null").select(F.regexp_replace("path", "^[^/]+/", "").alias("path"))
    return joins.resolve_suffix(raw, rows.where("tool = 'scanline'").select("path"), "path")


@query(""", c AS (SELECT path, function, max(recorded_at) AS t, arg_max(status, {'a': recorded_at, 'b': row_id}) AS verdict, max({'a': recorded_at, 'b': row_id}).b AS correction FROM f WHERE status IN ('false_positive', 'confirmed') GROUP BY 1, 2),
  e AS (SELECT path, function, recorded_at AS t, tool FROM f WHERE status NOT IN ('false_positive', 'confirmed') AND tool IS NOT NULL)
SELECT c.correction, c.verdict, (SELECT max(e.tool) FROM e WHERE e.path = c.path AND e.function = c.function AND e.t = (SELECT max(t) FROM e WHERE e.path = c.path AND e.function = c.function AND e.t <= c.t)) AS channel FROM c""")
def evidence_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The latest correction of each function with the newest tool evidence before it."""
    rows = findings(spark, d).where("recorded_at is not null and status is not null").withColumn("k", F.concat_ws("\x1f", "path", "function"))
    settled = F.col("status").isin("false_positive", "confirmed")
    last = F.max(F.struct("recorded_at", "row_id", "status")).alias("m")
    corrections = rows.where(settled).groupBy("k").agg(last).select("k", F.col("m.recorded_at").alias("t"), F.col("m.row_id").alias("correction"), F.col("m.status").alias("verdict"))
    found = joins.as_of(corrections, rows.where(~settled & F.col("tool").isNotNull()), "k", "t", "recorded_at", "correction", "tool")
    return corrections.select("correction", "verdict").join(found.withColumnRenamed("tool", "channel"), "correction")


@query(""", e AS (SELECT path, function, arg_max(status, {'a': recorded_at, 'b': row_id}) AS status, max({'a': recorded_at, 'b': row_id}).b AS row_id FROM f WHERE status IN ('false_positive', 'confirmed') AND recorded_at IS NOT NULL GROUP BY 1, 2),
  x AS (SELECT DISTINCT path, function, unnest(refs) AS channel FROM f)
SELECT channel, count(*) FILTER (status = 'confirmed') AS survived, count(*) FILTER (status = 'false_positive') AS disproven, count(*) AS n FROM e JOIN x USING (path, function) GROUP BY 1""")
def survival_by_channel(spark: SparkSession, d: str) -> DataFrame:
    """How the findings of each channel fared: channels exploded, verdicts pivoted."""
    rows = findings(spark, d)
    last = F.max(F.struct("recorded_at", "row_id", "status")).alias("m")
    verdicts = rows.where(F.col("status").isin("false_positive", "confirmed") & F.col("recorded_at").isNotNull()).groupBy("path", "function").agg(last).select("path", "function", F.col("m.status").alias("status"))
    channels = rows.select("path", "function", F.explode("refs").alias("channel")).distinct()
    counted = verdicts.join(channels, ["path", "function"]).groupBy("channel")
    return counted.agg(F.count_if(F.col("status") == "confirmed").alias("survived"), F.count_if(F.col("status") == "false_positive").alias("disproven"), F.count("*").alias("n"))
