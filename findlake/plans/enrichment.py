"""Queries that enrich, gate and document: signals, matches, policies, nested columns, advisories against packages,
documents for other tools, and a stream held against its batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.functions import text, versions
from findlake.functions.findings import SQL as F_SQL
from findlake.operators import aggregates as agg
from findlake.operators import joins, nested, orphans
from findlake.plans.findings import findings
from findlake.plans.measures import NO, YES, verdict
from findlake.session import shared_dir, table
from findlake.sources import sinks
from findlake.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_Q = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def query(sql: str | None = None, with_findings: bool = True):  # noqa: ANN201
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (F_SQL if with_findings else "") + sql
        return f

    return add


@query(" SELECT row_id, path, line, kind, coalesce(cwe, 'none') AS cwe, coalesce(status, 'open') AS status FROM f WHERE NOT coalesce(status = 'test_code', false)")
def public_view(spark: SparkSession, d: str) -> DataFrame:
    """The columns of a finding that may be shown, with defaults."""
    rows = findings(spark, d).where(~F.coalesce(F.col("status") == "test_code", F.lit(False)))
    return rows.select("row_id", "path", "line", "kind", F.coalesce("cwe", F.lit("none")).alias("cwe"), F.coalesce("status", F.lit("open")).alias("status"))


@query(r""" SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY row_id) AS no, regexp_extract(path, '([^/]*)$', 1) AS file, function, kind FROM f""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a run's report, numbered, with the file name only."""
    no = F.row_number().over(Window.partitionBy("run_id").orderBy("row_id"))
    return findings(spark, d).select("run_id", no.alias("no"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "function", "kind")


@query("SELECT finding_row, coalesce(nullif(trim(final_status), ''), nullif(trim(status), ''), CASE WHEN evidence_tool IS NOT NULL THEN 'evidenced' END) AS status FROM finding", False)
def first_status(spark: SparkSession, d: str) -> DataFrame:
    """The first of several status fields that holds something."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "finding").select("finding_row", F.coalesce(blank("final_status"), blank("status"), F.when(F.col("evidence_tool").isNotNull(), "evidenced")).alias("status"))


@query(f""", c AS (SELECT model, kind, count(*) FILTER (status IN {_Q(YES)}) AS y, count(*) FILTER (status IN {_Q(NO)}) AS n FROM f WHERE model IS NOT NULL GROUP BY 1, 2)
SELECT model, kind, CASE WHEN y + n < 5 THEN 'unproven' WHEN y / (y + n) >= 0.5 THEN 'use' ELSE 'skip' END AS decision FROM c""")
def trust_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether to use a model for a kind: undecided below five events."""
    v = verdict(F.col("status"))
    c = findings(spark, d).where("model is not null").groupBy("model", "kind").agg(F.count_if(v).alias("y"), F.count_if(~v).alias("n"))
    share = F.try_divide(F.col("y").cast("double"), (F.col("y") + F.col("n")).cast("double"))
    return c.select("model", "kind", F.when(F.col("y") + F.col("n") < 5, "unproven").when(share >= 0.5, "use").otherwise("skip").alias("decision"))


@query(f""", w AS (SELECT finding_id, row_id, status, first_value(status) OVER (PARTITION BY finding_id ORDER BY recorded_at DESC, row_id DESC) AS last FROM f WHERE finding_id IS NOT NULL AND recorded_at IS NOT NULL)
SELECT row_id, CASE WHEN status IS NULL OR last IS NULL OR NOT (status IN {_Q(YES + NO)}) OR NOT (last IN {_Q(YES + NO)}) THEN NULL WHEN (status IN {_Q(YES)}) = (last IN {_Q(YES)}) THEN 'correct' ELSE 'incorrect' END AS outcome FROM w""")
def feedback_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Each verdict against the last one of its finding: correct, incorrect, or null without two verdicts.

    The last verdict is an aggregate joined back, so a finding with many reports isn't one window."""
    rows = findings(spark, d).where("finding_id is not null and recorded_at is not null")
    last = rows.groupBy("finding_id").agg(F.max(F.struct("recorded_at", "row_id", "status")).alias("m")).select("finding_id", F.col("m.status").alias("last"))
    a, b = verdict(F.col("status")), verdict(F.col("last"))
    return rows.join(last, "finding_id").select("row_id", F.when(a == b, "correct").when(a != b, "incorrect").alias("outcome"))


@query(r""", k AS (SELECT repo_url, count(*) FILTER (regexp_matches(path, '(^|/)(lib|core)/')) AS l, count(*) FILTER (regexp_matches(path, '(^|/)(web|ui|tools)/')) AS a FROM f GROUP BY 1)
SELECT repo_url, CASE WHEN l > 2 * a THEN 'library' WHEN a > 2 * l THEN 'application' ELSE 'hybrid' END AS target_kind FROM k""")
def target_kinds(spark: SparkSession, d: str) -> DataFrame:
    """library, application or hybrid, by where a repository's findings lie."""
    p = F.col("path")
    k = findings(spark, d).groupBy("repo_url").agg(F.count_if(p.rlike("(^|/)(lib|core)/")).alias("l"), F.count_if(p.rlike("(^|/)(web|ui|tools)/")).alias("a"))
    return k.select("repo_url", F.when(F.col("l") > 2 * F.col("a"), "library").when(F.col("a") > 2 * F.col("l"), "application").otherwise("hybrid").alias("target_kind"))


@query(r"""WITH a AS (SELECT DISTINCT osv_id, unnest(regexp_extract_all(json, 'CVE-\d{4}-\d{4,}')) AS cve FROM advisories), s AS (SELECT DISTINCT upper(regexp_replace(cve_id, '[^0-9A-Za-z]+', '', 'g')) AS k, cwe_id FROM cwe_classification WHERE cwe_id IS NOT NULL),
  x AS (SELECT DISTINCT upper(regexp_replace(cve_id, '[^0-9A-Za-z]+', '', 'g')) AS k FROM fixes)
SELECT a.osv_id, count(DISTINCT a.cve) AS n_aliases, coalesce(list_sort(list(DISTINCT s.cwe_id) FILTER (s.cwe_id IS NOT NULL)), []) AS weaknesses, bool_or(x.k IS NOT NULL) AS has_fix FROM a LEFT JOIN s ON s.k = replace(a.cve, '-', '') LEFT JOIN x ON x.k = replace(a.cve, '-', '') GROUP BY 1""", False)
def advisory_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals joined to advisories by any alias: weaknesses united, a flag if any alias has it.

    Signals are reduced to one row per CVE before the join, so a CVE with many rows doesn't multiply."""
    a = table(spark, d, "advisories").select("osv_id", F.explode(F.array_distinct(F.regexp_extract_all("json", F.lit(r"CVE-\d{4}-\d{4,}"), F.lit(0)))).alias("cve")).distinct().withColumn("k", F.replace("cve", F.lit("-"), F.lit("")))
    s = table(spark, d, "cwe_classification").where("cwe_id is not null").select(orphans.cve_key(F.col("cve_id")).alias("k"), "cwe_id").groupBy("k").agg(F.collect_set("cwe_id").alias("w"))
    x = table(spark, d, "fixes").select(orphans.cve_key(F.col("cve_id")).alias("k")).where("k is not null").distinct().withColumn("fix", F.lit(True))
    joined = a.join(s, "k", "left").join(x, "k", "left").groupBy("osv_id")
    return joined.agg(F.countDistinct("cve").alias("n_aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("w", F.array().cast("array<string>")))))).alias("weaknesses"), F.coalesce(F.bool_or("fix"), F.lit(False)).alias("has_fix"))


@query(""", e AS (SELECT row_id AS w, path, cwe, regexp_extract(path, '([^/]*)$', 1) AS base FROM f WHERE tool = 'fuzzlantern' AND cwe IS NOT NULL), t AS (SELECT row_id, path, cwe, regexp_extract(path, '([^/]*)$', 1) AS base FROM f WHERE tool = 'scanline'),
  p AS (SELECT t.row_id, e.w, CASE WHEN e.path = t.path AND e.cwe = t.cwe THEN 7 WHEN e.path = t.path THEN 4 WHEN e.cwe = t.cwe THEN 2 ELSE 0 END AS score FROM t JOIN e ON t.base = e.base)
SELECT row_id, arg_max(w, {'a': score, 'b': -w}) AS witness, max(score) AS score FROM p WHERE score > 0 GROUP BY 1""")
def best_witness(spark: SparkSession, d: str) -> DataFrame:
    """The best-scoring witness of each finding: same place and weakness, same place, same weakness in a file of the same
    name; of equals the smaller row. No pairs: the least witness of each place and weakness is joined, three times."""
    rows = findings(spark, d).withColumn("base", joins.basename(F.col("path")))
    e = rows.where("tool = 'fuzzlantern' and cwe is not null").groupBy("path", "base", "cwe").agg(F.min("row_id").alias("w"))
    out = rows.where("tool = 'scanline'").select("row_id", "path", "cwe", "base")
    choices = []
    for score, keys in ((7, ["path", "cwe"]), (4, ["path"]), (2, ["base", "cwe"])):
        out = out.join(e.groupBy(*keys).agg(F.min("w").alias(f"w{score}")), keys, "left")
        choices.append(F.when(F.col(f"w{score}").isNotNull(), F.struct(F.col(f"w{score}").alias("witness"), F.lit(score).alias("score"))))
    return out.select("row_id", F.coalesce(*choices).alias("m")).where("m is not null").select("row_id", "m.witness", "m.score")


@query(""", c AS (SELECT repo_url, path, count(DISTINCT tool) AS n_tools, count(DISTINCT cwe) AS n_cwes FROM f GROUP BY 1, 2) SELECT repo_url, count(*) AS n_files, count(*) FILTER (n_tools = 1) AS n_single, round(avg(n_tools), 6) AS mean_tools FROM c GROUP BY 1""")
def source_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How many sources agree on the files of each repository."""
    c = findings(spark, d).groupBy("repo_url", "path").agg(F.countDistinct("tool").alias("n_tools"))
    return c.groupBy("repo_url").agg(F.count("*").alias("n_files"), F.count_if(F.col("n_tools") == 1).alias("n_single"), F.round(F.avg("n_tools"), 6).alias("mean_tools"))


@query(""", e AS (SELECT DISTINCT repo_url, function FROM f WHERE starts_with(lower(function), 'parse')), s AS (SELECT DISTINCT repo_url, function AS sink FROM f WHERE cwe = 'CWE-78')
SELECT repo_url, (SELECT count(*) FROM e WHERE e.repo_url = r.repo_url) * (SELECT count(*) FROM s WHERE s.repo_url = r.repo_url) AS n_pairs FROM (SELECT DISTINCT repo_url FROM e) r""")
def taint_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entry points times sinks of each repository: counted as a product of two counts, never paired out."""
    rows = findings(spark, d)
    e = rows.where(F.startswith(F.lower("function"), F.lit("parse"))).groupBy("repo_url").agg(F.countDistinct("function").alias("a"))
    s = rows.where("cwe = 'CWE-78'").groupBy("repo_url").agg(F.countDistinct("function").alias("b"))
    return e.join(s, "repo_url", "left").select("repo_url", (F.col("a") * F.coalesce("b", F.lit(0))).alias("n_pairs"))


@query(f""", e AS (SELECT path, line FROM f WHERE status IN {_Q(YES)} AND line IS NOT NULL GROUP BY 1, 2), s AS (SELECT row_id, path, line FROM f WHERE status IN {_Q(NO)})
SELECT CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.path = s.path AND abs(e.line - s.line) <= 10) THEN 'on_expected' WHEN EXISTS (SELECT 1 FROM e WHERE e.path = s.path) THEN 'same_file' ELSE 'elsewhere' END AS proximity, count(*) AS n FROM s GROUP BY 1""")
def suppression_proximity(spark: SparkSession, d: str) -> DataFrame:
    """How near each suppression lies to an expected finding: the nearest expected lines before and after it are carried
    over the sorted lines of the file, so suppressions and expectations are never paired out."""
    rows = findings(spark, d)
    e = rows.where(F.col("status").isin(*YES) & F.col("line").isNotNull()).select("path", "line", F.lit(1).alias("kind"), F.lit(1).alias("n")).distinct()
    s = rows.where(F.col("status").isin(*NO)).groupBy("path", "line").agg(F.count("*").alias("n")).select("path", "line", F.lit(0).alias("kind"), "n")
    order = Window.partitionBy("path").orderBy("line")
    mark = F.when(F.col("kind") == 1, F.col("line"))
    near = e.unionByName(s).select(
        "kind", "line", "n", F.last(mark, True).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("before"), F.first(mark, True).over(order.rangeBetween(0, Window.unboundedFollowing)).alias("after"),
        F.max("kind").over(Window.partitionBy("path")).alias("any"),
    )
    close = (F.col("line") - F.col("before") <= 10) | (F.col("after") - F.col("line") <= 10)
    return near.where("kind = 0").groupBy(F.when(close, "on_expected").when(F.col("any") == 1, "same_file").otherwise("elsewhere").alias("proximity")).agg(F.sum("n").alias("n"))


@query("""WITH s(language, kind, safe) AS (VALUES ('C', 'sql_injection', false), ('Java', 'buffer_overflow', true), ('Python', 'buffer_overflow', true), ('Python', 'use_after_free', true)),
 x AS (SELECT repo_url, lower(regexp_replace(regexp_replace(regexp_replace(vuln_type, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS kind FROM finding)
SELECT r.repo_language AS language, x.kind, count(*) AS n FROM x JOIN repository r USING (repo_url) JOIN s ON s.language = r.repo_language AND s.kind = x.kind AND s.safe GROUP BY 1, 2""".replace("\\\\", "\\"), False)
def known_safe(spark: SparkSession, d: str) -> DataFrame:
    """Findings of kinds that their language excludes, by a fixed table."""
    safe = spark.createDataFrame([("Java", "buffer_overflow"), ("Python", "buffer_overflow"), ("Python", "use_after_free")], "language string, kind string")
    r = table(spark, d, "repository").select("repo_url", F.col("repo_language").alias("language"))
    return findings(spark, d).join(r, "repo_url").join(F.broadcast(safe), ["language", "kind"]).groupBy("language", "kind").agg(F.count("*").alias("n"))  # three rows


@query("""WITH v(name, parts) AS (VALUES ('2.17', [2, 17]), ('2.28', [2, 28]), ('2.31', [2, 31])), d AS (SELECT DISTINCT [2, (doc_id % 40)::int] AS target FROM documents) SELECT target, arg_max(name, parts) FILTER (parts <= target) AS resolved FROM d, v GROUP BY 1""", False)
def greatest_below(spark: SparkSession, d: str) -> DataFrame:
    """The greatest candidate version that is not above each target; null if all are."""
    found = [("2.17", [2, 17]), ("2.28", [2, 28]), ("2.31", [2, 31])]
    candidates = F.array(*[F.struct(F.array(*map(F.lit, p)).alias("p"), F.lit(n).alias("n")) for n, p in found])
    targets = table(spark, d, "documents").select(F.array(F.lit(2), (F.col("doc_id") % 40).cast("int")).alias("target")).distinct()
    below = F.filter(candidates, lambda c: c["p"] <= F.col("target"))
    return targets.select("target", F.array_max(below)["n"].alias("resolved"))


@query(f""", m AS (SELECT DISTINCT path, unnest(range(line, line + 3)) AS x FROM f WHERE tool = 'flowquarry' AND line IS NOT NULL) SELECT f.row_id, CASE WHEN f.line IS NULL THEN NULL ELSE EXISTS (SELECT 1 FROM m WHERE m.path = f.path AND m.x = f.line) END AS executed FROM f WHERE tool <> 'flowquarry'""")
def blamed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whether another tool's coverage has the line that a finding blames."""
    rows = findings(spark, d)
    covered = rows.where("tool = 'flowquarry' and line is not null").select("path", F.explode(F.sequence("line", F.col("line") + 2)).alias("line")).distinct().withColumn("hit", F.lit(True))
    return rows.where("tool <> 'flowquarry'").join(covered, ["path", "line"], "left").select("row_id", F.when(F.col("line").isNotNull(), F.coalesce("hit", F.lit(False))).alias("executed"))


@query(r"""WITH a AS (SELECT DISTINCT osv_id, unnest(regexp_extract_all(json, 'CVE-\d{4}-\d{4,}')) AS cve FROM advisories), x AS (SELECT upper(trim(cve_id)) AS cve, count(DISTINCT hash) AS n FROM fixes GROUP BY 1)
SELECT a.osv_id, CASE WHEN max(x.n) IS NULL THEN 'orphan' WHEN max(x.n) = 1 THEN 'unique' ELSE 'ambiguous' END AS truth FROM a LEFT JOIN x USING (cve) GROUP BY 1""", False)
def advisory_truth(spark: SparkSession, d: str) -> DataFrame:
    """Whether an advisory's fix is unique, ambiguous or an orphan."""
    a = table(spark, d, "advisories").select("osv_id", F.explode(F.regexp_extract_all("json", F.lit(r"CVE-\d{4}-\d{4,}"), F.lit(0))).alias("cve")).distinct()
    x = table(spark, d, "fixes").groupBy(F.upper(F.trim("cve_id")).alias("cve")).agg(F.countDistinct("hash").alias("n"))
    n = F.max("n")
    return a.join(x, "cve", "left").groupBy("osv_id").agg(F.when(n.isNull(), "orphan").when(n == 1, "unique").otherwise("ambiguous").alias("truth"))


@query(f""", r AS (SELECT path, function, count(*) AS iterations, bool_or(tool = 'fuzzlantern') AS reached, count(*) FILTER (tool = 'fuzzlantern' AND status IN {_Q(YES)}) AS crashes FROM f GROUP BY 1, 2) SELECT path, count(*) AS n_functions, count(*) FILTER (reached) AS n_reached, sum(crashes)::bigint AS n_crashes FROM r GROUP BY 1""")
def fuzz_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Functions of each file that fuzzing has reached, with its crashes."""
    fuzz = F.col("tool") == "fuzzlantern"
    r = findings(spark, d).groupBy("path", "function").agg(F.bool_or(fuzz).alias("reached"), F.count_if(fuzz & F.col("status").isin(*YES)).alias("crashes"))
    return r.groupBy("path").agg(F.count("*").alias("n_functions"), F.count_if("reached").alias("n_reached"), F.sum("crashes").alias("n_crashes"))


@query(""", s AS (SELECT finding_id, list_sort(list(DISTINCT kind)) AS expected, list_sort(list(DISTINCT kind) FILTER (tool = 'scanline')) AS seen FROM f WHERE finding_id IS NOT NULL GROUP BY 1)
SELECT finding_id, len(expected) AS n_expected, coalesce(len(list_intersect(expected, seen)), 0) AS n_seen FROM s""")
def mechanism_attribution(spark: SparkSession, d: str) -> DataFrame:
    """How many of the mechanisms expected for a finding one tool has seen."""
    s = findings(spark, d).where("finding_id is not null").groupBy("finding_id").agg(F.collect_set("kind").alias("e"), F.collect_set(F.when(F.col("tool") == "scanline", F.col("kind"))).alias("s"))
    return s.select("finding_id", F.size("e").alias("n_expected"), F.size(F.array_intersect("e", "s")).alias("n_seen"))


@query(f""" SELECT kind, cwe, count(*) AS n, count(DISTINCT repo_url) AS n_repos FROM f WHERE status IN {_Q(YES)} AND cwe IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""")
def invariant_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed outcomes that recur at least three times."""
    rows = findings(spark, d).where(F.col("status").isin(*YES) & F.col("cwe").isNotNull())
    return rows.groupBy("kind", "cwe").agg(F.count("*").alias("n"), F.countDistinct("repo_url").alias("n_repos")).where("n >= 3")


@query(f""" SELECT CASE WHEN score >= 7 THEN 'deep' WHEN score >= 4 THEN 'normal' ELSE 'shallow' END AS depth, coalesce(cwe, 'none') AS mode, count(*) FILTER (status IN {_Q(YES)}) AS tp, count(*) FILTER (status IN {_Q(NO)}) AS fn FROM f GROUP BY 1, 2""")
def cell_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Hits and misses per cell of depth and failure mode."""
    depth = F.when(F.col("score") >= 7, "deep").when(F.col("score") >= 4, "normal").otherwise("shallow")
    v = verdict(F.col("status"))
    return findings(spark, d).groupBy(depth.alias("depth"), F.coalesce("cwe", F.lit("none")).alias("mode")).agg(F.count_if(v).alias("tp"), F.count_if(~v).alias("fn"))


@query("SELECT coalesce(evidence_tool, 'none') AS source, coalesce(lower(trim(status)), 'unknown') AS outcome, count(*) AS n FROM finding GROUP BY 1, 2", False)
def witness_summary(spark: SparkSession, d: str) -> DataFrame:
    """Evidence by source and outcome."""
    return table(spark, d, "finding").groupBy(F.coalesce("evidence_tool", F.lit("none")).alias("source"), F.coalesce(F.lower(F.trim("status")), F.lit("unknown")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f""", s AS (SELECT kind, tool, avg((status IN {_Q(YES)})::int) AS rate, count(*) AS n FROM f WHERE status IS NOT NULL GROUP BY 1, 2) SELECT kind, arg_max(tool, {{'a': round(rate, 9), 'b': tool}}) AS best, round(max(rate), 6) AS rate FROM s GROUP BY 1""")
def best_strategy(spark: SparkSession, d: str) -> DataFrame:
    """The strategy with the best success rate for each kind."""
    rate = F.avg(F.col("status").isin(*YES).cast("int"))
    s = findings(spark, d).where("status is not null").groupBy("kind", "tool").agg(rate.alias("rate"))
    return s.groupBy("kind").agg(F.max_by("tool", F.struct(F.round("rate", 9), F.col("tool"))).alias("best"), F.round(F.max("rate"), 6).alias("rate"))


@query("SELECT 'finding' AS kind, count(*) AS n FROM finding UNION ALL SELECT 'commit', count(*) FROM commits UNION ALL SELECT 'fix', count(*) FROM fixes UNION ALL SELECT 'class', count(*) FROM cwe_classification", False)
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """Nodes per kind of the property graph that the tables make."""
    out = None
    for kind, name in (("finding", "finding"), ("commit", "commits"), ("fix", "fixes"), ("class", "cwe_classification")):
        part = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT ecosystem, lower(package) AS name, count(DISTINCT package) AS n_spellings, count(DISTINCT osv_id) AS n_advisories FROM advisories GROUP BY 1, 2 HAVING count(DISTINCT package) > 1 AND count(DISTINCT osv_id) > 1", False)
def inconsistent_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages that are written in more than one way and place."""
    g = table(spark, d, "advisories").groupBy("ecosystem", F.lower("package").alias("name")).agg(F.countDistinct("package").alias("n_spellings"), F.countDistinct("osv_id").alias("n_advisories"))
    return g.where("n_spellings > 1 and n_advisories > 1")


@query("""WITH k AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(hash), '^.*/', ''), '[^0-9a-z]+', '', 'g') AS k FROM fixes), c AS (SELECT DISTINCT hash, repo_url FROM commits),
  x AS (SELECT DISTINCT c.hash FROM c JOIN k ON length(k) >= 12 AND substr(k, 1, 12) = substr(c.hash, 1, 12) AND starts_with(c.hash, k)) SELECT repo_url, count(*) FILTER (x.hash IS NOT NULL) AS verified, count(*) FILTER (x.hash IS NULL) AS unattempted FROM c LEFT JOIN x USING (hash) GROUP BY 1""", False)
def environment_summary(spark: SparkSession, d: str) -> DataFrame:
    """Commits per repository that a fix has verified, and the rest. Fixes are read in any spelling and length of their
    hash."""
    c = table(spark, d, "commits").select("hash", "repo_url").distinct()
    fixed = orphans.resolved(table(spark, d, "fixes").select(orphans.hash_key(F.col("hash")).alias("key")), c.select(F.col("hash").alias("key")))
    x = fixed.select(F.col("whole").alias("hash")).distinct().withColumn("v", F.lit(True))
    return c.join(x, "hash", "left").groupBy("repo_url").agg(F.count("v").alias("verified"), F.count_if(F.col("v").isNull()).alias("unattempted"))


@query(r"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), 'https?://([a-z0-9.-]+)', 1)) AS host FROM documents WHERE text IS NOT NULL) SELECT host, count(DISTINCT doc_id) AS n FROM h GROUP BY 1""", False)
def hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that texts refer to."""
    h = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"https?://([a-z0-9.-]+)"), F.lit(1))).alias("host"))
    return h.groupBy("host").agg(F.countDistinct("doc_id").alias("n"))


@query("SELECT DISTINCT ecosystem, package FROM advisories WHERE (ecosystem, package) IN (VALUES ('npm', 'unassigned'), ('PyPI', 'unassigned'), ('Maven', 'nobody'))", False)
def sentinels(spark: SparkSession, d: str) -> DataFrame:
    """Packages on a fixed list."""
    known = spark.createDataFrame([("npm", "unassigned"), ("PyPI", "unassigned"), ("Maven", "nobody")], "ecosystem string, package string")
    return table(spark, d, "advisories").select("ecosystem", "package").distinct().join(F.broadcast(known), ["ecosystem", "package"], "left_semi")  # three rows


@query(r""" SELECT DISTINCT function, regexp_replace(function, '^(load|fetch|read|open)[_-]', '') AS bare, CASE WHEN regexp_matches(function, '^(load|fetch|read|open)[_-]') THEN 'input' WHEN regexp_matches(function, '^(emit|store|render)[_-]') THEN 'output' ELSE 'other' END AS bucket FROM f""")
def symbol_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Symbols without their prefix, with their bucket."""
    fn = F.col("function")
    bucket = F.when(fn.rlike("^(load|fetch|read|open)[_-]"), "input").when(fn.rlike("^(emit|store|render)[_-]"), "output").otherwise("other")
    return findings(spark, d).select("function", F.regexp_replace(fn, "^(load|fetch|read|open)[_-]", "").alias("bare"), bucket.alias("bucket")).distinct()


@query(f""" SELECT row_id, list_filter([CASE WHEN score >= 9 AND status IN {_Q(NO)} THEN 'severe but rejected' END, CASE WHEN score < 2 AND cwe IN ('CWE-78', 'CWE-89') THEN 'injection scored low' END, CASE WHEN score IS NULL AND status IN {_Q(YES)} THEN 'confirmed without score' END], lambda x: x IS NOT NULL) AS lints FROM f""")
def score_lints(spark: SparkSession, d: str) -> DataFrame:
    """Contradictions between score and evidence."""
    s, v = F.col("score"), verdict(F.col("status"))
    lints = F.array_compact(F.array(F.when((s >= 9) & ~v, "severe but rejected"), F.when((s < 2) & F.col("cwe").isin("CWE-78", "CWE-89"), "injection scored low"), F.when(s.isNull() & v, "confirmed without score")))
    return findings(spark, d).select("row_id", lints.alias("lints"))


@query(""" SELECT row_id, list_sort(list_distinct(list_append(refs, run_id))) AS refs FROM f""")
def stamped_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Provenance with the present run added once."""
    return findings(spark, d).select("row_id", F.array_sort(F.array_distinct(F.array_append("refs", F.col("run_id")))).alias("refs"))


@query(""" SELECT path, function, list_sort(list_distinct(list_append(list(tool), 'reviewed'))) AS checked_by FROM f GROUP BY 1, 2""")
def checked_by(spark: SparkSession, d: str) -> DataFrame:
    """Labels of what has looked at each function, one added once."""
    return findings(spark, d).groupBy("path", "function").agg(F.array_sort(F.array_union(F.collect_set("tool"), F.array(F.lit("reviewed")))).alias("checked_by"))


@query(r"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d+\. (\w+ -> \w+)', 1)) AS e FROM documents WHERE source = 'finding_reasoning' AND text IS NOT NULL) SELECT split_part(e, ' -> ', 1) AS caller, split_part(e, ' -> ', 2) AS callee, count(DISTINCT doc_id) AS n FROM e GROUP BY 1, 2""", False)
def trace_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct call edges of the traces in reasonings."""
    docs = table(spark, d, "documents").where("source = 'finding_reasoning' and text is not null")
    e = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\d+\. (\w+ -> \w+)"), F.lit(1))).alias("e"))
    return e.groupBy(F.split_part("e", F.lit(" -> "), F.lit(1)).alias("caller"), F.split_part("e", F.lit(" -> "), F.lit(2)).alias("callee")).agg(F.countDistinct("doc_id").alias("n"))


@query("SELECT feed, file_name, count(*) AS n_lines, count(*) FILTER (json_valid(body) AND starts_with(ltrim(body), '{')) AS n_whole FROM raw_record GROUP BY 1, 2", False)
def whole_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each file and how many of them are whole records."""
    v = F.schema_of_variant(F.try_parse_json("body"))
    return table(spark, d, "raw_record").groupBy("feed", "file_name").agg(F.count("*").alias("n_lines"), F.count_if(v.startswith("OBJECT")).alias("n_whole"))


@query(None)
def affected_versions(spark: SparkSession, d: str) -> DataFrame:
    """Advisories whose ranges hold the versions that other advisories list for the same package: the version-range join
    on sortable keys."""
    rows = nested.advisory_triples(table(spark, d, "advisories"))
    names = rows.where("ancestor = 'affected[]' and leaf in ('package.name', 'package.ecosystem')").groupBy("record", "item_path").pivot("leaf", ["package.name", "package.ecosystem"]).agg(F.max("value"))
    names = names.select("record", "item_path", F.col("`package.name`").alias("name"), F.col("`package.ecosystem`").alias("ecosystem")).where("name is not null")
    ev = rows.where(F.col("ancestor") == nested.EVENTS).select("record", "parent_path", F.regexp_extract("parent_path", r"^(affected\[\d+\])", 1).alias("item_path"), "ordinal", F.col("leaf").alias("kind"), "value").distinct()
    keyed = ev.join(names, ["record", "item_path"]).withColumn("key", versions.version_key("ecosystem", "value"))
    rank = F.when(F.col("kind") == "introduced", 0).otherwise(1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", rank.alias("r"), "kind", "key"))), lambda e: F.struct(e["kind"].alias("kind"), e["key"].alias("key")))
    folded = keyed.groupBy("record", "ecosystem", "name", "parent_path").agg(versions.intervals(ordered).alias("spans"))
    adv = folded.select(F.col("record").alias("osv_id"), "ecosystem", text.package_name(F.col("ecosystem"), F.col("name")).alias("name"), F.lit(None).cast("array<string>").alias("versions"), "spans")
    listed = rows.where("ancestor = 'affected[].versions[]'").select("record", F.col("parent_path").alias("item_path"), F.col("value").alias("version")).distinct().join(names, ["record", "item_path"])
    deps = listed.select("ecosystem", text.package_name(F.col("ecosystem"), F.col("name")).alias("name"), "version").distinct().withColumn("dep_id", F.concat_ws("|", "ecosystem", "name", "version"))
    return versions.affected(deps, adv)


@query(None)
def run_sarif(spark: SparkSession, d: str) -> DataFrame:
    """A SARIF document for each run."""
    rows = findings(spark, d).select("run_id", F.col("kind").alias("rule"), F.lit("warning").alias("level"), F.concat_ws(" in ", "kind", "function").alias("message"), F.col("path").alias("uri"), "line")
    return sinks.sarif(rows, "run_id", "findlake")


@query(None)
def package_bom(spark: SparkSession, d: str) -> DataFrame:
    """A bill of materials per ecosystem."""
    rows = table(spark, d, "advisories").select("ecosystem", F.col("package").alias("name"), F.lit(None).cast("string").alias("version"), text.purl(F.col("ecosystem"), F.col("package"), F.lit(None).cast("string")).alias("purl"))
    return sinks.cyclonedx(rows, "ecosystem")


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(?m)^--- a/(\S+)$', 1) AS files FROM documents WHERE text IS NOT NULL) SELECT doc_id, list_sort(list_distinct(files)) AS files FROM t WHERE len(files) > 0""", False)
def patched_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that the patches in texts change."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit(r"(?m)^--- a/(\S+)$"), F.lit(1)).alias("files"))
    return docs.where(F.size("files") > 0).select("doc_id", F.array_sort(F.array_distinct("files")).alias("files"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value >= 5) AS n_completed, round(sum(value), 4) AS cost FROM events GROUP BY 1", False)
def streamed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Running totals per class kept by a stream over the events (one available-now pass), equal to the batch's."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    name = f"totals_{uuid.uuid4().hex}"
    q = streams.running_totals(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).withColumn("cost", F.round("cost", 4))


@query(""", m AS (SELECT kind, cwe, count(*) AS n FROM f WHERE cwe IS NOT NULL GROUP BY 1, 2), e AS (SELECT kind, list(cwe) AS xs, sum(n)::bigint AS n FROM m GROUP BY 1) SELECT kind, len(xs) AS n_labels, n, round((SELECT max(m.n) FROM m WHERE m.kind = e.kind) / n, 6) AS top_share FROM e""")
def label_recall(spark: SparkSession, d: str) -> DataFrame:
    """Labels per kind and the share that the most frequent one has."""
    m = findings(spark, d).where("cwe is not null").groupBy("kind", "cwe").agg(F.count("*").alias("n"))
    return m.groupBy("kind").agg(F.count("*").alias("n_labels"), F.sum("n").alias("n"), agg.ratio(F.max("n"), F.sum("n")).alias("top_share"))


@query(""" SELECT tool, arg_min(run_id, {'a': recorded_at, 'b': row_id}) AS first_run, arg_max(run_id, {'a': recorded_at, 'b': row_id}) AS last_run, count(DISTINCT run_id) AS n_runs FROM f WHERE recorded_at IS NOT NULL GROUP BY 1""")
def run_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Oldest and newest run of each tool."""
    rows = findings(spark, d).where("recorded_at is not null")
    at = F.struct("recorded_at", "row_id")
    return rows.groupBy("tool").agg(F.min_by("run_id", at).alias("first_run"), F.max_by("run_id", at).alias("last_run"), F.countDistinct("run_id").alias("n_runs"))
