"""Queries over commits, fixes, advisories and events: graphs, coverage intervals, windows and choices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.functions.findings import SQL as F_SQL
from findlake.functions.findings import cwe_name
from findlake.operators import dedup, graph, intervals, orphans, packed
from findlake.plans.findings import findings
from findlake.plans.measures import NO, YES, verdict
from findlake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_Q = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def query(sql: str | None = None, with_findings: bool = False):  # noqa: ANN201
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (F_SQL if with_findings else "") + sql
        return f

    return add


def known_commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").select(F.lower("hash").alias("key"))


def parent_edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: commit and parent. A shortened parent is the commit, or the whole hash given elsewhere, that it begins;
    one that begins none stays as it is."""
    values = packed.unpack(table(spark, d, "commits"), "hash", "parents")
    key = F.regexp_extract(F.lower("value"), rf"(?:^|:)([0-9a-f]{{{orphans.WIDTH},40}})$", 1)
    named = values.select(F.col("hash").alias("src"), key.alias("key")).where("key <> ''").distinct()
    whole, short = named.where("length(key) = 40"), named.where("length(key) < 40")
    found = orphans.resolved(short.select("key"), known_commits(spark, d).unionByName(whole.select("key")))
    dst = F.coalesce("whole", "key").alias("dst")
    return whole.select("src", F.col("key").alias("dst")).unionByName(short.join(found, "key", "left").select("src", dst)).distinct()


#: Hex runs of 12 to 40 digits among the parents, each resolved to the known hashes it begins.
_E = r"""e0 AS (SELECT DISTINCT hash AS src, unnest(regexp_extract_all(lower(parents), '(?:^|[^0-9a-z])([0-9a-f]{12,40})(?:$|[^0-9a-z])', 1)) AS k FROM (SELECT hash, regexp_replace(parents, '([^0-9A-Za-z])', '\1\1', 'g') AS parents FROM commits)),
  kn AS (SELECT lower(hash) AS w FROM commits UNION SELECT k FROM e0 WHERE length(k) = 40),
  e AS (SELECT src, k AS dst FROM e0 WHERE length(k) = 40 UNION SELECT src, coalesce(w, k) FROM e0 LEFT JOIN kn ON substr(k, 1, 12) = substr(w, 1, 12) AND starts_with(w, k) WHERE length(k) < 40)"""
_FIX_KEY = "regexp_replace(regexp_replace(lower(hash), '^.*/', ''), '[^0-9a-z]+', '', 'g')"


@query(f"WITH {_E} SELECT src, dst FROM e")
def commit_edges(spark: SparkSession, d: str) -> DataFrame:
    """Call-edge flattening: one edge per commit and parent."""
    return parent_edges(spark, d)


@query(f"WITH RECURSIVE {_E}, r AS (SELECT hash AS node FROM commits WHERE deleted_at IS NOT NULL UNION SELECT dst FROM e JOIN r ON e.src = r.node) SELECT node FROM r")
def ancestors_of_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Everything that deleted commits lead back to, themselves included."""
    seeds = table(spark, d, "commits").where("deleted_at is not null").select(F.col("hash").alias("node"))
    return graph.reachable(parent_edges(spark, d), seeds).select("node")


@query(f"WITH RECURSIVE {_E}, r AS (SELECT hash AS node FROM commits WHERE deleted_at IS NOT NULL UNION SELECT dst FROM e JOIN r ON e.src = r.node) SELECT repo_url, count(DISTINCT hash) AS n FROM commits LEFT JOIN r ON hash = node WHERE node IS NULL GROUP BY 1")
def unreached_commits(spark: SparkSession, d: str) -> DataFrame:
    """Commits per repository that no deleted commit leads back to."""
    reached = ancestors_of_deleted(spark, d).withColumnRenamed("node", "hash")
    return table(spark, d, "commits").select("repo_url", "hash").distinct().join(reached, "hash", "left_anti").groupBy("repo_url").agg(F.countDistinct("hash").alias("n"))


@query(f"""WITH RECURSIVE {_E}, t AS (SELECT DISTINCT hash AS node FROM commits WHERE deleted_at IS NOT NULL), fk AS (SELECT DISTINCT {_FIX_KEY} AS k FROM fixes WHERE withdrawn_at IS NOT NULL),
  f AS (SELECT DISTINCT coalesce(w, k) AS node FROM fk LEFT JOIN (SELECT w FROM kn UNION SELECT dst FROM e) q ON length(k) >= 12 AND substr(k, 1, 12) = substr(w, 1, 12) AND starts_with(w, k) WHERE k <> ''),
  ct AS (SELECT src AS node FROM e JOIN t ON e.dst = t.node UNION SELECT src FROM e JOIN ct ON e.dst = ct.node), cf AS (SELECT node FROM f UNION SELECT src FROM e JOIN cf ON e.dst = cf.node)
SELECT node FROM ct WHERE node NOT IN (SELECT node FROM cf) AND node NOT IN (SELECT node FROM t)""")
def bypassing_commits(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of deleted commits that do not descend from a withdrawn fix."""
    target = table(spark, d, "commits").where("deleted_at is not null").select(F.col("hash").alias("node")).distinct()
    edges = parent_edges(spark, d)
    fixes = table(spark, d, "fixes").where("withdrawn_at is not null").select(orphans.hash_key(F.col("hash")).alias("key")).where("key is not null").distinct()
    found = orphans.resolved(fixes, known_commits(spark, d).unionByName(edges.select(F.col("dst").alias("key"))))
    enforcer = fixes.join(found, "key", "left").select(F.coalesce("whole", "key").alias("node")).distinct()
    return graph.bypasses(edges, target, enforcer)


@query(None)
def commit_levels(spark: SparkSession, d: str) -> DataFrame:
    """Height of each commit above its roots (bottom-up order)."""
    return graph.levels(parent_edges(spark, d))


@query(None)
def commit_components(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected components of the commit graph."""
    return graph.components(parent_edges(spark, d))


@query(f"WITH {_E}, i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1) SELECT node, coalesce(i.n, 0) AS n_callers, coalesce(o.n, 0) AS n_callees FROM i FULL JOIN o USING (node)")
def caller_context(spark: SparkSession, d: str) -> DataFrame:
    """Direct callers and callees of each node, counted in one pass."""
    e = parent_edges(spark, d)
    ends = e.select(F.col("dst").alias("node"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(e.select(F.col("src").alias("node"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return ends.groupBy("node").agg(F.sum("a").alias("n_callers"), F.sum("b").alias("n_callees"))


@query(f"WITH {_E}, c AS (SELECT dst, count(*) AS n FROM e GROUP BY 1) SELECT src AS node, sum(n - 1)::bigint AS n_siblings FROM e JOIN c USING (dst) GROUP BY 1")
def sibling_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many other callers the callees of each node have; counted, not paired."""
    e = parent_edges(spark, d)
    return e.join(e.groupBy("dst").agg(F.count("*").alias("n")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("n") - 1).alias("n_siblings"))


@query(f"WITH {_E} SELECT src, dst FROM e WHERE dst IN (SELECT hash FROM commits) AND dst NOT IN (SELECT hash FROM commits WHERE deleted_at IS NOT NULL)")
def open_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges to known commits that no deletion has touched."""
    commits = table(spark, d, "commits")
    e = parent_edges(spark, d).join(commits.select(F.col("hash").alias("dst")).distinct(), "dst", "left_semi")
    return e.join(commits.where("deleted_at is not null").select(F.col("hash").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


@query(None)
def patch_dominators(spark: SparkSession, d: str) -> DataFrame:
    """Immediate dominators of the lines of each patch: lines follow each other, an if may skip the next one."""
    return graph.dominators(_flow(spark, d), "doc_id")


@query(None)
def patch_reaching(spark: SparkSession, d: str) -> DataFrame:
    """Definitions that reach each line of each patch."""
    lines = _lines(spark, d)
    name = F.regexp_extract("line", r"^[+\- ]\s*([a-z]+) = ", 1)
    defs = lines.select("doc_id", "node", name.alias("var")).where("var <> ''")
    return graph.reaching_definitions(_flow(spark, d), defs, "doc_id")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source = 'patch_excerpt' and text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("node", "line"))


def _flow(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source = 'patch_excerpt' and text is not null").select("doc_id", F.split("text", "\n").alias("ls"))
    arcs = F.flatten(
        F.transform(
            "ls",
            lambda line, k: F.filter(
                F.array(F.struct(k.alias("src"), (k + 1).alias("dst"), F.lit(True).alias("ok")), F.struct(k.alias("src"), (k + 2).alias("dst"), line.rlike(r"^[+\- ]\s*if \(").alias("ok"))),
                lambda a: a["ok"] & (a["dst"] < F.size("ls")),
            ),
        )
    )
    return docs.select("doc_id", F.inline(arcs)).select("doc_id", "src", "dst")


@query(rf"""WITH x AS (SELECT DISTINCT upper(regexp_replace(cve_id, '[^0-9A-Za-z]+', '', 'g')) AS k, {_FIX_KEY} AS h FROM fixes), c AS (SELECT DISTINCT hash, repo_url FROM commits),
  w AS (SELECT DISTINCT upper(regexp_replace(cve_id, '[^0-9A-Za-z]+', '', 'g')) AS k, 'CWE-' || ltrim(regexp_extract(cwe_id, '(\d+)', 1), '0') AS cwe_id FROM cwe_classification)
SELECT DISTINCT x.k AS cve, c.hash, w.cwe_id, r.repo_language FROM x JOIN c ON length(h) >= 12 AND substr(h, 1, 12) = substr(c.hash, 1, 12) AND starts_with(c.hash, h) JOIN w USING (k) JOIN repository r ON c.repo_url = r.repo_url
WHERE r.repo_language IN ('C', 'Java', 'Python') AND w.cwe_id IN ('CWE-78', 'CWE-79', 'CWE-89') AND k <> ''""")
def fix_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Fixes with their commit, weakness and language: keys are made distinct before the joins, so a CVE with many
    repeated rows doesn't multiply. Shortened hashes are the commits they begin, weaknesses are read in any spelling."""
    x = table(spark, d, "fixes").select(orphans.cve_key(F.col("cve_id")).alias("cve"), orphans.hash_key(F.col("hash")).alias("hash")).distinct()
    c = table(spark, d, "commits").select("hash", "repo_url").distinct()
    named = table(spark, d, "cwe_classification").select(orphans.cve_key(F.col("cve_id")).alias("cve"), cwe_name(F.col("cwe_id")).alias("cwe_id"))
    w = named.where(F.col("cwe_id").isin("CWE-78", "CWE-79", "CWE-89")).distinct()
    r = table(spark, d, "repository").where(F.col("repo_language").isin("C", "Java", "Python"))
    found = orphans.resolved(x.select(F.col("hash").alias("key")), c.select(F.col("hash").alias("key")))
    x = x.join(found, x.hash == found.key).select("cve", F.col("whole").alias("hash"))
    return x.join(w, "cve").join(c, "hash").join(r, "repo_url").select("cve", "hash", "cwe_id", "repo_language").distinct()


@query(r"""WITH s AS (SELECT DISTINCT regexp_extract(lower(repo_url), 'https?://[^/]+/(.+)$', 1) AS slug, substr(k, 1, 7) AS short, k FROM (SELECT repo_url, regexp_replace(regexp_replace(lower(hash), '^.*/', ''), '[^0-9a-z]+', '', 'g') AS k FROM fixes) WHERE k <> '')
SELECT slug, short, count(*) AS n_votes, arg_max(k, {'a': length(k), 'b': k}) AS hash FROM s GROUP BY 1, 2""")
def fix_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Votes for a repository and short hash, with the longest hash among them."""
    slug = F.regexp_extract(F.lower("repo_url"), "https?://[^/]+/(.+)$", 1)
    s = table(spark, d, "fixes").select(slug.alias("slug"), orphans.hash_key(F.col("hash")).alias("k")).where("k is not null").distinct()
    best = F.max_by("k", F.struct(F.length("k"), F.col("k")))
    return s.groupBy("slug", F.substring("k", 1, 7).alias("short")).agg(F.count("*").alias("n_votes"), best.alias("hash"))


@query(r"""WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'CVE-\d{4}-\d{4,}')) AS cve FROM documents WHERE text IS NOT NULL), f AS (SELECT DISTINCT upper(trim(cve_id)) AS cve FROM fixes)
SELECT doc_id, list_sort(list(cve)) AS linked FROM m JOIN f USING (cve) GROUP BY 1""")
def linked_documents(spark: SparkSession, d: str) -> DataFrame:
    """CVE ids in free text that have a fix."""
    m = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"CVE-\d{4}-\d{4,}"), F.lit(0)))).alias("cve"))
    f = table(spark, d, "fixes").select(F.upper(F.trim("cve_id")).alias("cve")).distinct()
    return m.join(f, "cve").groupBy("doc_id").agg(F.array_sort(F.collect_list("cve")).alias("linked"))


_M = ", m AS (SELECT DISTINCT path AS file, tool, line AS lo, line + 5 AS hi FROM f WHERE line IS NOT NULL), l AS (SELECT DISTINCT file, tool, unnest(range(lo, hi + 1)) AS x FROM m)"


def marks(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).where("line is not null")
    return rows.select(F.col("path").alias("file"), "tool", F.col("line").alias("lo"), (F.col("line") + 5).alias("hi"), "recorded_at", "function", "status")


@query(_M + ", g AS (SELECT *, x - row_number() OVER (PARTITION BY file, tool ORDER BY x) AS k FROM l) SELECT file, tool, min(x)::int AS lo, max(x)::int AS hi FROM g GROUP BY file, tool, k", True)
def coverage_islands(spark: SparkSession, d: str) -> DataFrame:
    """Covered intervals of each file and tool, overlapping and adjacent ones joined."""
    return intervals.coalesce(marks(spark, d), ["file", "tool"])


_OLD = "recorded_at < TIMESTAMP '2024-07-01'"


@query(f""", m AS (SELECT path AS file, line AS lo, {_OLD} AS old FROM f WHERE line IS NOT NULL AND recorded_at IS NOT NULL), l AS (SELECT DISTINCT file, old, unnest(range(lo, lo + 6)) AS x FROM m)
SELECT n.file, count(*) FILTER (o.x IS NULL) AS n_new FROM (SELECT file, x FROM l WHERE NOT old) n LEFT JOIN (SELECT file, x FROM l WHERE old) o ON n.file = o.file AND n.x = o.x GROUP BY 1""", True)
def coverage_delta(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a later period adds to the coverage of each file."""
    old = F.col("recorded_at") < F.lit("2024-07-01").cast("timestamp_ntz")
    m = marks(spark, d).where("recorded_at is not null")
    return intervals.delta(m.where(old), m.where(~old), ["file"])


@query(_M + ", t AS (SELECT path AS file, max(line) AS total FROM f WHERE line IS NOT NULL GROUP BY 1), u AS (SELECT file, count(DISTINCT x) AS n_lines FROM l GROUP BY 1) SELECT file, n_lines, round(coalesce(100.0 * n_lines / nullif(total, 0), 0), 4) AS percent FROM u LEFT JOIN t USING (file)", True)
def coverage_percent(spark: SparkSession, d: str) -> DataFrame:
    """Share of the lines of each file that any tool has covered; 0 where the total is unknown."""
    totals = findings(spark, d).where("line is not null").groupBy(F.col("path").alias("file")).agg(F.max("line").alias("total"))
    return intervals.percent(marks(spark, d), totals, ["file"])


@query(_M + " SELECT file, tool, count(*) AS n_lines FROM l GROUP BY 1, 2", True)
def coverage_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Covered lines from bitmaps instead of intervals."""
    return intervals.line_set(marks(spark, d), ["file", "tool"])


@query(_M + """, s AS (SELECT path AS file, function AS name, min(line) AS lo, max(line) AS hi FROM f WHERE line IS NOT NULL GROUP BY 1, 2)
SELECT s.file, s.name, s.hi - s.lo + 1 AS span_lines, l.tool, count(*) AS n_lines FROM s JOIN l ON s.file = l.file AND l.x BETWEEN s.lo AND s.hi GROUP BY ALL""", True)
def who_checked(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each function that each tool has covered."""
    m = marks(spark, d)
    spans = m.groupBy("file", F.col("function").alias("name")).agg(F.min("lo").alias("lo"), F.max("lo").alias("hi"))
    return intervals.meets(m, spans, "file", ["tool"])


_FV = f""", v AS (SELECT path AS file, function AS name, count(DISTINCT tool) AS tools, count(*) FILTER (status IN {_Q(YES)}) AS n_yes, count(*) FILTER (status IN {_Q(NO)}) AS n_no, max({{'a': recorded_at, 'b': row_id, 's': status}}).s AS last FROM f WHERE recorded_at IS NOT NULL GROUP BY 1, 2)
SELECT file, name, CASE WHEN n_yes + n_no = 0 THEN 'unexamined' WHEN n_yes > 0 AND coalesce(last NOT IN {_Q(YES)}, true) THEN 'found_then_lost' WHEN n_yes > 0 THEN 'open' ELSE 'clean' END AS verdict FROM v"""


@query(_FV, True)
def function_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """unexamined, open, found_then_lost or clean for each function."""
    v = verdict(F.col("status"))
    rows = findings(spark, d).where("recorded_at is not null").groupBy(F.col("path").alias("file"), F.col("function").alias("name"))
    s = rows.agg(F.count_if(v).alias("y"), F.count_if(~v).alias("n"), F.max(F.struct("recorded_at", "row_id", "status")).alias("m"))
    lost = F.coalesce(~F.col("m.status").isin(*YES), F.lit(True))
    return s.select("file", "name", F.when(F.col("y") + F.col("n") == 0, "unexamined").when((F.col("y") > 0) & lost, "found_then_lost").when(F.col("y") > 0, "open").otherwise("clean").alias("verdict"))


@query(_FV.replace("SELECT file, name, CASE", "SELECT file, name FROM (SELECT file, name, CASE") + ") WHERE verdict IN ('unexamined', 'found_then_lost')", True)
def review_gap(spark: SparkSession, d: str) -> DataFrame:
    """Functions to look at (again)."""
    return function_verdicts(spark, d).where(F.col("verdict").isin("unexamined", "found_then_lost")).select("file", "name")


@query(f""", v AS (SELECT finding_id, model, row_id, status IN {_Q(YES)} AS y, lag(status IN {_Q(YES)}) OVER (PARTITION BY finding_id, model ORDER BY recorded_at, row_id) AS p FROM f WHERE finding_id IS NOT NULL AND model IS NOT NULL AND recorded_at IS NOT NULL AND status IS NOT NULL)
SELECT model, count(*) FILTER (y = p) AS n_stable, count(*) FILTER (y <> p) AS n_flipped FROM v WHERE p IS NOT NULL GROUP BY 1""", True)
def verdict_stability(spark: SparkSession, d: str) -> DataFrame:
    """How often a model's verdict on a finding differs from its one before."""
    order = Window.partitionBy("finding_id", "model").orderBy("recorded_at", "row_id")
    y = F.col("status").isin(*YES)
    rows = findings(spark, d).where("finding_id is not null and model is not null and recorded_at is not null and status is not null").select("model", y.alias("y"), F.lag(y).over(order).alias("p"))
    return rows.where("p is not null").groupBy("model").agg(F.count_if(F.col("y") == F.col("p")).alias("n_stable"), F.count_if(F.col("y") != F.col("p")).alias("n_flipped"))


@query("""WITH w AS (SELECT event_id, user_id, ts, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_new FROM events),
  q AS (SELECT *, epoch(ts) - epoch(last_new) >= 100000 AS late, lag(epoch(ts) - epoch(last_new) >= 100000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM w) SELECT event_id, user_id FROM q WHERE coalesce(late, false) AND NOT coalesce(was, false)""")
def plateaus(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user past 100,000 seconds without anything new."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    since = F.col("t") - F.last(F.when(F.col("event_type") == "signup", F.col("t")), True).over(order)
    late = events.select("event_id", "user_id", "ts", (since >= 100_000).alias("late"))
    return late.withColumn("was", F.lag("late").over(order)).where(F.coalesce("late", F.lit(False)) & ~F.coalesce("was", F.lit(False))).select("event_id", "user_id")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE source = 'patch_excerpt' AND text IS NOT NULL),
  h AS (SELECT doc_id, line, last_value(CASE WHEN starts_with(line, '+++ ') THEN substr(line, 7) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS file FROM l)
SELECT doc_id, file, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS n_added, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS n_removed FROM h WHERE file IS NOT NULL GROUP BY 1, 2""")
def patch_files(spark: SparkSession, d: str) -> DataFrame:
    """Changed lines per file of each patch: the file of the last header is carried down."""
    down = Window.partitionBy("doc_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.startswith("line", F.lit("+++ ")), F.substring("line", 7, 100_000))
    rows = _lines(spark, d).withColumn("file", F.last(header, True).over(down)).where("file is not null")
    sign = lambda s: F.count_if(F.startswith("line", F.lit(s)) & ~F.startswith("line", F.lit(s * 3)))
    return rows.groupBy("doc_id", "file").agg(sign("+").alias("n_added"), sign("-").alias("n_removed"))


@query(""" SELECT row_id, row_number() OVER (PARTITION BY repo_url ORDER BY CASE kind WHEN 'use_after_free' THEN 0 WHEN 'buffer_overflow' THEN 1 WHEN 'integer_overflow' THEN 2 WHEN 'null_dereference' THEN 3 ELSE 99 END, row_id) AS place FROM f""", True)
def ranked_crashes(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each repository in order of their class, unknown classes last."""
    rank = dedup.lookup(F.col("kind"), {"use_after_free": 0, "buffer_overflow": 1, "integer_overflow": 2, "null_dereference": 3}, 99)
    rows = findings(spark, d).select("repo_url", "row_id", rank.alias("rank"))
    return dedup.numbered(rows, ["repo_url"], [F.col("rank"), F.floor(F.col("row_id") / 100_000)], [F.col("row_id")], "place").select("row_id", "place")


@query("""WITH s AS (SELECT doc_id, source, n_chars // 4 AS tokens, (doc_id % 4)::int AS priority FROM documents), t AS (SELECT *, sum(tokens) OVER (PARTITION BY source) - 20000 AS overshoot,
  coalesce(sum(CASE WHEN priority > 0 THEN tokens ELSE 0 END) OVER (PARTITION BY source ORDER BY priority DESC, tokens DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shed FROM s)
SELECT source, count(*) FILTER (NOT (priority > 0 AND shed < overshoot)) AS n_kept, coalesce(sum(tokens) FILTER (NOT (priority > 0 AND shed < overshoot)), 0)::bigint AS tokens_kept FROM t GROUP BY 1""")
def budgeted(spark: SparkSession, d: str) -> DataFrame:
    """Sections kept within 20,000 tokens per source: shed by lowest importance, then size, until it fits; priority 0 stays.

    Sections of one importance and size are interchangeable, so the running sum is over their counts, not over rows."""
    size = F.floor(F.col("n_chars") / 4).alias("t")
    s = table(spark, d, "documents").select("source", size, (F.col("doc_id") % 4).cast("int").alias("priority"))
    g = s.groupBy("source", "priority", "t").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("priority"), F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.when(F.col("priority") > 0, F.col("t") * F.col("n")).otherwise(0)
    over = F.sum(F.col("t") * F.col("n")).over(Window.partitionBy("source")) - 20_000
    w = g.withColumns({"before": F.coalesce(F.sum(weight).over(order), F.lit(0)), "over": over})
    need = F.greatest(F.col("over") - F.col("before"), F.lit(0))
    gone = F.when(F.col("priority") == 0, 0).when(need == 0, 0).when(F.col("t") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.ceil(F.try_divide(need, F.col("t")))))
    left = F.col("n") - gone
    return w.groupBy("source").agg(F.sum(left).alias("n_kept"), F.sum(left * F.col("t")).alias("tokens_kept"))


@query("""WITH c(model, cost, capacity) AS (VALUES ('small', 1.0, 200), ('middle', 3.0, 2000), ('large', 9.0, 100000)) SELECT doc_id, arg_min(model, cost) AS model FROM documents JOIN c ON n_chars // 4 <= capacity * 0.9 GROUP BY 1""")
def cheapest_model(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest candidate whose capacity (less a tenth) holds each document; documents that fit none are left out."""
    c = spark.createDataFrame([("small", 1.0, 200), ("middle", 3.0, 2000), ("large", 9.0, 100_000)], "model string, cost double, capacity int")
    fits = table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("t")).join(F.broadcast(c), F.col("t") <= F.col("capacity") * 0.9)  # three rows
    return fits.groupBy("doc_id").agg(F.min_by("model", "cost").alias("model"))


@query(r"""WITH t AS (SELECT osv_id, unnest(regexp_extract_all(json, '"(\d+\.\d+\.\d+)"', 1)) AS v FROM advisories) SELECT osv_id, arg_max(v, list_transform(string_split(v, '.'), lambda x: x::int)) AS highest FROM t GROUP BY 1""")
def highest_versions(spark: SparkSession, d: str) -> DataFrame:
    """The highest stable version that each advisory names."""
    v = F.explode(F.regexp_extract_all("json", F.lit(r'"(\d+\.\d+\.\d+)"'), F.lit(1)))
    t = table(spark, d, "advisories").select("osv_id", v.alias("v"))
    return t.groupBy("osv_id").agg(F.max_by("v", F.transform(F.split("v", r"\."), lambda x: x.try_cast("int"))).alias("highest"))


@query(r"""WITH t AS (SELECT osv_id, ecosystem, package, row_number() OVER (PARTITION BY ecosystem ORDER BY fetched_at DESC NULLS LAST, osv_id DESC, package) AS k FROM advisories) SELECT ecosystem, arg_min(osv_id, k) AS osv_id, min(k) AS steps FROM t WHERE k <= 20 AND package LIKE '%-%' GROUP BY 1""")
def newest_match(spark: SparkSession, d: str) -> DataFrame:
    """The first hit of a bounded search through the 20 newest advisories of each ecosystem."""
    order = Window.partitionBy("ecosystem").orderBy(F.desc_nulls_last("fetched_at"), F.desc("osv_id"), "package")
    t = table(spark, d, "advisories").select("osv_id", "ecosystem", "package", F.row_number().over(order).alias("k")).where("k <= 20 and package like '%-%'")
    return t.groupBy("ecosystem").agg(F.min_by("osv_id", "k").alias("osv_id"), F.min("k").alias("steps"))


@query("""WITH t AS (SELECT doc_id, text FROM documents WHERE source = 'scan_log' AND text IS NOT NULL), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
SELECT regexp_extract(line, 'level=([a-z]+)', 1) AS level, count(*) AS n, round(avg(try_cast(regexp_extract(line, 'took=([0-9]{1,9})ms', 1) AS double)), 4) AS mean_ms FROM l GROUP BY 1""")
def log_levels(spark: SparkSession, d: str) -> DataFrame:
    """Lines and mean duration per level of the scan logs."""
    lines = table(spark, d, "documents").where("source = 'scan_log' and text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
    ms = F.regexp_extract("line", "took=([0-9]{1,9})ms", 1).try_cast("double")
    return lines.groupBy(F.regexp_extract("line", "level=([a-z]+)", 1).alias("level")).agg(F.count("*").alias("n"), F.round(F.avg(ms), 4).alias("mean_ms"))
