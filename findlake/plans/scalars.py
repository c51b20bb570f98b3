"""Queries that apply the scalar functions, predicates and rule ladders to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions import scores, text
from findlake.functions.findings import SQL as F_SQL
from findlake.plans.findings import findings
from findlake.plans.measures import NO, YES, verdict
from findlake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_findings: bool = False):  # noqa: ANN201
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (F_SQL if with_findings else "") + sql
        return f

    return add


@query(r"SELECT DISTINCT ecosystem, package, CASE WHEN lower(ecosystem) = 'pypi' THEN lower(regexp_replace(package, '[-_.]+', '-', 'g')) WHEN lower(ecosystem) IN ('npm', 'crates.io', 'cargo') THEN lower(package) ELSE package END AS name FROM advisories")
def package_names(spark: SparkSession, d: str) -> DataFrame:
    """Canonical package names by ecosystem."""
    return table(spark, d, "advisories").select("ecosystem", "package").distinct().withColumn("name", text.package_name(F.col("ecosystem"), F.col("package")))


@query(r"SELECT finding_row, CASE WHEN regexp_extract(cwe_id, '(\d+)', 1) <> '' THEN 'CWE-' || ltrim(regexp_extract(cwe_id, '(\d+)', 1), '0') END AS cwe FROM finding")
def cwe_names(spark: SparkSession, d: str) -> DataFrame:
    """Canonical weakness ids."""
    return findings(spark, d).select(F.col("row_id").alias("finding_row"), "cwe")


@query("SELECT doc_id, greatest(1, length(text) // 4)::int AS n_tokens FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Rough token counts."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.token_estimate(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""WITH h AS (SELECT source, sha256(text) AS h FROM documents WHERE text IS NOT NULL), b AS (SELECT source, substr(h, 1, 4) AS p, sha256(array_to_string(list_sort(list(h)), '')) AS h FROM h GROUP BY 1, 2)
SELECT source, sha256(array_to_string(list(h ORDER BY p), '')) AS digest FROM b GROUP BY 1""")
def tree_hashes(spark: SparkSession, d: str) -> DataFrame:
    """One hash per source as a tree: text hashes are hashed per prefix of four digits, and these (at most 65,536 per
    source) per source, so no task gathers all hashes of a source."""
    rows = table(spark, d, "documents").where("text is not null").select("source", F.sha2("text", 256).alias("h"))
    leaves = rows.groupBy("source", F.substring("h", 1, 4).alias("p")).agg(text.tree_hash(F.collect_list("h")).alias("h"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])
    return leaves.groupBy("source").agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest"))


@query("SELECT doc_id, substr(sha256(array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10))), 1, 12) AS digest, array_to_string(list_slice(string_split(text, chr(10)), 2, 2), chr(10)) AS second_line FROM documents WHERE text IS NOT NULL")
def span_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the first three lines, and the second line."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.span_hash(t, 1, 3).alias("digest"), text.slice_lines(t, 2, 2).alias("second_line"))


@query("""WITH s AS (SELECT hash, ingested_at, commit_row, substr(sha256(coalesce(parents, '')), 1, 12) AS h FROM commits), w AS (SELECT hash, commit_row, h, lag(h) OVER (PARTITION BY hash ORDER BY ingested_at, commit_row) AS p FROM s)
SELECT commit_row, CASE WHEN p IS NULL THEN 'new' WHEN p = h THEN 'fresh' ELSE 'stale' END AS state FROM w""")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    """Whether a commit's parents still have the hash of its row before."""
    from pyspark.sql import Window

    order = Window.partitionBy("hash").orderBy("ingested_at", "commit_row")
    h = F.substring(F.sha2(F.coalesce("parents", F.lit("")), 256), 1, 12)
    rows = table(spark, d, "commits").select("hash", "ingested_at", "commit_row", h.alias("h")).withColumn("p", F.lag("h").over(order))
    return rows.select("commit_row", F.when(F.col("p").isNull(), "new").when(F.col("p") == F.col("h"), "fresh").otherwise("stale").alias("state"))


@query("SELECT commit_row, round(list_entropy(string_split(hash, '')), 6) AS entropy FROM commits")
def hash_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Bits per byte of each commit hash."""
    return table(spark, d, "commits").select("commit_row", F.round(text.entropy("hash"), 6).alias("entropy"))


_REDACT = "text"
for _p, _r in text.SECRETS:
    _quoted = _p.replace("'", "''")
    _REDACT = f"regexp_replace({_REDACT}, '{_quoted}', '{_r.replace('$', chr(92))}', 'g')"


@query(f"SELECT doc_id, sha256({_REDACT}) AS digest, {_REDACT} <> text AS changed FROM documents WHERE text IS NOT NULL")
def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Texts without secrets (as a digest), and whether there were any."""
    clean = text.redact(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(clean, 256).alias("digest"), (clean != F.col("text")).alias("changed"))


@query(r"""SELECT fix_row, CASE WHEN s <> '' THEN s END AS slug FROM (SELECT fix_row, regexp_replace(regexp_replace(regexp_extract(lower(repo_url), 'https?://[^/\s]+/([^/\s]+/[^/#?\s]+)', 1), '[)\]>,.;]+$', ''), '\.git$', '') AS s FROM fixes)""")
def repo_slugs(spark: SparkSession, d: str) -> DataFrame:
    """owner/repo of the repository of each fix."""
    return table(spark, d, "fixes").select("fix_row", text.repo_slug(F.col("repo_url")).alias("slug"))


@query(r""", e AS (SELECT DISTINCT upper(replace(kind, '_', '-')) || ' OR ' || tool || ' AND MIT' AS expression FROM f) SELECT expression, regexp_split_to_array(expression, '\s+(?:AND|OR|WITH)\s+') AS operands FROM e""", True)
def expression_operands(spark: SparkSession, d: str) -> DataFrame:
    """Operands of compound expressions."""
    e = F.concat(F.upper(F.replace("kind", F.lit("_"), F.lit("-"))), F.lit(" OR "), "tool", F.lit(" AND MIT")).alias("expression")
    return findings(spark, d).select(e).distinct().withColumn("operands", text.spdx_operands(F.col("expression")))


@query(r"""WITH r AS (SELECT DISTINCT substr(repo_url, 9) || ':' || substr(hash, 1, 7) || '@sha256:' || hash AS ref FROM commits)
SELECT ref, regexp_extract(ref, '^([^/]*[.:][^/]*|localhost)/', 1) AS registry, regexp_replace(regexp_replace(regexp_replace(ref, '@sha256:[0-9a-f]+$', ''), ':[^/:]+$', ''), '^[^/]+/', '') AS repository,
  regexp_extract(regexp_replace(ref, '@sha256:[0-9a-f]+$', ''), ':([^/:]+)$', 1) AS tag, regexp_extract(ref, '@(sha256:[0-9a-f]+)$', 1) AS digest FROM r""")
def image_references(spark: SparkSession, d: str) -> DataFrame:
    """Parts of image references."""
    ref = F.concat(F.substring("repo_url", 9, 10_000), F.lit(":"), F.substring("hash", 1, 7), F.lit("@sha256:"), "hash").alias("ref")
    return table(spark, d, "commits").select(ref).distinct().withColumn("i", text.image_ref(F.col("ref"))).select("ref", "i.*")


@query(r"SELECT DISTINCT 'pkg:' || regexp_replace(lower(ecosystem), '[^a-z0-9.+-]', '', 'g') || '/' || package AS purl FROM advisories")
def package_urls(spark: SparkSession, d: str) -> DataFrame:
    """Package URLs."""
    return table(spark, d, "advisories").select(text.purl(F.col("ecosystem"), F.col("package"), F.lit(None).cast("string")).alias("purl")).distinct()


@query(r"""WITH w AS (SELECT DISTINCT replace(package, '-', '_') || '-1.0-py2.py3-none-any.whl' AS filename FROM advisories) SELECT filename, unnest(['py2', 'py3']) AS python, 'none' AS abi, 'any' AS platform FROM w""")
def wheel_tags(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility tags of wheel file names, one per row."""
    name = F.concat(F.replace("package", F.lit("-"), F.lit("_")), F.lit("-1.0-py2.py3-none-any.whl")).alias("filename")
    return table(spark, d, "advisories").select(name).distinct().select("filename", F.inline(text.wheel_tags(F.col("filename"))))


@query(r"""WITH v AS (SELECT doc_id, regexp_extract(text, '(\d+(?:\.\d+)*)', 1) AS v FROM documents WHERE text IS NOT NULL) SELECT doc_id, list_transform(string_split(v, '.'), lambda x: try_cast(x AS DECIMAL(38, 0))) AS version FROM v WHERE v <> ''""")
def first_versions(spark: SparkSession, d: str) -> DataFrame:
    """The first dotted number of each text as comparable integers."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.numeric_version(F.col("text")).alias("version")).where("version is not null")


@query(r""", x AS (SELECT DISTINCT function, regexp_replace(regexp_replace(translate(lower(function), '0135', 'oles'), '[-_.]+', '', 'g'), '(js|py|s)$', '') AS collapsed FROM f) SELECT collapsed, count(*) AS n FROM x GROUP BY 1""", True)
def lookalike_groups(spark: SparkSession, d: str) -> DataFrame:
    """Names that are one when look-alike characters and joins are collapsed."""
    names = findings(spark, d).select("function").distinct()
    return names.groupBy(text.collapse_lookalikes(F.col("function")).alias("collapsed")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT package FROM advisories) SELECT package, list_reduce(list_transform(list_filter(string_split(lower(package), ''), lambda c: c BETWEEN 'a' AND 'z'), lambda c: (1 << (ascii(c) - 97))::int), lambda a, b: a | b)::int AS mask FROM p""")
def char_masks(spark: SparkSession, d: str) -> DataFrame:
    """Letter masks of package names."""
    return table(spark, d, "advisories").select("package").distinct().withColumn("mask", text.char_mask(F.col("package")))


_IDIOM = "[" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in text.IDIOMS.items()) + "]"


@query(f"SELECT doc_id, list_filter({_IDIOM}, lambda x: x IS NOT NULL) AS idioms, list_filter({_IDIOM}, lambda x: x IS NOT NULL)[1] AS primary_idiom FROM documents WHERE text IS NOT NULL")
def idioms(spark: SparkSession, d: str) -> DataFrame:
    """Idioms that each text matches, and the first of them."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", text.idioms(F.col("text")).alias("idioms"))
    return docs.withColumn("primary_idiom", F.try_element_at("idioms", F.lit(1)))


@query(r" SELECT row_id, tool || '_' || regexp_replace(lower(kind), '[^a-z0-9]+', '-', 'g') || '_' || substr(sha256(concat_ws('|', tool, kind, path, line::varchar)), 1, 12) AS key FROM f", True)
def finding_keys(spark: SparkSession, d: str) -> DataFrame:
    """Stable finding ids."""
    return findings(spark, d).select("row_id", text.finding_key(F.col("tool"), F.col("kind"), F.col("path"), F.col("line").cast("string")).alias("key"))


@query(""" SELECT row_id, sha256(to_json({'kind': kind, 'line': line, 'path': path})) AS digest FROM f WHERE kind IS NOT NULL AND line IS NOT NULL AND NOT contains(path, '/../') AND NOT regexp_matches(path, '[^ -~]')""", True)
def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of canonical JSON."""
    rows = findings(spark, d).where("kind is not null and line is not null and path not like '%/../%'").where(~F.col("path").rlike("[^ -~]"))
    return rows.select("row_id", text.json_hash(path=F.col("path"), line=F.col("line"), kind=F.col("kind")).alias("digest"))


@query(None)
def row_macs(spark: SparkSession, d: str) -> DataFrame:
    """HMACs over selected fields (the secret comes from the driver's configuration; this one is for tests)."""
    secret = spark.conf.get("findlake.mac.secret", "test-only").encode()
    joined = F.concat_ws("|", "path", F.col("line").cast("string"), "kind")
    return findings(spark, d).select("row_id", text.row_mac(secret)(joined).alias("mac"))


@query(r"""SELECT finding_row, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END AS number FROM (SELECT finding_row, try_cast(regexp_extract(severity, '([0-9.]+)', 1) AS double) AS v FROM finding)""")
def coerced_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in free severity texts, 0 where there is none."""
    number = text.coerce_number(F.regexp_extract("severity", "([0-9.]+)", 1))
    return table(spark, d, "finding").select("finding_row", number.alias("number"))


_W = lambda k, t: "CASE regexp_extract(v, '/" + k + ":([A-Z])', 1) " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in t.items()) + " END"


@query(rf"""WITH x AS (SELECT DISTINCT unnest(regexp_extract_all(json, 'CVSS:3\.1/[A-Z:/]+')) AS v FROM advisories), m AS (SELECT v, {_W('AV', scores.WEIGHTS['AV'])} AS av, {_W('AC', scores.WEIGHTS['AC'])} AS ac, {_W('UI', scores.WEIGHTS['UI'])} AS ui,
  CASE WHEN v LIKE '%/S:C/%' THEN {_W('PR', scores.PRIVILEGES['C'])} ELSE {_W('PR', scores.PRIVILEGES['U'])} END AS pr, v LIKE '%/S:C/%' AS ch, 1 - (1 - {_W('C', scores.WEIGHTS['C'])}) * (1 - {_W('I', scores.WEIGHTS['I'])}) * (1 - {_W('A', scores.WEIGHTS['A'])}) AS iss FROM x WHERE regexp_matches(v, '{scores.VECTOR}')),
  i AS (SELECT *, 8.22::double * av * ac * pr * ui AS ex, CASE WHEN ch THEN 7.52::double * (iss - 0.029) - 3.25::double * pow(iss::double - 0.02, 15) ELSE 6.42::double * iss END AS im FROM m),
  s AS (SELECT v, CASE WHEN iss <= 0 OR im <= 0 THEN 0.0::double ELSE ceil(round(least(10.0::double, CASE WHEN ch THEN 1.08::double * (im + ex) ELSE im + ex END) * 10, 9)) / 10 END AS score FROM i)
SELECT v AS vector, score, CASE WHEN score <= 0 THEN 'none' WHEN score < 4 THEN 'low' WHEN score < 7 THEN 'medium' WHEN score < 9 THEN 'high' ELSE 'critical' END AS label FROM s""")
def cvss_scores(spark: SparkSession, d: str) -> DataFrame:
    """Base score and label of each distinct vector in the advisories."""
    vectors = table(spark, d, "advisories").select(F.explode(F.regexp_extract_all("json", F.lit(r"CVSS:3\.1/[A-Z:/]+"), F.lit(0))).alias("vector")).distinct()
    scored = vectors.withColumn("score", scores.base_score(F.col("vector"))).where("score is not null")
    return scored.withColumn("label", scores.severity_of(F.col("score")))


@query(""" SELECT row_id, CASE WHEN score IS NOT NULL THEN CASE WHEN score < 4 THEN 'low' WHEN score < 7 THEN 'medium' WHEN score < 9 THEN 'high' ELSE 'critical' END
  WHEN lower(trim(severity)) IN ('critical', 'high', 'medium', 'moderate', 'low', 'informational', 'none') THEN lower(trim(severity)) ELSE 'medium' END AS severity FROM f""", True)
def severity_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Severity by score, else by label, else medium."""
    return findings(spark, d).select("row_id", scores.severity_fallback(F.col("score"), F.col("severity")).alias("severity"))


@query(""" SELECT lower(trim(severity)) AS label, max(CASE lower(trim(severity)) WHEN 'critical' THEN 9.5 WHEN 'high' THEN 8.0 WHEN 'medium' THEN 5.5 WHEN 'moderate' THEN 5.5 WHEN 'low' THEN 2.0 WHEN 'informational' THEN 0.0 WHEN 'none' THEN 0.0 END)::double AS score FROM f GROUP BY 1""", True)
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    """Representative score of each severity label, null for others."""
    label = F.lower(F.trim("severity"))
    return findings(spark, d).groupBy(label.alias("label")).agg(F.max(scores.label_score(F.col("severity"))).alias("score"))


@query(""" SELECT strftime(recorded_at, '%Y-%m') AS month, count(*) AS n FROM f WHERE recorded_at IS NOT NULL GROUP BY 1""", True)
def month_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Findings per month."""
    return findings(spark, d).where("recorded_at is not null").groupBy(F.date_format("recorded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query(r""" SELECT DISTINCT run_id, CASE WHEN regexp_extract(run_id, '(\d{8})', 1) <> '' THEN regexp_extract(run_id, '(\d{8})', 1) ELSE substr(sha256(run_id), 1, 8) END AS tag FROM f WHERE run_id IS NOT NULL""", True)
def run_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date in each run id, else the beginning of its hash."""
    date = F.regexp_extract("run_id", r"(\d{8})", 1)
    return findings(spark, d).where("run_id is not null").select("run_id", F.when(date != "", date).otherwise(F.substring(F.sha2("run_id", 256), 1, 8)).alias("tag")).distinct()


@query(r""" SELECT row_id, path, regexp_matches(path, '(^|/)(test|tests|spec|fixtures)/|_test\.|test_|\.spec\.') AS is_test, regexp_matches(path, '(^|/)(vendor|node_modules|build|dist|store)/') AS excluded,
  CASE WHEN regexp_matches(path, '(^|/)(vendor|node_modules|build|dist)/') THEN 'vendored' WHEN regexp_matches(path, '(^|/)store/') THEN 'store' END AS reason FROM f""", True)
def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Whether a path is a test or excluded, with the reason."""
    path = F.col("path")
    reason = F.when(path.rlike(r"(^|/)(vendor|node_modules|build|dist)/"), "vendored").when(path.rlike(r"(^|/)store/"), "store")
    return findings(spark, d).select("row_id", "path", path.rlike(r"(^|/)(test|tests|spec|fixtures)/|_test\.|test_|\.spec\.").alias("is_test"), reason.isNotNull().alias("excluded"), reason.alias("reason"))


@query(r"SELECT doc_id, regexp_matches(array_to_string(list_slice(string_split(text, chr(10)), 1, 10), chr(10)), '(?i)generated|do not edit|imported from') AS is_generated, contains(text, chr(0)) AS is_binary FROM documents WHERE text IS NOT NULL")
def generated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose first ten lines say that they are generated, and those with a NUL."""
    head = text.slice_lines(F.col("text"), 1, 10)
    return table(spark, d, "documents").where("text is not null").select("doc_id", head.rlike("(?i)generated|do not edit|imported from").alias("is_generated"), F.contains("text", F.lit("\x00")).alias("is_binary"))


_Q = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_LADDER = f"CASE WHEN status IS NULL THEN 'skipped' WHEN status = 'error' THEN 'error' WHEN status IN {_Q(YES)} AND score < 1 THEN 'analysis_inconsistent' ELSE 'analysed' END"


@query(f" SELECT row_id, {_LADDER} AS derived, {_LADDER} = 'analysed' AS actionable, {_LADDER} = 'analysis_inconsistent' AS review FROM f", True)
def derived_status(spark: SparkSession, d: str) -> DataFrame:
    """A status by a ladder of rules, and the predicates on it."""
    yes = F.col("status").isin(*YES)
    ladder = F.when(F.col("status").isNull(), "skipped").when(F.col("status") == "error", "error").when(yes & (F.col("score") < 1), "analysis_inconsistent").otherwise("analysed")
    return findings(spark, d).select("row_id", ladder.alias("derived")).select("row_id", "derived", (F.col("derived") == "analysed").alias("actionable"), (F.col("derived") == "analysis_inconsistent").alias("review"))


@query(f" SELECT tool, count(*) FILTER (status IN {_Q(YES)}) AS n_true, count(*) FILTER (status IN {_Q(NO)}) AS n_false, count(*) FILTER (status IS NULL OR status NOT IN {_Q(YES + NO)}) AS n_unverified, count(*) FILTER (status IN {_Q(NO)} AND score >= 9) AS n_mismatch FROM f GROUP BY 1", True)
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """Findings by three-valued verdict, with those whose score contradicts it."""
    v = verdict(F.col("status"))
    return findings(spark, d).groupBy("tool").agg(F.count_if(v).alias("n_true"), F.count_if(~v).alias("n_false"), F.count_if(v.isNull()).alias("n_unverified"), F.count_if(~v & (F.col("score") >= 9)).alias("n_mismatch"))


@query(r"""WITH t AS (SELECT row_id, list_filter([CASE WHEN score >= 7 THEN 'severe' END, CASE WHEN cwe IN ('CWE-78', 'CWE-89') THEN 'injection' END, CASE WHEN path LIKE '%.c' OR path LIKE '%.cpp' THEN 'native' END], lambda x: x IS NOT NULL) AS reasons FROM f)
SELECT row_id, reasons, CASE WHEN len(reasons) >= 2 THEN 'deep' WHEN len(reasons) = 1 THEN 'normal' ELSE 'skim' END AS depth FROM t""".replace("WITH t AS", ", t AS"), True)
def triage_depth(spark: SparkSession, d: str) -> DataFrame:
    """Review depth by a ladder of reasons."""
    path = F.col("path")
    reasons = F.array_compact(F.array(F.when(F.col("score") >= 7, "severe"), F.when(F.col("cwe").isin("CWE-78", "CWE-89"), "injection"), F.when(path.endswith(".c") | path.endswith(".cpp"), "native")))
    rows = findings(spark, d).select("row_id", reasons.alias("reasons"))
    return rows.withColumn("depth", F.when(F.size("reasons") >= 2, "deep").when(F.size("reasons") == 1, "normal").otherwise("skim"))


@query(""", s AS (SELECT run_id, list_distinct(list(CASE WHEN path LIKE '%.py' OR path LIKE '%.rb' THEN 'script' WHEN path LIKE '%.c' OR path LIKE '%.cpp' THEN 'native' ELSE 'other' END)) AS k FROM f GROUP BY 1)
SELECT run_id, CASE WHEN list_has_all(['script'], k) THEN 'scripts only' WHEN list_has_all(['script', 'native'], k) THEN 'scripts and native' ELSE 'mixed' END AS shape FROM s""", True)
def diff_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The shape of each run by the set of categories of its files."""
    p = F.col("path")
    category = F.when(p.endswith(".py") | p.endswith(".rb"), "script").when(p.endswith(".c") | p.endswith(".cpp"), "native").otherwise("other")
    sets = findings(spark, d).groupBy("run_id").agg(F.collect_set(category).alias("k"))
    within = lambda *xs: F.size(F.array_except("k", F.array(*map(F.lit, xs)))) == 0
    return sets.select("run_id", F.when(within("script"), "scripts only").when(within("script", "native"), "scripts and native").otherwise("mixed").alias("shape"))


@query(f""" SELECT row_id, CASE WHEN status = 'error' THEN 'inconclusive' WHEN status IN {_Q(YES)} AND refs[1] IS NULL THEN 'refuted' WHEN status IN {_Q(NO)} AND refs[1] IS NOT NULL AND score >= 9 THEN 'inconclusive' WHEN status IN {_Q(YES)} THEN 'confirmed' WHEN status IN {_Q(NO)} THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM f""", True)
def evidence_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Verdict from claim and evidence: a failed tool settles nothing, a claim without matches is refuted."""
    v, ref = verdict(F.col("status")), F.try_element_at("refs", F.lit(1))
    ladder = (
        F.when(F.col("status") == "error", "inconclusive").when(v & ref.isNull(), "refuted").when(~v & ref.isNotNull() & (F.col("score") >= 9), "inconclusive")
        .when(v, "confirmed").when(~v, "refuted").otherwise("inconclusive")
    )
    return findings(spark, d).select("row_id", ladder.alias("verdict"))


@query(""" SELECT row_id, CASE WHEN path IS NULL THEN 'no path' WHEN line IS NULL OR line <= 0 THEN 'no line' WHEN kind = '' THEN 'no kind' WHEN cwe IS NULL THEN 'no weakness' END AS rejected FROM f""", True)
def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first reason why a row is rejected; null for a valid one."""
    reason = F.when(F.col("path").isNull(), "no path").when(F.col("line").isNull() | (F.col("line") <= 0), "no line").when(F.col("kind") == "", "no kind").when(F.col("cwe").isNull(), "no weakness")
    return findings(spark, d).select("row_id", reason.alias("rejected"))


@query(""", d AS (SELECT DISTINCT repo_url, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext FROM f)
SELECT a.repo_url, a.dir FROM (SELECT DISTINCT repo_url, dir FROM d WHERE ext = 'py') a LEFT JOIN (SELECT DISTINCT repo_url, dir FROM d WHERE ext = 'go') b ON a.repo_url = b.repo_url AND a.dir = b.dir WHERE b.dir IS NULL""".replace("\\\\", "\\"), True)
def missing_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Directories with a file of one kind but none of its companion kind."""
    dirs = findings(spark, d).select("repo_url", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("ext")).distinct()
    return dirs.where("ext = 'py'").select("repo_url", "dir").distinct().join(dirs.where("ext = 'go'").select("repo_url", "dir").distinct(), ["repo_url", "dir"], "left_anti")


@query(r""" SELECT tool, upper(substr(replace(kind, '_', ' '), 1, 1)) || substr(replace(kind, '_', ' '), 2) AS title, count(*) AS n FROM f GROUP BY 1, 2""", True)
def display_titles(spark: SparkSession, d: str) -> DataFrame:
    """Kinds as titles."""
    plain = F.replace("kind", F.lit("_"), F.lit(" "))
    return findings(spark, d).groupBy("tool", F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2))).alias("title")).agg(F.count("*").alias("n"))


@query(None)
def near_names(spark: SparkSession, d: str) -> DataFrame:
    """Package names one edit (or a swap of neighbours) from another name, each with its nearest one.

    Two names that are one edit apart share a form with at most one character deleted, so the equality on such forms
    loses no pair, and no pairs are formed beyond it."""
    names = table(spark, d, "advisories").select(F.lower("package").alias("name")).distinct().where("name <> ''")
    name = F.col("name")
    cut = F.transform(F.sequence(F.lit(1), F.length(name)), lambda k: F.concat(name.substr(F.lit(1), k - 1), name.substr(k + 1, F.length(name))))
    forms = names.select("name", F.explode(F.array_union(F.array(name), cut)).alias("f")).distinct()
    pairs = forms.join(forms.withColumnRenamed("name", "other"), "f").where("name <> other").select("name", "other").distinct()
    near = pairs.withColumn("distance", text.osa(2)("name", "other")).where("distance < 2")
    return near.groupBy("name").agg(F.min(F.struct("distance", "other")).alias("m")).select("name", F.col("m.other").alias("nearest"), F.col("m.distance").alias("distance"))
