"""Queries over advisories as related tables: their children, one finding per advisory, alias merge, smallest fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions import scores
from findlake.operators import nested, supply
from findlake.session import table, written

#: Wrappers off by recursion, then list by list: items, what lies below affected packages, and the events of ranges.
_CHILDREN = r"""
WITH RECURSIVE u AS (
  SELECT osv_id, try_cast(trim(json, ' ' || chr(9) || chr(10) || chr(13) || chr(65279)) AS JSON) AS j FROM advisories WHERE osv_id IS NOT NULL
  UNION
  SELECT osv_id, unnest(CASE json_type(j) WHEN 'VARCHAR' THEN [try_cast(trim(j ->> '$', ' ' || chr(9) || chr(10) || chr(13) || chr(65279)) AS JSON)] WHEN 'ARRAY' THEN json_extract(j, '$[*]') ELSE json_extract(j, '$.*') END)
    FROM u WHERE json_type(j) IN ('VARCHAR', 'ARRAY') OR (json_type(j) = 'OBJECT' AND NOT json_exists(j, '$.id'))),
rec AS (SELECT DISTINCT osv_id, j FROM u WHERE json_type(j) = 'OBJECT' AND json_exists(j, '$.id')),
top AS (SELECT osv_id, f, '$' AS parent_path, f AS list_path, j -> f AS x FROM rec, unnest(['aliases', 'severity', 'references', 'credits', 'affected']) AS q(f)),
item AS (SELECT osv_id, f, parent_path, list_path, unnest(generate_series(0, len(xs) - 1)) AS k, unnest(xs) AS x FROM (SELECT *, CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') WHEN 'NULL' THEN [] ELSE [x] END AS xs FROM top WHERE x IS NOT NULL)),
below AS (SELECT osv_id, f, list_path || '[' || k || ']' AS parent_path, list_path || '[' || k || '].' || f AS list_path, x -> f AS x FROM (SELECT osv_id, list_path, k, x FROM item WHERE f = 'affected' AND json_type(x) = 'OBJECT'), unnest(['versions', 'ranges']) AS q(f)),
item2 AS (SELECT osv_id, f, parent_path, list_path, unnest(generate_series(0, len(xs) - 1)) AS k, unnest(xs) AS x FROM (SELECT *, CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') WHEN 'NULL' THEN [] ELSE [x] END AS xs FROM below WHERE x IS NOT NULL)),
ev AS (SELECT osv_id, 'events' AS f, list_path || '[' || k || ']' AS parent_path, list_path || '[' || k || '].events' AS list_path, x -> 'events' AS x FROM item2 WHERE f = 'ranges' AND json_type(x) = 'OBJECT'),
item3 AS (SELECT osv_id, parent_path, list_path, unnest(generate_series(0, len(xs) - 1)) AS k, unnest(xs) AS x FROM (SELECT *, CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') WHEN 'NULL' THEN [] ELSE [x] END AS xs FROM ev WHERE x IS NOT NULL)),
val AS (
  SELECT osv_id, CASE f WHEN 'aliases' THEN 'alias' WHEN 'references' THEN 'reference' WHEN 'credits' THEN 'credit' WHEN 'versions' THEN 'version' WHEN 'ranges' THEN 'range' ELSE f END AS child_kind, parent_path, list_path || '[' || k || ']' AS child_path,
         CASE WHEN json_type(x) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN x ->> '$' WHEN f = 'severity' THEN x ->> 'score' WHEN f = 'references' THEN x ->> 'url' WHEN f = 'credits' THEN x ->> 'name' WHEN f = 'ranges' THEN x ->> 'type'
              WHEN f = 'affected' THEN coalesce(x ->> '$.package.name', CASE WHEN json_type(x -> 'package') = 'VARCHAR' THEN x ->> 'package' END) END AS item_value
    FROM (SELECT osv_id, f, parent_path, list_path, k, x FROM item UNION ALL SELECT osv_id, f, parent_path, list_path, k, x FROM item2)
  UNION ALL
  SELECT osv_id, 'event', parent_path, list_path || '[' || k || ']', key || ':' || value FROM (SELECT osv_id, parent_path, list_path, k, unnest(json_keys(x)) AS key, x FROM item3 WHERE json_type(x) = 'OBJECT'), LATERAL (SELECT x ->> key AS value) WHERE value IS NOT NULL)
"""
_LAST = "SELECT DISTINCT osv_id, child_kind, parent_path, child_path, item_value FROM val WHERE item_value IS NOT NULL"
_W = lambda k, t: "CASE regexp_extract(v, '/" + k + ":([A-Z])', 1) " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in t.items()) + " END"
_SCORES = rf"""x AS (SELECT DISTINCT item_value AS v FROM val WHERE child_kind = 'severity'),
m AS (SELECT v, {_W('AV', scores.WEIGHTS['AV'])} AS av, {_W('AC', scores.WEIGHTS['AC'])} AS ac, {_W('UI', scores.WEIGHTS['UI'])} AS ui, CASE WHEN v LIKE '%/S:C/%' THEN {_W('PR', scores.PRIVILEGES['C'])} ELSE {_W('PR', scores.PRIVILEGES['U'])} END AS pr,
  v LIKE '%/S:C/%' AS ch, 1 - (1 - {_W('C', scores.WEIGHTS['C'])}) * (1 - {_W('I', scores.WEIGHTS['I'])}) * (1 - {_W('A', scores.WEIGHTS['A'])}) AS iss FROM x WHERE regexp_matches(v, '{scores.VECTOR}')),
i AS (SELECT *, 8.22::double * av * ac * pr * ui AS ex, CASE WHEN ch THEN 7.52::double * (iss - 0.029) - 3.25::double * pow(iss::double - 0.02, 15) ELSE 6.42::double * iss END AS im FROM m),
sc AS (SELECT v, CASE WHEN iss <= 0 OR im <= 0 THEN 0.0::double ELSE ceil(round(least(10.0::double, CASE WHEN ch THEN 1.08::double * (im + ex) ELSE im + ex END) * 10, 9)) / 10 END AS score FROM i)"""


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The flat tables, from triples that are read once."""
    return nested.advisory_tables(written(nested.advisory_triples(table(spark, d, "advisories")), "triples"))


def _met(t: dict[str, DataFrame]) -> DataFrame:
    """ecosystem, name, osv_id, item_path of each affected package."""
    return t["affected"].where("package is not null").select(F.coalesce("ecosystem", F.lit("")).alias("ecosystem"), F.lower("package").alias("name"), F.col("record").alias("osv_id"), "item_path").distinct()


def advisory_findings(spark: SparkSession, d: str) -> DataFrame:
    """One finding per affected package and set of CVE aliases, with its primary advisory; a row per merged advisory."""
    t = _tables(spark, d)
    score = t["severity"].groupBy(F.col("record").alias("osv_id")).agg(F.max(scores.base_score(F.col("score"))).alias("score"))
    aliases = t["alias"].select(F.col("record").alias("osv_id"), "alias")
    return supply.merge_aliases(_met(t).join(score, "osv_id", "left").select("ecosystem", "name", "osv_id", "score"), aliases)


def smallest_fixes(spark: SparkSession, d: str) -> DataFrame:
    """The least fixed version of each affected package of an advisory, in the order of its ecosystem."""
    t = _tables(spark, d)
    fixed = t["event"].where("fixed is not null").select(F.col("record").alias("osv_id"), F.regexp_extract("parent_path", r"^(affected\[\d+\])", 1).alias("item_path"), "fixed")
    return supply.smallest_fix(_met(t).join(fixed, ["osv_id", "item_path"]).select("ecosystem", "name", "osv_id", "fixed"))


def _flat(name: str, columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = nested.advisory_tables(nested.advisory_triples(table(spark, d, "advisories")))[name]
        return rows.select(F.col("record").alias("osv_id"), "parent_path", F.col("item_path").alias("child_path"), *columns)

    query.__doc__ = f"The flat table of the {name} items."
    return query


#: The related tables as the pivot gives them, a query each.
FLAT = {"alias": ["alias"], "severity": ["type", "score"], "reference": ["type", "url"], "credit": ["name"], "affected": ["ecosystem", "package", "purl"], "range": ["type", "repo"], "version": ["version"], "event": ["introduced", "fixed", "last_affected", "limit"]}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"advisory_findings": advisory_findings, "smallest_fixes": smallest_fixes}
QUERIES |= {f"p2_table_{name}": _flat(name, columns) for name, columns in FLAT.items()}
ORACLES: dict[str, str] = {
    "p2_found": _CHILDREN + _LAST,
    "advisory_findings": _CHILDREN + ", " + _SCORES + """,
pk AS (SELECT DISTINCT osv_id, coalesce(x ->> '$.package.ecosystem', '') AS ecosystem, lower(coalesce(x ->> '$.package.name', '')) AS name FROM item WHERE f = 'affected' AND json_type(x) = 'OBJECT' AND x ->> '$.package.name' IS NOT NULL),
s1 AS (SELECT osv_id, max(score) AS score FROM val LEFT JOIN sc ON item_value = v WHERE child_kind = 'severity' GROUP BY 1),
al AS (SELECT osv_id, string_agg(DISTINCT upper(item_value), ' ' ORDER BY upper(item_value)) AS cves FROM val WHERE child_kind = 'alias' AND upper(item_value) LIKE 'CVE-%' GROUP BY 1),
k AS (SELECT ecosystem, name, pk.osv_id, coalesce(score, 0) AS score, coalesce(cves, pk.osv_id) AS finding FROM pk LEFT JOIN s1 USING (osv_id) LEFT JOIN al USING (osv_id))
SELECT ecosystem, name, finding, first_value(osv_id) OVER (PARTITION BY ecosystem, name, finding ORDER BY score DESC, osv_id NOT LIKE 'GHSA-%', osv_id) AS primary_id, osv_id, score FROM k""",
}
#: Lists of bare values, whose table has one column; of several values in one place the greatest.
ORACLES |= {
    f"p2_table_{kind}": _CHILDREN + f"SELECT osv_id, parent_path, child_path, max(item_value) AS {kind} FROM val WHERE child_kind = '{kind}' AND item_value IS NOT NULL GROUP BY ALL" for kind in ("alias", "version")
}
