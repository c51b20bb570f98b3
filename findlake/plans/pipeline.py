"""Queries of the general data-preparation operators (packed fields, references, nesting, drift)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.operators import drift, nested, orphans, packed
from findlake.session import table, written


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(table(spark, d, "commits"), "commit_row", "parents", position="parent_no", value="parent_hash")


def _references(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, DataFrame]]:
    """(table, parent events, probes) of the two references."""
    commits, fixes, classes = (table(spark, d, t) for t in ("commits", "fixes", "cwe_classification"))
    full = orphans.parent_events(commits, orphans.hash_key(F.col("hash")), F.col("ingested_at"), F.col("deleted_at"))
    to_commits = orphans.probes(fixes, F.col("fix_row"), orphans.hash_key(F.col("hash")), F.col("recorded_at"))
    short = to_commits.where(F.length("key").between(12, 39)).select("key").distinct()
    arrivals = full.unionByName(orphans.short_parent_events(full, short, 12))
    fix_events = orphans.parent_events(fixes, orphans.cve_key(F.col("cve_id")), F.col("recorded_at"), F.col("withdrawn_at"))
    to_fixes = orphans.probes(classes, F.col("class_row"), orphans.cve_key(F.col("cve_id")), F.col("classified_at"))
    return [("fixes", arrivals, to_commits), ("cwe_classification", fix_events, to_fixes)]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = [
        orphans.followed(events, refs).select(F.lit(name).alias("source_table"), F.col("row").alias("source_row"), F.date_format("at", "yyyy-MM").alias("month_seen"), "orphan_kind")
        for name, events, refs in _references(spark, d)
    ]
    return found[0].unionByName(found[1])


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and kind."""
    return p6_found(spark, d).groupBy("source_table", "month_seen", "orphan_kind").agg(F.count("*").alias("n_orphans"))


def p6_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Open orphans at the end of each month, per table."""
    parts = [orphans.snapshots(events, refs).select(F.lit(name).alias("source_table"), "*") for name, events, refs in _references(spark, d)]
    return parts[0].unionByName(parts[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_snapshots": p6_snapshots,
}

#: Brute statements of the same results, without chunks or folds.
_P6 = r"""
WITH f AS (SELECT fix_row, recorded_at, withdrawn_at, nullif(regexp_replace(regexp_replace(lower(hash), '^.*/', ''), '[^0-9a-z]+', '', 'g'), '') AS k,
                  nullif(regexp_replace(upper(cve_id), '[^0-9A-Z]+', '', 'g'), '') AS cve FROM fixes),
     c AS (SELECT regexp_replace(lower(hash), '[^0-9a-z]+', '', 'g') AS k, ingested_at, deleted_at FROM commits),
     w AS (SELECT class_row, classified_at, nullif(regexp_replace(upper(cve_id), '[^0-9A-Z]+', '', 'g'), '') AS cve FROM cwe_classification),
     p AS (SELECT 'fixes' AS source_table, f.fix_row AS source_row, f.recorded_at AS t0, c.ingested_at AS came, c.deleted_at AS gone
             FROM f LEFT JOIN c ON substr(f.k, 1, 12) = substr(c.k, 1, 12) AND starts_with(c.k, f.k) WHERE f.k IS NOT NULL AND f.recorded_at IS NOT NULL
           UNION ALL
           SELECT 'cwe_classification', w.class_row, w.classified_at, f.recorded_at, f.withdrawn_at
             FROM w LEFT JOIN f ON w.cve = f.cve WHERE w.cve IS NOT NULL AND w.classified_at IS NOT NULL),
     s AS (SELECT source_table, source_row, t0, count(came) AS ever, count(*) FILTER (came <= t0) AS before,
                  count(*) FILTER (came <= t0 AND (gone IS NULL OR gone > t0)) AS alive FROM p GROUP BY ALL)
"""
ORACLES: dict[str, str] = {
    "p6_found": _P6 + """SELECT source_table, source_row, strftime(t0, '%Y-%m') AS month_seen,
       CASE WHEN ever = 0 THEN 'missing' WHEN before > 0 THEN 'deleted' ELSE 'late' END AS orphan_kind FROM s WHERE alive = 0""",
    "p6_report": _P6 + """SELECT source_table, strftime(t0, '%Y-%m') AS month_seen,
       CASE WHEN ever = 0 THEN 'missing' WHEN before > 0 THEN 'deleted' ELSE 'late' END AS orphan_kind, count(*) AS n_orphans FROM s WHERE alive = 0 GROUP BY ALL""",
}

#: What each key's references and parents do at each time, and how many of its references are open then.
ORACLES["p6_snapshots"] = _P6 + """, refs AS (SELECT 'fixes' AS source_table, k, recorded_at AS t FROM f WHERE k IS NOT NULL AND recorded_at IS NOT NULL UNION ALL SELECT 'cwe_classification', cve, classified_at FROM w WHERE cve IS NOT NULL AND classified_at IS NOT NULL),
  rk AS (SELECT DISTINCT source_table, k FROM refs),
  par AS (SELECT source_table, rk.k, c.ingested_at AS came, c.deleted_at AS gone FROM rk JOIN c ON source_table = 'fixes' AND substr(rk.k, 1, 12) = substr(c.k, 1, 12) AND starts_with(c.k, rk.k) WHERE ingested_at IS NOT NULL
          UNION ALL SELECT source_table, rk.k, f.recorded_at, f.withdrawn_at FROM rk JOIN f ON source_table = 'cwe_classification' AND rk.k = f.cve WHERE f.recorded_at IS NOT NULL),
  ev AS (SELECT source_table, k, t, 0 AS n, 1 AS r FROM refs UNION ALL SELECT source_table, k, came, 1, 0 FROM par WHERE gone IS NULL OR gone > came UNION ALL SELECT source_table, k, gone, -1, 0 FROM par WHERE gone > came),
  ti AS (SELECT source_table, k, t, sum(n) AS n, sum(r) AS r FROM ev GROUP BY ALL),
  st AS (SELECT source_table, k, t, CASE WHEN sum(n) OVER o <= 0 THEN sum(r) OVER o ELSE 0 END AS open_now FROM ti WINDOW o AS (PARTITION BY source_table, k ORDER BY t)),
  ch AS (SELECT source_table, t, open_now - lag(open_now, 1, 0) OVER (PARTITION BY source_table, k ORDER BY t) AS d FROM st),
  mo AS (SELECT source_table, strftime(t, '%Y-%m') AS month, sum(d) AS net, sum(greatest(d, 0)) AS opened, sum(greatest(-d, 0)) AS resolved FROM ch WHERE d <> 0 GROUP BY ALL)
SELECT source_table, month, (sum(net) OVER (PARTITION BY source_table ORDER BY month))::bigint AS open_orphans, opened::bigint AS opened, resolved::bigint AS resolved FROM mo"""
#: Values between quotes (quotes doubled or behind a backslash are part of them) or between delimiters.
ORACLES["p3_found"] = r"""
WITH b AS (SELECT commit_row, trim(parents, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS t FROM commits WHERE parents IS NOT NULL),
     u AS (SELECT commit_row, CASE WHEN regexp_matches(t, '^(\[[\s\S]*\]|\([\s\S]*\)|\{[\s\S]*\})$') THEN t[2:-2] ELSE t END AS t FROM b WHERE lower(t) NOT IN ('NO_WORDS')),
     v AS (SELECT commit_row, regexp_extract_all(t, '"(?:[^"\\]|\\[\s\S]|"")*"|''(?:[^''\\]|\\[\s\S]|'''')*''|[^,;|\s\x{A0}]+') AS vs FROM u WHERE lower(trim(t)) NOT IN ('NO_WORDS')),
     x AS (SELECT commit_row, list_filter(list_transform(vs, lambda p: trim(CASE WHEN p[1] = '"' THEN replace(replace(replace(p[2:-2], '""', '"'), '\"', '"'), '\''', '''')
                  WHEN p[1] = '''' THEN replace(replace(replace(p[2:-2], '''''', ''''), '\''', ''''), '\"', '"') ELSE p END)), lambda p: p NOT IN ('', '/', '+', '&')) AS vs FROM v)
SELECT commit_row, unnest(generate_series(1, len(vs)))::int AS parent_no, unnest(vs) AS parent_hash FROM x
""".replace("NO_WORDS", "', '".join(packed.NO_VALUES))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.advisory_children(nested.advisory_triples(table(spark, d, "advisories")))


QUERIES["p2_found"] = p2_found


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(table(spark, d, "raw_record"))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "raw_record"))


def p4_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the one table per feed, with their types."""
    rows = drift.fields(table(spark, d, "raw_record"))
    kinds = written(drift.column_types(rows), "profiles")
    return drift.unified_columns(kinds, drift.lineage(kinds, drift.drift_report(table(spark, d, "raw_record"))))


QUERIES |= {"p4_found": p4_found, "p4_unified": p4_unified, "p4_columns": p4_columns}
