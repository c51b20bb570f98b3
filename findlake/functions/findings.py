"""Columns of a finding in one spelling: path, weakness, kind, status, model. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.session import alnum

NBSP = " "


def finding_path(file: Column, file_path: Column) -> Column:
    """The first path that is not empty, with forward slashes and without quotes, blanks and a leading ./ or /."""
    raw = F.coalesce(F.nullif(file, F.lit("")), F.nullif(file_path, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(raw, r"\\", "/"), rf'^[\s"{NBSP}]+|[\s"{NBSP}]+$', "")
    return F.regexp_replace(F.regexp_replace(bare, r"^(\.?/)+", ""), r"/(\.?/)+", "/")


def cwe_name(raw: Column) -> Column:
    """CWE-N for any spelling that has a number; null for others."""
    number = F.regexp_extract(raw, r"(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("CWE-"), F.ltrim(number, F.lit("0"))))


def kind_name(raw: Column) -> Column:
    """snake_case of any spelling (camelCase, spaces, dashes, brackets)."""
    snake = F.regexp_replace(F.regexp_replace(raw, "([a-z])([A-Z])", "$1_$2"), "[^A-Za-z]+", "_")
    return F.lower(F.regexp_replace(snake, "^_+|_+$", ""))


def status_name(raw: Column) -> Column:
    """Lower case, blanks and dashes as underscores, without blanks around; null for a blank one."""
    trimmed = F.trim(raw)
    return F.when(trimmed != "", F.regexp_replace(F.lower(trimmed), "[ -]", "_"))


def model_name(raw: Column) -> Column:
    return alnum(F.regexp_replace(F.regexp_replace(raw, "^.*/", ""), "[@:].*$", ""))


def normal_findings(finding: DataFrame) -> DataFrame:
    """The columns that the finding operators work on."""
    return finding.select(
        F.col("finding_row").alias("row_id"), "finding_id", "id", "run_id", "repo_url", finding_path(F.col("file"), F.col("file_path")).alias("path"),
        F.regexp_replace("function", rf"^[\s{NBSP}]+|[\s{NBSP}]+$", "").alias("function"), F.coalesce("line", "start_line").alias("line"), kind_name(F.col("vuln_type")).alias("kind"),
        cwe_name(F.col("cwe_id")).alias("cwe"), F.regexp_replace(F.lower("tool"), "[^a-z]", "").alias("tool"), model_name(F.col("model")).alias("model"),
        status_name(F.coalesce(F.nullif(F.col("final_status"), F.lit("")), F.col("status"))).alias("status"),
        F.transform(F.coalesce("provenance_refs", F.array().cast("array<struct<run_id:string>>")), lambda r: r["run_id"]).alias("refs"),
        F.when((F.col("cvss_score_estimate") > 0) & (F.col("cvss_score_estimate") <= 10), F.col("cvss_score_estimate")).alias("score"), "severity", "recorded_at", "reasoning", "detail",
    )


#: The same in SQL: the first part of a WITH clause.
SQL = rf"""
WITH f AS (SELECT finding_row AS row_id, finding_id, id, run_id, repo_url,
  regexp_replace(regexp_replace(regexp_replace(replace(coalesce(nullif(file, ''), nullif(file_path, '')), '\', '/'), '^[\s"{NBSP}]+|[\s"{NBSP}]+$', '', 'g'), '^(\.?/)+', ''), '/(\.?/)+', '/', 'g') AS path,
  regexp_replace(function, '^[\s{NBSP}]+|[\s{NBSP}]+$', '', 'g') AS function, coalesce(line, start_line) AS line,
  lower(regexp_replace(regexp_replace(regexp_replace(vuln_type, '([a-z])([A-Z])', '\1_\2', 'g'), '[^A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS kind,
  CASE WHEN regexp_extract(cwe_id, '(\d+)', 1) <> '' THEN 'CWE-' || ltrim(regexp_extract(cwe_id, '(\d+)', 1), '0') END AS cwe,
  regexp_replace(lower(tool), '[^a-z]', '', 'g') AS tool,
  regexp_replace(lower(regexp_replace(regexp_replace(model, '^.*/', ''), '[@:].*$', '')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS model,
  CASE WHEN trim(coalesce(nullif(final_status, ''), status)) <> '' THEN regexp_replace(lower(trim(coalesce(nullif(final_status, ''), status))), '[ -]', '_', 'g') END AS status,
  list_transform(coalesce(provenance_refs, []), lambda r: r.run_id) AS refs,
  CASE WHEN NOT isnan(cvss_score_estimate) AND cvss_score_estimate > 0 AND cvss_score_estimate <= 10 THEN cvss_score_estimate END AS score,
  severity, recorded_at, reasoning, detail FROM finding)
"""
