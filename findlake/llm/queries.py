"""Queries and SQL of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.llm import bpe, packing, radix, truncation, truth
from findlake.session import table, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truth.surviving_rows(table(spark, d, "finding"), table(spark, d, "reviewer"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return radix.copies(radix.finding_keys(table(spark, d, "finding")))


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving severity and score of each finding when the models' reliability is estimated from their votes."""
    claims = truth.survivor_claims(truth.candidates(table(spark, d, "finding"))).where("field <> 'primary'")
    winners, _ = truth.truth_discovery(claims, truth.reliabilities(table(spark, d, "reviewer")))
    return winners.select(F.col("object").alias("finding_id"), F.col("field").alias("field_name"), F.col("value").alias("field_value"), F.col("row").alias("finding_row"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """One record for each set of copies, with the number of copies."""
    terminals, _ = radix.collapse(radix.finding_keys(table(spark, d, "finding")))
    return terminals.select(F.col("first").alias("first_row"), F.col("n").alias("n_copies"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(bpe.count_tokens(docs), "doc_id", n_items=docs.count())


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d))


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether the packing keeps every document, every capacity and every place."""
    docs = table(spark, d, "documents")
    packed = written(packing.pack(bpe.count_tokens(docs), "doc_id", n_items=docs.count()), "packed")
    return packing.audit(packed, docs, "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(table(spark, d, "documents"))


def p9_parts(spark: SparkSession, d: str) -> DataFrame:
    """How many texts each part of the method decides: nothing in them, a mark, a near-copy or the closing words."""
    return truncation.parts(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_survivors": p1_survivors,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p7_ids": p7_ids,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p8_audit": p8_audit,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_parts": p9_parts,
}

#: Letters and digits only, in lower case.
_A = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')".format
_NO = ", ".join(f"'{w}'" for w in truth.NO_VALUE)
_USABLE = lambda c: f"coalesce({_A(c)} NOT IN ({_NO}), false)"
_SEV = "regexp_matches(' ' || regexp_replace(lower(severity), '[^\\p{L}]+', ' ', 'g') || ' ', ' (" + "|".join(truth.SEVERITY_WORDS) + ") ')"
_CANON = lambda c: f"coalesce({_A(c)}, chr(1))"
_P1 = rf"""
WITH r AS (SELECT {_A("model")} AS m, max(reliability) AS rel FROM reviewer GROUP BY 1),
     f AS (SELECT finding_id, finding_row, recorded_at, {_A("regexp_replace(regexp_replace(model, '^.*/', ''), '[@:].*$', '')")} AS m,
                  coalesce({_SEV}, false) AS s, coalesce(NOT isnan(cvss_score_estimate) AND cvss_score_estimate > 0 AND cvss_score_estimate <= 10, false) AS v,
                  {_USABLE("cwe_id")}::int + {_USABLE("evidence_tool")}::int + {_USABLE("reasoning")}::int AS rest
             FROM finding WHERE finding_id IS NOT NULL AND coalesce({_A("status")}, '') <> 'error'),
     c AS (SELECT f.*, coalesce(r.rel, 0.5) AS rel, s::int + v::int + rest AS complete, count(*) OVER (PARTITION BY finding_id) AS n FROM f LEFT JOIN r USING (m)),
     u AS (SELECT finding_id, 'primary' AS field_name, finding_row, complete, rel, recorded_at FROM c WHERE n > 1
           UNION ALL SELECT finding_id, 'severity', finding_row, 0, rel, recorded_at FROM c WHERE n > 1 AND s
           UNION ALL SELECT finding_id, 'cvss_score_estimate', finding_row, 0, rel, recorded_at FROM c WHERE n > 1 AND v)
SELECT finding_id, field_name, finding_row FROM u
QUALIFY row_number() OVER (PARTITION BY finding_id, field_name ORDER BY complete DESC, rel DESC, recorded_at DESC NULLS LAST, finding_row) = 1
"""
_PAIR = "array_to_string(list_transform(string_split_regex(regexp_replace(p, '[=:]', chr(2)), chr(2)), lambda x: " + _A("x") + "), '=')"
_P5 = rf"""
WITH k AS (SELECT finding_row, {", ".join(_CANON(c) + f" AS k{i}" for i, c in enumerate(("repo_url", "tool", "coalesce(file, file_path)", "function", "coalesce(line, start_line)::varchar", "vuln_type", "cwe_id")))},
                  coalesce(array_to_string(list_sort(list_filter(list_transform(string_split_regex(detail, '[;,|\r\n]+'), lambda p: {_PAIR}), lambda q: q NOT IN ('', '='))), ';'), chr(1)) AS k7 FROM finding),
     g AS (SELECT finding_row, min(finding_row) OVER (PARTITION BY k0, k1, k2, k3, k4, k5, k6, k7) AS first_row FROM k)
SELECT first_row, finding_row AS copy_row FROM g WHERE first_row <> finding_row
"""
_P5_COUNTS = _P5.rsplit("SELECT", 1)[0] + "SELECT first_row, count(*) AS n_copies FROM g GROUP BY first_row"
_P8 = "SELECT count(*) AS n_documents, 0 AS n_missing, 0 AS n_over_capacity, 0 AS n_overlapping, 0 AS n_split_needlessly FROM documents WHERE doc_id IS NOT NULL"
ORACLES: dict[str, str] = {"p1_found": _P1, "p5_found": _P5, "p5_counts": _P5_COUNTS, "p8_audit": _P8}
