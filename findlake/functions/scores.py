"""Scores and labels: CVSS 3.x base score, severity labels, rule ladders. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findlake.operators.dedup import lookup

#: Fixed values of the CVSS 3.1 specification.
WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
VECTOR = r"\ACVSS:3\.[01]/AV:[NALP]/AC:[LH]/PR:[NLH]/UI:[NR]/S:[UC]/C:[NLH]/I:[NLH]/A:[NLH](/[A-Z]+:[A-Z])*\z"
#: A representative score of each label.
LABEL_SCORES = {"critical": 9.5, "high": 8.0, "medium": 5.5, "moderate": 5.5, "low": 2.0, "informational": 0.0, "none": 0.0}


def base_score(vector: Column) -> Column:
    """CVSS 3.x base score rounded up to a tenth; null for a vector that is malformed."""
    m = F.str_to_map(vector, F.lit("/"), F.lit(":"))
    get = lambda k: F.try_element_at(m, F.lit(k))
    w = {k: lookup(get(k), v, None) for k, v in WEIGHTS.items()}
    changed = get("S") == "C"
    privileges = F.when(changed, lookup(get("PR"), PRIVILEGES["C"], None)).otherwise(lookup(get("PR"), PRIVILEGES["U"], None))
    iss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    exploitability = 8.22 * w["AV"] * w["AC"] * privileges * w["UI"]
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    raw = F.least(F.lit(10.0), F.when(changed, 1.08 * (impact + exploitability)).otherwise(impact + exploitability))
    score = F.when((iss <= 0) | (impact <= 0), 0.0).otherwise(F.ceil(F.round(raw * 10, 9)) / 10)
    known = [*w.values(), privileges]
    return F.when(vector.rlike(VECTOR) & ~F.array_contains(F.array(*[x.isNull() for x in known]), True), score)


def severity_of(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score <= 0, "none").when(score < 4, "low").when(score < 7, "medium").when(score < 9, "high").otherwise("critical")


def label_score(label: Column) -> Column:
    return lookup(F.lower(F.trim(label)), LABEL_SCORES, None)


def severity_fallback(score: Column, label: Column) -> Column:
    """The severity of the score, else the label, else medium."""
    return F.coalesce(severity_of(score), F.when(F.lower(F.trim(label)).isin(*LABEL_SCORES), F.lower(F.trim(label))), F.lit("medium"))
