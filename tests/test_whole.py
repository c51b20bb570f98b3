"""Queries on small tables of their own: rows that a filter or an exact comparison would lose."""

from datetime import datetime

import pytest

from findlake.operators import intervals
from findlake.plans import enrichment, scalars, structure

A, B, C, D, X = (c * 40 for c in "abcdf")
T = datetime(2024, 1, 1)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables, each given as (rows, schema), and returns their folder."""

    def write(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


COMMITS = "hash string, repo_url string, parents string, deleted_at timestamp_ntz"


def test_shortened_parents(spark, tables):
    # B by 12 digits, C by 16 behind a name, X is known from D's whole parent only, the last one from nowhere
    d = tables(commits=([(A, "r", f"{B[:12]}, main:{C[:16].upper()}", T), (B, "r", X[:14], None), (C, "r", "0123456789ab", None), (D, "r", X, None)], COMMITS))
    assert rows_of(structure.commit_edges(spark, d)) == sorted([(A, B), (A, C), (B, X), (C, "0123456789ab"), (D, X)])
    assert rows_of(structure.ancestors_of_deleted(spark, d)) == sorted([(A,), (B,), (C,), (X,), ("0123456789ab",)])
    assert rows_of(structure.unreached_commits(spark, d)) == [("r", 1)]
    assert rows_of(structure.open_edges(spark, d)) == sorted([(A, B), (A, C)])
    assert (X, 2, 0) in rows_of(structure.caller_context(spark, d))
    assert (B, 1) in rows_of(structure.sibling_counts(spark, d))


def test_verified_commits(spark, tables):
    fixes = [(A,), (f"https://git.example.org/x/commit/{B.upper()}",), (f" {C[:12]}",), (D[:11],), (None,), (X,)]
    d = tables(commits=([(A, "r", None, None), (B, "r", None, None), (C, "s", None, None), (D, "s", None, None)], COMMITS), fixes=(fixes, "hash string"))
    assert rows_of(enrichment.environment_summary(spark, d)) == [("r", 2, 0), ("s", 1, 1)]


FIXES = "cve_id string, hash string, withdrawn_at timestamp_ntz"


def test_fix_pairs_spellings(spark, tables):
    d = tables(
        commits=([(A, "r", None, None), (B, "r", None, None)], COMMITS), fixes=([("CVE-2024-0001", A[:12], None), ("cve 2024 0002", B, None)], FIXES),
        cwe_classification=([("CVE-2024-0001", "cwe89"), ("CVE-2024-0002", "[CWE-78]"), ("CVE-2024-0002", "CWE-789")], "cve_id string, cwe_id string"), repository=([("r", "C")], "repo_url string, repo_language string"),
    )
    assert rows_of(structure.fix_pairs(spark, d)) == [("CVE20240001", A, "CWE-89", "C"), ("CVE20240002", B, "CWE-78", "C")]


def test_shortened_enforcer(spark, tables):
    # A is deleted; B and C descend from it, B also from the withdrawn fix D, given by 12 digits
    d = tables(commits=([(A, "r", None, T), (B, "r", f"{A}, {D}", None), (C, "r", A, None), (D, "r", None, None)], COMMITS), fixes=([("CVE-2024-0001", D[:12], T)], FIXES))
    assert rows_of(structure.bypassing_commits(spark, d)) == [(C,)]


def test_totals_of_odd_lines(spark, tables, monkeypatch):
    rows = spark.createDataFrame([("odd", "t", 7, None, None, None), ("odd", "t", 1, None, None, None), ("even", "t", 8, None, None, None), ("none", "t", None, None, None, None), ("zero", "t", 0, None, None, None)], "path string, tool string, line int, recorded_at timestamp_ntz, function string, status string")
    monkeypatch.setattr(structure, "findings", lambda spark, d: rows)
    assert rows_of(structure.coverage_percent(spark, "")) == [("even", 6, 75.0), ("odd", 12, 171.4286), ("zero", 6, 0.0)]
    unknown = intervals.percent(structure.marks(spark, ""), rows.where("path = 'odd'").selectExpr("path as file", "line as total").where("total = 7"), ["file"])
    assert rows_of(unknown) == [("even", 6, 0.0), ("odd", 12, 171.4286), ("zero", 6, 0.0)]


def test_vectors_end_where_they_end(spark):
    from pyspark.sql import functions as F

    from findlake.functions import scores

    good = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    df = spark.createDataFrame([(good,), (good + "\n",), ("\n" + good,), (good + "/E:P",), (good[:-1] + "X",), (None,)], "v string")
    assert [r.s for r in df.select(scores.base_score(F.col("v")).alias("s")).collect()] == [9.8, None, None, 9.8, None, None]


def test_ancestors_of_any_depth(spark):
    from findlake.operators import joins

    deep = "/".join(f"d{k}" for k in range(80))
    lower = spark.createDataFrame([(1, deep, "e"), (2, "", "e"), (3, deep, "f")], "row int, at string, eco string")
    upper = spark.createDataFrame([("", 0, "root", "e"), ("d0/d1", 1, "near", "e"), ("d1", 2, "no", "e")], "dir string, position int, name string, eco string")
    assert rows_of(joins.nearest_ancestor(lower, upper, ["eco"], "at", "dir", "row", "position", "name")) [:2] == [(1, "d0/d1", "near"), (2, "", "root")]
    only_root = joins.nearest_ancestor(lower, upper.where("dir = ''"), ["eco"], "at", "dir", "row", "position", "name")
    assert only_root.where("row = 1").first().name == "root"


def test_tolerance_matches_brute_force(spark):
    import random

    from findlake.operators import joins

    rnd = random.Random(3)
    pick = rnd.choice
    files, cwes = ["a/b.c", "x/a/b.c", "b.c", "y/d.c", "", None], ["CWE-1", "CWE-2", "CWE-3", None]
    e = [(k, pick(files), pick(cwes), pick([None, 1, 60, 64, 100, 130, 700]), pick([None, 5, 64, 140, 800])) for k in range(150)]
    p = [(k, pick(files), pick(cwes), pick([None, 1, 63, 64, 65, 120, 690]), pick([None, 70, 128, 900])) for k in range(150)]
    family = {"CWE-1": ["CWE-2"], "CWE-2": ["CWE-1"]}
    want = []
    for i, f, c, lo, hi in e:
        for j, g, q, a, b in p:
            if f is None or g is None or not f or not g or c is None or q is None or not (f.endswith(g) or g.endswith(f)) or f.split("/")[-1] != g.split("/")[-1] or not (c == q or q in family.get(c, [])):
                continue
            top, end = hi if hi is not None else lo, b if b is not None else a
            if lo is None or (a is not None and a <= top + 10 and end >= lo - 10):
                want.append((i, j))
    es = spark.createDataFrame(e, "expected_id int, file string, cwe string, line_start int, line_end int")
    ps = spark.createDataFrame(p, "produced_id int, file string, cwe string, start_line int, end_line int")
    assert rows_of(joins.tolerance_match(es, ps, 10, family)) == sorted(want) and want


def test_snapshots_of_hot_keys(spark):
    import random
    from datetime import timedelta

    from pyspark.sql import functions as F

    from findlake.operators import orphans

    rnd = random.Random(6)
    day = lambda: T + timedelta(days=rnd.randint(0, 90), hours=rnd.randint(0, 23))
    p = spark.createDataFrame([(rnd.choice("AAB"), day(), rnd.choice([None, day()])) for _ in range(60)], "key string, came timestamp_ntz, gone timestamp_ntz")
    r = spark.createDataFrame([(k, rnd.choice("AAABC"), day()) for k in range(120)], "row long, key string, at timestamp_ntz")
    log = orphans.parent_events(p, F.col("key"), F.col("came"), F.col("gone"))
    plain = rows_of(orphans.snapshots(log, r))
    assert rows_of(orphans.snapshots(log, r, 3)) == plain and len(plain) > 2
    assert rows_of(orphans.orphans(log, r, 1)) == rows_of(orphans.orphans(log, r))


def test_first_versions_of_all_texts(spark, tables):
    texts = [(1, "x" * 3000 + " 1.2"), (2, "v3.4 of 12345678901"), (3, "12345678901.5"), (4, "none"), (5, None), (6, "2147483647")]
    got = scalars.first_versions(spark, tables(documents=(texts, "doc_id bigint, text string")))
    assert {r.doc_id: r.version for r in got.collect()} == {1: [1, 2], 2: [3, 4], 3: [12345678901, 5], 6: [2147483647]}
