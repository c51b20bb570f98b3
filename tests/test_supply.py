"""Supply-chain operators against brute force and known cases."""

import random

import pytest

from findlake.functions.text import osa_distance
from findlake.operators import supply


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


MET = "ecosystem string, name string, osv_id string, score double, finding string"


def test_aliases_merge_only_equal_sets(spark):
    met = [("PyPI", "p", "PYSEC-1", 9.8, "x"), ("PyPI", "p", "GHSA-a", 0.0, "x"), ("PyPI", "p", "GHSA-b", 5.0, "x"), ("PyPI", "p", "PYSEC-2", 5.0, "x"), ("PyPI", "p", "GHSA-c", None, "x"), ("PyPI", "q", "GHSA-c", None, "x"), ("PyPI", "p", "N1", None, "x"), ("PyPI", "p", "N2", 1.0, "x"), ("PyPI", "p", "N2", 1.0, "x")]
    aliases = [("PYSEC-1", "CVE-1"), ("GHSA-a", "cve-1"), ("GHSA-a", "CVE-1"), ("GHSA-b", "CVE-2"), ("PYSEC-2", "CVE-2"), ("PYSEC-2", "GHSA-b"), ("GHSA-c", "CVE-1"), ("GHSA-c", "CVE-2"), ("N1", None), ("N2", "OTHER-1")]
    a, b = spark.createDataFrame(met, MET), spark.createDataFrame(aliases, "osv_id string, alias string")
    got = {(r.name, r.osv_id): r.primary_id for r in supply.merge_aliases(a, b).collect()}
    assert got == {("p", "PYSEC-1"): "PYSEC-1", ("p", "GHSA-a"): "PYSEC-1", ("p", "GHSA-b"): "GHSA-b", ("p", "PYSEC-2"): "GHSA-b", ("p", "GHSA-c"): "GHSA-c", ("q", "GHSA-c"): "GHSA-c", ("p", "N1"): "N1", ("p", "N2"): "N2"}
    assert rows_of(supply.merge_aliases(a.limit(0), b.limit(0))) == []


def test_smallest_fix(spark):
    rows = [("npm", "a", "1", v) for v in ("5.0.1", "4.99.99", "5.0.0", None, "no version")] + [("npm", "a", "2", "zz"), ("npm", "a", "2", "yy"), ("PyPI", "b", "1", "1.0"), ("PyPI", "b", "1", "1.0rc1"), ("npm", "c", "1", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "ecosystem string, name string, osv_id string, fixed string, key string").drop("key")
    assert rows_of(supply.smallest_fix(df)) == [("PyPI", "b", "1", "1.0rc1"), ("npm", "a", "1", "4.99.99"), ("npm", "a", "2", "yy")]


def test_lockfile_drift(spark):
    rows = [
        ("npm", "w/package.json", "a", "1.0.0", False, "exact", 1), ("npm", "w/lock.json", "a", "1.0.1", True, None, 2), ("npm", "w/package.json", "b", "1.0.0", False, "exact", 1), ("npm", "w/lock.json", "b", "1.0.0", True, None, 2),
        ("npm", "w/package.json", "c", "1.0.0", False, "caret", 1), ("npm", "w/lock.json", "c", "2.0.0", True, None, 2), ("npm", "v/package.json", "a", "1.0.0", False, "exact", 1), ("PyPI", "r.txt", "d", "1.0", False, "exact", 1), ("PyPI", "lock", "d", "1.0.0", True, None, 9), ("PyPI", "lock", "d", "3", True, None, 10),
        ("npm", "w\\lock.json", "e", "2", True, None, 3), ("npm", "w\\package.json", "e", None, False, "exact", 3), ("zzz", "p", "f", "a", False, "exact", 1), ("zzz", "q", "f", "b", True, None, 1),
    ]
    df = spark.createDataFrame(rows, "ecosystem string, declared_in string, name string, version string, is_lockfile boolean, pin_style string, position int")
    assert rows_of(supply.lockfile_drift(df)) == [("npm", "w", "a", "1.0.0", "1.0.1"), ("zzz", "", "f", "a", "b")]


@pytest.mark.parametrize("edits", [1, 2])
def test_all_pairs_within_edits(spark, edits):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc-") for _ in range(rnd.randint(0, 7)))
    left, right = {word() for _ in range(60)} | {"a" * 300}, {word() for _ in range(40)}
    want = sorted((a, b, osa_distance(a, b, 9)) for a in left for b in right if osa_distance(a, b, 9) <= edits)
    l, r = spark.createDataFrame([(x,) for x in left] + [(None,)], "name string"), spark.createDataFrame([(x,) for x in right] + [(None,)], "other string")
    assert rows_of(supply.within_edits(l, r, edits)) == want and want


def test_near_popular_names(spark):
    pair = "ecosystem string, name string"
    popular = spark.createDataFrame([("npm", "lodash"), ("npm", "express"), ("PyPI", "requests"), ("npm", "react")], pair)
    allowed = spark.createDataFrame([("npm", "preact")], pair)
    asked = [("npm", x) for x in ("lodahs", "@evil/lodash", "lodash", "preact", "Expres", "unrelated", "ract", None)] + [("PyPI", "lodahs"), ("PyPI", "reqeusts")]
    got = rows_of(supply.near_popular(spark.createDataFrame(asked, pair), popular, allowed))
    assert got == [("PyPI", "reqeusts", "requests", 1), ("npm", "@evil/lodash", "lodash", 0), ("npm", "expres", "express", 1), ("npm", "lodahs", "lodash", 1), ("npm", "ract", "react", 1)]


def test_near_domains(spark):
    hosts = spark.createDataFrame([(h,) for h in ("goagle.com", "google.com", "registry-2.docker.io", "evil.com", "GITHUB.con", None)], "host string")
    popular = spark.createDataFrame([(h,) for h in ("google.com", "registry-1.docker.io", "github.com", None)], "domain string")
    assert rows_of(supply.near_domains(hosts, popular)) == [("github.con", "github.com", 1), ("goagle.com", "google.com", 1)]
