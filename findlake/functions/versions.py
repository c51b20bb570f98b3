"""Version order of seven ecosystems as sortable text keys: compare the keys with < and >= in plain Spark expressions.

A key is built once per distinct version by a Pandas UDF; versions that don't parse have a null key and are in no range.
Numbers are padded so that text order is number order; every scheme writes a part that sorts pre-releases before the
release. Events of a range are folded into intervals with built-in array functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 12


def number(text: str | int) -> str:
    return str(int(text)).rjust(WIDTH, "0")


def numbers(parts: list[str], least: int = 0) -> str:
    """Padded numbers without trailing zeros, each behind a mark that sorts above the end of the key."""
    values = [int(p) for p in parts]
    while len(values) > least and values and values[-1] == 0:
        values.pop()
    return "".join("5" + number(v) for v in values)


def semver_key(text: str) -> str | None:
    m = re.fullmatch(r"v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", text.strip())
    if not m:
        return None
    core = "".join(number(x or 0) for x in m.groups()[:3])
    if m[4] is None:
        return core + "~"
    return core + "".join("-" + ("1" + number(p) if p.isdigit() else "2" + p + " ") for p in m[4].split("."))


_PEP = re.compile(
    r"v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|beta|preview|pre|a|b|c|rc)[-_.]?(\d*))?(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?", re.I
)
_PHASES = {"alpha": "a", "beta": "b", "c": "rc", "pre": "rc", "preview": "rc"}


def pep440_key(text: str) -> str | None:
    m = _PEP.fullmatch(text.strip().lower())
    if not m:
        return None
    epoch, release, phase, phase_no, post1, post, post2, dev, dev_no, local = m.groups()
    key = number(epoch or 0) + numbers(release.split(".")) + "3"
    posted, developed = post1 is not None or post is not None, dev is not None
    if phase:
        key += {"a": "1", "b": "2", "rc": "3"}[_PHASES.get(phase, phase)] + number(phase_no or 0)
    else:
        key += "0" if developed and not posted else "9"
    key += "1" + number(post1 or post2 or 0) if posted else "0"
    key += "0" + number(dev_no or 0) if developed else "9"
    for part in re.split(r"[-_.]", local) if local else []:
        key += "-2" + number(part) if part.isdigit() else "-1" + part + " "
    return key


_QUALIFIERS = ["alpha", "beta", "milestone", "rc", "snapshot", "", "sp"]
_MAVEN_ALIASES = {"ga": "", "final": "", "release": "", "cr": "rc"}


def maven_key(text: str) -> str | None:
    """Dotted and dashed parts; empty qualifiers and zeros before a dash or the end don't count."""
    if not re.fullmatch(r"[0-9A-Za-z._+-]+", text.strip()) or not text.strip():
        return None
    lists: list[list[str]] = [[]]
    for sep, token in re.findall(r"([.-]?)(\d+|[a-z_+]+)", text.strip().lower()):
        if sep == "-" or (lists[-1] and lists[-1][-1].isdigit() != token.isdigit() and not sep):
            lists.append([])
        lists[-1].append(token)
    out = []
    for parts in lists:
        names = [{"a": "alpha", "b": "beta", "m": "milestone"}.get(p, p) for p in parts]
        names = [_MAVEN_ALIASES.get(p, p) for p in names]
        while names and names[-1] in ("0", ""):
            names.pop()
        out.append(names)
    while out and not out[-1]:
        out.pop()
    key = ""
    for k, names in enumerate(out):
        for j, p in enumerate(names):
            lead = "-" if k and j == 0 else "."
            if p.isdigit():
                key += ("6" if lead == "-" else "7") + number(p)
            elif p in _QUALIFIERS:
                place = _QUALIFIERS.index(p)
                key += ("3" if place < _QUALIFIERS.index("") else "5") + str(place)
            else:
                key += "59" + p + " "
    return key + "4"


def debian_key(text: str) -> str | None:
    m = re.fullmatch(r"(?:(\d+):)?([0-9][A-Za-z0-9.+~-]*)", text.strip())
    if not m:
        return None
    upstream, _, revision = m[2].rpartition("-") if "-" in m[2] else (m[2], "", "0")

    def part(s: str) -> str:
        out = ""
        for letters, digits in re.findall(r"([^0-9]*)([0-9]*)", s):
            if letters or digits:
                out += "".join({"~": "0"}.get(c) or ("2" if c.isalpha() else "3") + c for c in letters) + "1" + number(digits or 0)
        return out + "1"

    return number(m[1] or 0) + part(upstream) + "|" + part(revision)


def gem_key(text: str) -> str | None:
    if not re.fullmatch(r"\s*[0-9]+(\.[0-9A-Za-z]+)*(-[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?\s*", text):
        return None
    parts = re.findall(r"\d+|[a-z]+", text.strip().replace("-", ".pre.").lower() if "-" in text else text.strip().lower())
    head = [p for p in parts]
    cut = next((k for k, p in enumerate(head) if not p.isdigit()), len(head))
    release, rest = head[:cut], head[cut:]
    while release and int(release[-1]) == 0:
        release.pop()
    while rest and rest[-1].isdigit() and int(rest[-1]) == 0:
        rest.pop()
    return "".join("5" + number(p) for p in release) + "".join("1" + p + " " if not p.isdigit() else "5" + number(p) for p in rest) + "3"


def nuget_key(text: str) -> str | None:
    m = re.fullmatch(r"v?(\d+(?:\.\d+){0,3})(?:-([0-9A-Za-z.-]+))?(?:\+.*)?", text.strip())
    if not m:
        return None
    values = (m[1].split(".") + ["0"] * 4)[:4]
    key = "".join(map(number, values))
    if m[2] is None:
        return key + "~"
    return key + "".join("-" + ("1" + number(p) if p.isdigit() else "2" + p.lower() + " ") for p in m[2].split("."))


_STABILITY = {"dev": 0, "alpha": 1, "a": 1, "beta": 2, "b": 2, "rc": 3, "": 4, "patch": 5, "pl": 5, "p": 5}


def composer_key(text: str) -> str | None:
    m = re.fullmatch(r"v?(\d+(?:\.\d+){0,3})(?:[-_.]?(dev|alpha|a|beta|b|rc|patch|pl|p)[-_.]?(\d*))?(?:[-_.]?dev)?", text.strip().lower())
    if not m:
        return None
    values = (m[1].split(".") + ["0"] * 4)[:4]
    return "".join(map(number, values)) + str(_STABILITY[m[2] or ""]) + number(m[3] or 0)


#: Scheme of each ecosystem (lower case).
SCHEMES = {
    "npm": semver_key, "crates.io": semver_key, "cargo": semver_key, "go": semver_key, "pypi": pep440_key, "maven": maven_key,
    "debian": debian_key, "rubygems": gem_key, "nuget": nuget_key, "packagist": composer_key,
}


def key_of(ecosystem: str | None, version: str | None) -> str | None:
    scheme = SCHEMES.get((ecosystem or "").lower())
    return None if scheme is None or version is None else "0" if version == "0" and scheme is not debian_key else scheme(version)


@F.pandas_udf(T.StringType())
def version_key(ecosystem: pd.Series, version: pd.Series) -> pd.Series:
    """Sortable key of a version in its ecosystem; null for unknown ecosystems and versions that don't parse."""
    return pd.Series([key_of(e, v) for e, v in zip(ecosystem, version)], dtype="object")


def intervals(events: Column) -> Column:
    """array<struct<lo, hi, closed>> from ordered events (array<struct<kind, key>>): introduced opens an interval, fixed
    and limit close it before, last_affected behind their version; one that stays open has a null hi.

    A second introduced while one is open changes nothing; an end without a beginning is ignored."""
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<lo:string,hi:string,closed:boolean>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        closes = e["kind"].isin("fixed", "limit", "last_affected") & s["open"].isNotNull()
        item = F.struct(s["open"].alias("lo"), e["key"].alias("hi"), (e["kind"] == "last_affected").alias("closed"))
        return (
            F.when((e["kind"] == "introduced") & s["open"].isNull(), F.struct(e["key"].alias("open"), s["out"].alias("out")))
            .when(closes, F.struct(F.lit(None).cast("string").alias("open"), F.concat(s["out"], F.array(item)).alias("out")))
            .otherwise(s)
        )

    tail = lambda s: F.when(s["open"].isNotNull(), F.concat(s["out"], F.array(F.struct(s["open"].alias("lo"), F.lit(None).cast("string").alias("hi"), F.lit(False).alias("closed"))))).otherwise(s["out"])
    return F.aggregate(F.filter(events, lambda e: e["key"].isNotNull()), start, step, tail)


def in_intervals(key: Column, spans: Column) -> Column:
    below = lambda s: s["hi"].isNull() | (key < s["hi"]) | (s["closed"] & (key == s["hi"]))
    return F.coalesce(F.exists(spans, lambda s: (key >= s["lo"]) & below(s)), F.lit(False))


def affected(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """dep_id, osv_id of the advisories whose listed versions or ranges hold a dependency's version.

    dependencies(dep_id, ecosystem, name, version), advisories(osv_id, ecosystem, name, versions array, spans array). An
    equi-join on ecosystem and name; the range is checked on the joined rows."""
    keyed = dependencies.withColumn("key", version_key("ecosystem", "version"))
    met = keyed.join(advisories, ["ecosystem", "name"])
    listed = F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False))
    return met.where(listed | in_intervals(F.col("key"), F.col("spans"))).select("dep_id", "osv_id").distinct()
