"""Detectors over manifest and source text: each is a predicate that names what it saw. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Detector -> (file name pattern, content pattern).
DETECTORS = {
    "install_hook": (r"(^|/)package\.json$", r'"(?:pre|post)?install"\s*:\s*"[^"]+"'),
    "composer_hook": (r"(^|/)composer\.json$", r'"(?:pre|post)-(?:install|update|autoload-dump)[\w-]*"\s*:'),
    "build_script": (r"(^|/)build\.rs$", r"Command::new|std::process"),
    "setup_hook": (r"(^|/)setup\.py$", r"cmdclass\s*=|subprocess|os\.system"),
    "gem_hook": (r"(^|/)(extconf|mkrf_conf)\.rb$", r"\bsystem\b|`|Kernel\.exec"),
    "import_time_execution": (r"(^|/)__init__\.py$", r"(?m)^(?:exec|eval|subprocess|os\.system|__import__)\b"),
    "piped_download": (r"", r"(?:curl|wget)\s[^\n|]*\|\s*(?:ba|z)?sh"),
    "encoded_payload": (r"", r"(?:base64\s+-d|b64decode|atob)\s*\(?[^\n]{0,40}(?:exec|eval|sh\b)|(?:exec|eval)\s*\([^\n]{0,40}(?:b64decode|atob)"),
    "mutable_action": (r"(^|/)\.github/workflows/", r"uses:\s*[\w.-]+/[\w./-]+@(?:main|master|latest)\b"),
    "git_dependency": (r"(^|/)package\.json$", r'"(?:git\+|github:)[^"]+"'),
}


def detected(path: Column, text: Column) -> Column:
    """array<string> of the detectors that fire on a file."""
    return F.array_compact(F.array(*[F.when(path.rlike(f) & text.rlike(t) if f else text.rlike(t), F.lit(name)) for name, (f, t) in DETECTORS.items()]))


def yanked(dependencies: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Dependencies whose exact version was withdrawn: a semi join on ecosystem, name and version."""
    return dependencies.join(withdrawn.select("ecosystem", "name", "version").distinct(), ["ecosystem", "name", "version"], "left_semi")


def majors_behind(dependencies: DataFrame, latest: DataFrame, least: int = 2) -> DataFrame:
    """Dependencies at least so many major versions behind the latest: latest(ecosystem, name, version)."""
    major = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    top = latest.groupBy("ecosystem", "name").agg(F.max(major(F.col("version"))).alias("_top"))
    rows = dependencies.join(top, ["ecosystem", "name"]).withColumn("behind", F.col("_top") - major(F.col("version")))
    return rows.where(F.col("behind") >= least).drop("_top")


def moved_refs(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, ref, old, new of the tags that name another commit than before (name, ref, sha)."""
    a = before.select("name", "ref", F.col("sha").alias("old"))
    b = after.select("name", "ref", F.col("sha").alias("new"))
    return a.join(b, ["name", "ref"]).where("old <> new")
