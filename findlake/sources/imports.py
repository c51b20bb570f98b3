"""Imports and calls in source text, per language, and what they say about a project's dependencies.

Patterns run over the text without comments and strings where that matters little (they are anchored to the beginning of
a line), as built-in expressions; names are reduced to what a package is called by. A dependency is `imported`, or
`not_imported` in a project with sources of its language, or `unknown` without any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each language imports (group 1 is the name), and its ecosystem.
IMPORTS = {
    "python": (r"(?m)^\s*(?:from|import)\s+([A-Za-z_]\w*)", "PyPI"),
    "javascript": (r"""(?:\bfrom\s+|\brequire\s*\(\s*|\bimport\s*\(?\s*)['"]((?:@[\w.-]+/)?[\w.-]+)""", "npm"),
    "go": (r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w.-]+\.[a-z]+/[^"]+)"\s*$""", "Go"),
    "java": (r"(?m)^\s*import\s+(?:static\s+)?([a-z][\w]*(?:\.[a-z]\w*)*)", "Maven"),
    "ruby": (r"""(?m)^\s*require\s+['"]([\w./-]+)['"]""", "RubyGems"),
    "php": (r"(?m)^\s*use\s+\\?([A-Z]\w*(?:\\[A-Z]\w*)?)", "Packagist"),
    "rust": (r"(?m)^\s*(?:pub\s+)?(?:use|extern\s+crate)\s+(?:::)?([a-z_]\w*)", "crates.io"),
    "csharp": (r"(?m)^\s*using\s+(?:static\s+)?([A-Z]\w*(?:\.[A-Z]\w*)*)\s*;", "NuGet"),
}
EXTENSIONS = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "mjs": "javascript", "go": "go", "java": "java", "kt": "java", "rb": "ruby", "php": "php", "rs": "rust", "cs": "csharp"}


def source_language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))


def imported_names(text: Column, language: Column) -> Column:
    """Distinct names that a source file imports; an empty array for other languages."""
    out = F.array().cast("array<string>")
    for name, (pattern, _) in IMPORTS.items():
        out = F.when(language == name, F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).otherwise(out)
    return out


def called_functions(text: Column) -> Column:
    """Distinct `receiver.function` calls, for function-level reachability."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*\.[A-Za-z_]\w*)\s*\("), F.lit(1)))


def plain_name(name: Column) -> Column:
    """Lower case without joins, so that a package and its module meet."""
    return F.regexp_replace(F.lower(name), r"[-_.\\]+", "")


def import_rows(files: DataFrame, path: str = "file", text: str = "text") -> DataFrame:
    """file, language, ecosystem, name of each import."""
    ecosystems = F.create_map(*[F.lit(x) for k, (_, e) in IMPORTS.items() for x in (k, e)])
    lang = source_language(F.col(path))
    rows = files.select(F.col(path).alias("file"), lang.alias("language"), F.explode(imported_names(F.col(text), lang)).alias("name"))
    return rows.withColumn("ecosystem", F.try_element_at(ecosystems, F.col("language")))


def reachability(dependencies: DataFrame, imports: DataFrame) -> DataFrame:
    """dependencies with `reach`: by equality of plain names; a Go, Java or C# import also meets its leading parts."""
    parts = F.split("name", r"[/.]")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    keys = F.when(F.col("ecosystem").isin("Go", "Maven", "NuGet"), leads).otherwise(F.array("name"))
    used = imports.select("ecosystem", F.explode(keys).alias("k")).select("ecosystem", F.regexp_replace(plain_name(F.col("k")), "/", "").alias("k")).distinct().withColumn("_used", F.lit(True))
    known = imports.select("ecosystem").distinct().withColumn("_known", F.lit(True))
    group = F.when(F.col("ecosystem") == "Maven", F.regexp_replace("name", ":.*$", "")).otherwise(F.col("name"))
    keyed = dependencies.withColumn("k", F.regexp_replace(plain_name(group), "/", ""))
    state = F.when(F.col("_used"), "imported").when(F.col("_known"), "not_imported").otherwise("unknown")
    return keyed.join(used, ["ecosystem", "k"], "left").join(known, "ecosystem", "left").select(*dependencies.columns, state.alias("reach"))
