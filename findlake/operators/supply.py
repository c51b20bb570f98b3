"""Supply-chain operators: one finding per advisory, alias merge, smallest fix, lockfile drift, names and hosts that are
nearly those of popular ones.

Near names share, by at most k edits (insertions, deletions, substitutions, swaps of neighbours), a form with at most k
characters deleted from each, so an equality on such forms loses no pair and no pairs are formed beyond it; names longer
than the longest popular one by more than k have no forms at all. Null keys never match; repeated rows count once; empty
inputs give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions import text
from findlake.functions.versions import version_key


def merge_aliases(met: DataFrame, aliases: DataFrame) -> DataFrame:
    """ecosystem, name, finding, primary_id, osv_id, score: the advisories of each dependency, those whose sets of CVE
    aliases are equal merged to one finding (an advisory without such aliases is a finding of its own).

    met(ecosystem, name, osv_id, score), aliases(osv_id, alias). The primary is the one with the highest score (null as 0),
    of equals a GHSA record, then the smallest id; all are kept as rows. Sets are compared by their sorted members."""
    cves = aliases.where(F.upper("alias").startswith("CVE-")).groupBy("osv_id").agg(F.array_join(F.array_sort(F.collect_set(F.upper("alias"))), " ").alias("cves"))
    rows = met.groupBy("ecosystem", "name", "osv_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    keyed = rows.join(cves, "osv_id", "left").withColumn("finding", F.coalesce("cves", "osv_id"))
    rank = F.struct((-F.col("score")).alias("s"), (~F.col("osv_id").startswith("GHSA-")).alias("g"), "osv_id")
    primary = keyed.groupBy("ecosystem", "name", "finding").agg(F.min(rank).alias("m")).select("ecosystem", "name", "finding", F.col("m.osv_id").alias("primary_id"))
    return keyed.join(primary, ["ecosystem", "name", "finding"]).select("ecosystem", "name", "finding", "primary_id", "osv_id", "score")


def smallest_fix(fixes: DataFrame) -> DataFrame:
    """ecosystem, name, osv_id, fixed_version: the least fixed version in the order of the ecosystem; versions that don't
    parse count only where none does, then the least text. fixes(ecosystem, name, osv_id, fixed)."""
    keyed = fixes.where("fixed is not null").distinct().withColumn("key", version_key("ecosystem", "fixed"))
    least = F.min(F.struct(F.col("key").isNull().alias("n"), "key", "fixed")).alias("m")
    return keyed.groupBy("ecosystem", "name", "osv_id").agg(least).select("ecosystem", "name", "osv_id", F.col("m.fixed").alias("fixed_version"))


def lockfile_drift(deps: DataFrame) -> DataFrame:
    """ecosystem, directory, name, pinned, locked: exact pins of a manifest that the lockfile of its directory resolves
    otherwise. deps(ecosystem, declared_in, name, version, is_lockfile, pin_style, position): the first row of each side
    counts; versions are equal if their keys in the ecosystem are (their texts where a key is missing)."""
    directory = F.regexp_replace(F.regexp_replace("declared_in", r"\\", "/"), r"/?[^/]*$", "")
    row = F.struct("position", "version", "pin_style")
    side = lambda locked: F.min(F.when(F.coalesce("is_lockfile", F.lit(False)) == locked, row))
    firsts = deps.groupBy("ecosystem", directory.alias("directory"), "name").agg(side(False).alias("a"), side(True).alias("b"))
    both = firsts.select("ecosystem", "directory", "name", F.col("a.version").alias("pinned"), F.col("b.version").alias("locked"), F.col("a.pin_style").alias("pin_style"))
    usable = both.where("pin_style = 'exact' and pinned <> '' and locked <> ''")
    keyed = usable.withColumns({"x": version_key("ecosystem", "pinned"), "y": version_key("ecosystem", "locked")})
    return keyed.where(F.coalesce(F.col("x") != F.col("y"), F.col("pinned") != F.col("locked"))).select("ecosystem", "directory", "name", "pinned", "locked")


def deletion_forms(name: Column, edits: int) -> Column:
    """The name and its forms with up to `edits` characters deleted, each once."""
    forms = F.array(name)
    for _ in range(edits):
        cut = F.transform(forms, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda k: F.concat(F.substr(x, F.lit(1), k - 1), F.substr(x, k + 1))))
        forms = F.array_distinct(F.concat(forms, F.flatten(cut)))
    return forms


def within_edits(left: DataFrame, right: DataFrame, edits: int) -> DataFrame:
    """name, other, distance of all pairs at most `edits` apart. left(name), right(other): the right side is the list."""
    longest = right.agg(F.coalesce(F.max(F.length("other")), F.lit(0)).alias("longest"))
    short = left.select("name").where("name is not null").distinct().crossJoin(longest).where(F.length("name") <= F.col("longest") + edits).select("name")  # one row
    a = short.select("name", F.explode(deletion_forms(F.col("name"), edits)).alias("form"))
    b = right.select("other").where("other is not null").distinct().select("other", F.explode(deletion_forms(F.col("other"), edits)).alias("form"))
    pairs = a.join(b, "form").select("name", "other").distinct()
    return pairs.withColumn("distance", text.osa(edits + 1)("name", "other")).where(F.col("distance") <= edits)


def near_popular(names: DataFrame, popular: DataFrame, allowed: DataFrame, edits: int = 2) -> DataFrame:
    """ecosystem, name, nearest, distance of names that are nearly a popular one of their ecosystem.

    names, popular, allowed (ecosystem, name), in any case. Popular and allowed names are none; the part of a scoped name
    (@scope/part) behind the scope is looked up too, and if it is a popular name as it is the distance is 0. The least
    distance wins, of equals the smaller name."""
    low = lambda df: df.select("ecosystem", F.lower("name").alias("name")).where("name is not null").distinct()
    asked = low(names).join(low(popular).unionByName(low(allowed)), ["ecosystem", "name"], "left_anti")
    bare = F.regexp_extract("name", r"^@[^/]*/(.+)$", 1)
    forms = asked.select("ecosystem", "name", F.explode(F.array_distinct(F.array(F.col("name"), F.when(bare != "", bare).otherwise(F.col("name"))))).alias("written"))
    known = low(popular)
    near = within_edits(forms.select(F.col("written").alias("name")), known.select(F.col("name").alias("other")), edits).withColumnRenamed("name", "written")
    hits = forms.join(near, "written").join(known.withColumnRenamed("name", "other"), ["ecosystem", "other"])
    best = hits.groupBy("ecosystem", "name").agg(F.min(F.struct("distance", "other")).alias("m"))
    return best.select("ecosystem", "name", F.col("m.other").alias("nearest"), F.col("m.distance").alias("distance"))


def near_domains(hosts: DataFrame, popular: DataFrame, edits: int = 2) -> DataFrame:
    """host, nearest, distance of hosts that are nearly, but not, a popular one; hosts of three labels or more that differ
    from it in the first label only are of the same site. hosts(host), popular(domain)."""
    known = popular.select(F.lower("domain").alias("other")).distinct()
    asked = hosts.select(F.lower("host").alias("name")).distinct().join(known.withColumnRenamed("other", "name"), "name", "left_anti")
    rest = lambda c: F.regexp_replace(c, r"^[^.]*\.", "")
    labels = lambda c: F.size(F.split(c, r"\."))
    same_site = (labels("name") >= 3) & (labels("other") >= 3) & (rest("name") == rest("other"))
    near = within_edits(asked, known, edits).where(~same_site)
    return near.groupBy(F.col("name").alias("host")).agg(F.min(F.struct("distance", "other")).alias("m")).select("host", F.col("m.other").alias("nearest"), F.col("m.distance").alias("distance"))
