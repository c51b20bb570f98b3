"""Sinks: result tables as SARIF, CycloneDX, SPDX, OSV, Markdown and CSV, and keyed appends.

Documents are built with nested aggregates per document (a run, a target), in the executors; only small reports are
formatted on the driver, where noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sarif(findings: DataFrame, by: str, tool: str) -> DataFrame:
    """by, document: one SARIF 2.1.0 document per group with its distinct rules and its results.

    findings(by, rule, level, message, uri, line[, properties map])."""
    region = F.struct(F.col("line").alias("startLine"))
    place = F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    fields = [F.col("rule").alias("ruleId"), F.col("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations")]
    if "properties" in findings.columns:
        fields.append(F.col("properties"))
    results = F.sort_array(F.collect_list(F.struct(F.col("uri").alias("_u"), F.col("line").alias("_l"), F.to_json(F.struct(*fields)).alias("r"))))
    rules = F.transform(F.sort_array(F.collect_set("rule")), lambda r: F.to_json(F.struct(r.alias("id"))))
    grouped = findings.groupBy(by).agg(results.alias("r"), rules.alias("rules"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    document = F.concat(
        F.lit('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"' + tool + '","rules":'),
        listed(F.col("rules")), F.lit('}},"results":'), listed(F.transform("r", lambda x: x["r"])), F.lit("}]}"),
    )
    return grouped.select(by, document.alias("document"))


def cyclonedx(components: DataFrame, by: str) -> DataFrame:
    """by, document: components distinct by purl, as CycloneDX 1.5. components(by, name, version, purl)."""
    unique = components.groupBy(by, "purl").agg(F.min(F.struct("name", "version")).alias("c"))
    listed = F.sort_array(F.collect_list(F.struct("purl", F.col("c.name").alias("name"), F.col("c.version").alias("version"))))
    parts = F.transform(listed, lambda c: F.struct(F.lit("library").alias("type"), c["name"].alias("name"), c["version"].alias("version"), c["purl"].alias("purl"), c["purl"].alias("bom-ref")))
    return unique.groupBy(by).agg(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), parts.alias("components"))).alias("document"))


def spdx(components: DataFrame, by: str) -> DataFrame:
    """by, document: packages and DESCRIBES relationships, as SPDX 2.3. components(by, name, version, purl)."""
    ref = F.concat(F.lit("SPDXRef-"), F.substring(F.sha2("purl", 256), 1, 16))
    unique = components.groupBy(by, "purl").agg(F.min(F.struct("name", "version")).alias("c")).select(by, F.struct(ref.alias("SPDXID"), F.col("c.name").alias("name"), F.col("c.version").alias("versionInfo")).alias("p"))
    packages = F.sort_array(F.collect_list("p"))
    relations = F.transform(packages, lambda p: F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), p["SPDXID"].alias("relatedSpdxElement")))
    return unique.groupBy(by).agg(F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.col(by).cast("string").alias("name"), packages.alias("packages"), relations.alias("relationships"))).alias("document"))


def osv(advisory_id: Column, modified: Column, aliases: Column, package: Column, introduced: Column, fixed: Column) -> Column:
    """One OSV 1.6 record as JSON."""
    events = F.array_compact(F.array(F.create_map(F.lit("introduced"), F.coalesce(introduced, F.lit("0"))), F.when(fixed.isNotNull(), F.create_map(F.lit("fixed"), fixed))))
    ranges = F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), events.alias("events")))
    return F.to_json(F.struct(F.lit("1.6.0").alias("schema_version"), advisory_id.alias("id"), modified.alias("modified"), aliases.alias("aliases"), F.array(F.struct(package.alias("package"), ranges.alias("ranges"))).alias("affected")))


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet table at path has not yet (content-addressed, idempotent); their number."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh = fresh.persist()
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_each(df: DataFrame, path: str, key: str) -> None:
    """One JSON file per key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table (formatted on the driver, at most `limit` rows: a report's top)."""
    rows = df.limit(limit).collect()
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    head = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(r) + " |" for r in head)
