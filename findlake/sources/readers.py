"""Readers: files of the domain's formats into flat tables. Built-in readers and expressions wherever they can express the
format; rows that are not well-formed are skipped or marked, never fatal. A missing path gives an empty table.

Text formats are read line by line with a carried header where a line needs the one above it (lcov, gcov reports), so a
file of any size is split like any other text."""

from __future__ import annotations

import sqlite3
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One document per file as `doc` (variant); NaN and Infinity are rejected, invalid files give null."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    doc = F.try_parse_json("value") if schema is None else F.from_json("value", schema, {"allowNonNumericNumbers": "false"})
    return files.select("file", doc.alias("doc"))


def jsonc(text: Column, schema: str) -> Column:
    """JSON with comments."""
    return F.from_json(text, schema, {"allowComments": "true", "allowNonNumericNumbers": "false"})


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per whole line; blank, malformed and cut lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("allowNonNumericNumbers", False).json(path)


def findings(spark: SparkSession, path: str) -> DataFrame:
    """file, finding (variant): a bare list, or the list under `findings` or `results`."""
    doc = json_documents(spark, path)
    lists = [F.try_variant_get("doc", p, "array<variant>") for p in ("$", "$.findings", "$.results")]
    return doc.select("file", F.explode(F.coalesce(*lists)).alias("finding"))


SARIF = (
    "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>,"
    "codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>>>>>>"
)


def sarif_results(spark: SparkSession, path: str) -> DataFrame:
    """file, tool, rule, level, message, uri, start_line, end_line, steps: one row per result; steps of its first code flow."""
    docs = json_documents(spark, path, SARIF)
    runs = docs.select("file", F.explode("doc.runs").alias("run"))
    rows = runs.select("file", F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    place = F.try_element_at("r.locations", F.lit(1))["physicalLocation"]
    flow = F.try_element_at(F.try_element_at("r.codeFlows", F.lit(1))["threadFlows"], F.lit(1))["locations"]
    steps = F.transform(flow, lambda s: F.struct(s["location"]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), s["location"]["physicalLocation"]["region"]["startLine"].alias("line")))
    return rows.select(
        "file", "tool", F.col("r.ruleId").alias("rule"), F.coalesce("r.level", F.lit("warning")).alias("level"), F.col("r.message.text").alias("message"),
        place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line"), F.coalesce(place["region"]["endLine"], place["region"]["startLine"]).alias("end_line"), steps.alias("steps"),
    )


def dataflows(results: DataFrame) -> DataFrame:
    """Results with a path: source, sink and the steps between; results without one are skipped."""
    n = F.size("steps")
    return results.where(n >= 2).select("*", F.element_at("steps", 1).alias("source"), F.element_at("steps", -1).alias("sink"), F.slice("steps", 2, n - 2).alias("between"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("report"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def _down(pattern: str) -> Column:
    found = F.regexp_extract("line", pattern, 1)
    return F.last(F.when(F.col("line").rlike(pattern), found), True).over(Window.partitionBy("report").orderBy("pos"))


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """file, line: executed lines of lcov records (SF: headers carried down to DA: rows)."""
    rows = _lines(spark, path).withColumn("file", _down(r"^SF:(.+)$")).where(F.col("line").rlike(r"^DA:\d+,[1-9]"))
    return rows.select("file", F.regexp_extract("line", r"^DA:(\d+)", 1).try_cast("int").alias("line")).where("file is not null").distinct()


def gcov(spark: SparkSession, path: str) -> DataFrame:
    """file, line: executed lines of .gcov listings."""
    rows = _lines(spark, path).withColumn("file", _down(r"^\s*-:\s*0:Source:(.+)$"))
    hit = rows.where(F.col("line").rlike(r"^\s*[1-9]\d*\*?:\s*\d+:"))
    return hit.select("file", F.regexp_extract("line", r"^\s*[1-9]\d*\*?:\s*(\d+):", 1).try_cast("int").alias("line")).where("file is not null").distinct()


def gcov_functions(spark: SparkSession, path: str) -> DataFrame:
    """file, function, reached of `gcov -f` reports: a function's lines follow its header, the file comes after them."""
    rows = _lines(spark, path).where("line <> ''")
    name, share = F.regexp_extract("line", r"^Function '(.+)'$", 1), F.regexp_extract("line", r"^Lines executed:([\d.]+)%", 1)
    ahead = Window.partitionBy("report").orderBy("pos")
    file = F.first(F.when(F.col("line").rlike("^File '"), F.regexp_extract("line", "^File '(.+)'$", 1)), True).over(ahead.rowsBetween(0, Window.unboundedFollowing))
    marked = rows.select(name.alias("function"), F.lead(share).over(ahead).alias("share"), file.alias("file")).where("function <> ''")
    return marked.select("file", "function", (F.coalesce(F.col("share").try_cast("double"), F.lit(0.0)) > 0).alias("reached"))


def coverage_py(spark: SparkSession, path: str) -> DataFrame:
    """file, line: executed lines of coverage.py's JSON."""
    docs = json_documents(spark, path, "files map<string,struct<executed_lines:array<int>>>")
    return docs.select(F.explode("doc.files").alias("file", "f")).select("file", F.explode("f.executed_lines").alias("line")).distinct()


#: Coverage formats: the content that tells each, and its reader.
COVERAGE = {"lcov": (r"(?m)^SF:", lcov), "gcov": (r"(?m)^\s*-:\s*0:Source:", gcov), "coverage.py": (r'"executed_lines"', coverage_py)}


def coverage_format(text: Column) -> Column:
    """The coverage format that a file's content is in, null for none."""
    out = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(COVERAGE.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def expected_results(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """test, category, real, cwe of a benchmark's expected results: comments and other prefixes left out."""
    rows = spark.read.option("comment", "#").schema("test string, category string, real string, cwe int").csv(path)
    return rows.where(F.trim("test").startswith(prefix)).select(F.trim("test").alias("test"), "category", (F.lower(F.trim("real")) == "true").alias("real"), "cwe")


def stanzas(spark: SparkSession, path: str, separator: str = "\n\n") -> DataFrame:
    """fields map<string,string> of blank-separated `Key: value` stanzas (dpkg status, apk databases)."""
    rows = spark.read.option("lineSep", separator).text(path).where(F.trim("value") != "")
    entries = F.transform(F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^[A-Za-z][\w-]*:")), lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("key"), F.trim(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1)).alias("value")))
    return rows.select(F.map_from_entries(F.filter(entries, lambda e: e["key"] != "")).alias("fields"))


def dpkg(spark: SparkSession, path: str) -> DataFrame:
    """name, version, architecture of installed packages."""
    f = stanzas(spark, path)
    ok = F.coalesce(F.col("fields")["Status"], F.lit("install ok installed")).endswith(" installed")
    return f.where(ok & F.col("fields")["Package"].isNotNull()).select(F.col("fields")["Package"].alias("name"), F.col("fields")["Version"].alias("version"), F.col("fields")["Architecture"].alias("architecture"))


def apk(spark: SparkSession, path: str) -> DataFrame:
    f = stanzas(spark, path)
    return f.where(F.col("fields")["P"].isNotNull()).select(F.col("fields")["P"].alias("name"), F.col("fields")["V"].alias("version"), F.col("fields")["A"].alias("architecture"))


def cyclonedx(spark: SparkSession, path: str) -> DataFrame:
    """name, version, purl, ecosystem of the components; those without a name are left out."""
    docs = json_documents(spark, path, "components array<struct<name:string,version:string,purl:string>>")
    rows = docs.select(F.inline("doc.components")).where("name is not null")
    kind = F.regexp_extract("purl", "^pkg:([^/]+)/", 1)
    return rows.select("name", "version", "purl", F.when(kind != "", kind).alias("ecosystem"))


def image_layers(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, digest, size of the layers of image manifests."""
    docs = json_documents(spark, path, "layers array<struct<digest:string,size:bigint,mediaType:string>>")
    return docs.select("file", F.posexplode("doc.layers").alias("ordinal", "l")).select("file", "ordinal", F.col("l.digest").alias("digest"), F.col("l.size").alias("size"))


def image_platforms(spark: SparkSession, path: str) -> DataFrame:
    """file, digest, os, architecture, variant of the entries of image indexes."""
    docs = json_documents(spark, path, "manifests array<struct<digest:string,platform:struct<os:string,architecture:string,variant:string>>>")
    return docs.select("file", F.inline("doc.manifests")).select("file", "digest", "platform.*")


def hunks(text: Column) -> Column:
    """array<struct<old_start, old_lines, new_start, new_lines>> of a unified diff; missing counts are 1."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^(@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"), F.lit(1))
    part = lambda h, k: F.coalesce(F.nullif(F.regexp_extract(h, r"-(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))?", k), F.lit("")), F.lit("1")).try_cast("int")
    return F.transform(heads, lambda h: F.struct(part(h, 1).alias("old_start"), part(h, 2).alias("old_lines"), part(h, 3).alias("new_start"), part(h, 4).alias("new_lines")))


def diff_functions(text: Column) -> Column:
    """Distinct function names in the hunk headers of a diff."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^@@ [^@]*@@.*?(\w+)\s*\("), F.lit(1)))


def dockerfile(text: Column) -> Column:
    """array<struct<opcode, args>> of the instructions in order; continued lines joined, comments left out."""
    joined = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*#.*(\r?\n|$)", ""), r"\\[ \t]*\r?\n", " ")
    rows = F.filter(F.split(joined, r"\r?\n"), lambda x: x.rlike(r"^\s*[A-Za-z]+\s"))
    return F.transform(rows, lambda x: F.struct(F.upper(F.regexp_extract(x, r"^\s*([A-Za-z]+)", 1)).alias("opcode"), F.trim(F.regexp_extract(x, r"^\s*[A-Za-z]+\s+(.*)$", 1)).alias("args")))


def definitions(text: Column) -> Column:
    """Names of the C functions and macros that a header declares or defines."""
    functions = F.regexp_extract_all(text, F.lit(r"(?m)^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;{}]*\)\s*[;{]"), F.lit(1))
    macros = F.regexp_extract_all(text, F.lit(r"(?m)^\s*#\s*define\s+(\w+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_union(functions, macros)))


def crashes(spark: SparkSession, path: str) -> DataFrame:
    """name, input_hash, fields: crash files by name (`id:000,sig:11,src:3`), one per content (the first by name)."""
    rows = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("input_hash"))
    kept = rows.groupBy("input_hash").agg(F.min("name").alias("name"))
    return kept.select("name", "input_hash", F.str_to_map("name", F.lit(","), F.lit(":")).alias("fields"))


#: Bytes of a member from which its text isn't read (a value of a column can't hold more than 2 GB).
MAX_BYTES = 1 << 30


def _members(name: str, content: bytes, suffix: str, max_bytes: int) -> Iterator[tuple[str, int, str | None]]:
    """(member, its size, its text or None if it is larger than max_bytes) of a zip or tar archive, packed or not."""
    if zipfile.is_zipfile(BytesIO(content)):
        with zipfile.ZipFile(BytesIO(content)) as z:
            for info in z.infolist():
                if info.filename.endswith(suffix) and not info.is_dir():
                    yield info.filename, info.file_size, z.read(info).decode("utf-8", "replace") if info.file_size <= max_bytes else None
    else:
        with tarfile.open(fileobj=BytesIO(content)) as t:
            for info in t:
                if info.isfile() and info.name.endswith(suffix):
                    yield info.name, info.size, t.extractfile(info).read().decode("utf-8", "replace") if info.size <= max_bytes else None


def archive_members(spark: SparkSession, path: str, suffix: str = "", max_bytes: int = MAX_BYTES) -> DataFrame:
    """archive, member, bytes, text of all members with a suffix, however many there are; a member larger than max_bytes
    has a null text, an archive that can't be read (on) a row with a null member."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")
    columns = ["archive", "member", "bytes", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["archive"], pdf["content"]):
                out, held = [], 0
                try:
                    for member, size, body in _members(archive, content, suffix, max_bytes):
                        out.append((archive, member, size, body))
                        held += size
                        if held > 64 << 20:
                            yield pd.DataFrame(out, columns=columns)
                            out, held = [], 0
                except (zipfile.BadZipFile, tarfile.TarError, RuntimeError, OSError, EOFError, zlib.error):
                    out.append((archive, None, None, None))
                yield pd.DataFrame(out, columns=columns)

    return files.mapInPandas(run, "archive string, member string, bytes long, text string")


def zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member, text of the members with a suffix; unreadable archives give none."""
    return archive_members(spark, path, suffix).where("member is not null").select("archive", "member", "text")


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """file and the columns of the schema of a table in SQLite files, a task per file; columns that a file's table lacks
    are null, a file without the table or that is no database gives no rows. Databases are read from memory, rows in
    batches."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    types = spark.createDataFrame([], schema).schema
    columns = [f.name for f in types]
    quoted = '"' + name.replace('"', '""') + '"'

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"]):
                con = sqlite3.connect(":memory:")
                try:
                    con.deserialize(content)
                    rows = con.execute(f"SELECT * FROM {quoted}")
                    place = {d[0]: k for k, d in enumerate(rows.description)}
                    while part := rows.fetchmany(10_000):
                        yield pd.DataFrame({"file": [file] * len(part)} | {c: pd.Series([r[place[c]] if c in place else None for r in part], dtype="object") for c in columns})
                except sqlite3.DatabaseError:
                    pass
                finally:
                    con.close()

    return files.mapInPandas(run, "file string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types))


def or_empty(read, schema: str, spark: SparkSession) -> DataFrame:  # noqa: ANN001
    """What the reader gives, or an empty table if its path does not exist."""
    try:
        return read()
    except AnalysisException:
        return spark.createDataFrame([], schema)
