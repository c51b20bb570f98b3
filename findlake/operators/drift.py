"""Schemas that drift between the files of a feed: a report of every change, and one consistent table.

1. Every whole line becomes (field, type) rows, which give the columns of each file and their types.
2. Columns that vanished or came between consecutive files are profiled further by a sketch of (record key, content) for
   the K record keys with the smallest hashes. Content is the field's scalar leaves in one notation, so it survives a
   change of type (a number as text, a flag as 0/1, an object packed as text or into a list). The sampling is
   coordinated: the same records are kept in every file, so sketches of two files can be compared record by record;
   files repeat part of their predecessor's records.
3. The fields that vanished and those that came are matched by a maximum-weight bipartite matching. The weight of a pair
   is the evidence that their content goes on: the agreement on common records, counted in bits by how rare the agreeing
   values are, helped by the likeness of the values and of the names.
4. Matched pairs are renames; the rest are added and removed fields; a changed type is a retype.
5. The one table has a column per lineage of renames: a field keeps its first name in the feed; a name that is taken up
   again while its column goes on under another name is a column of its own, `name@file`. Each column has one type in its
   feed, the most frequent one, and values of other types are converted to it; the text of a value that can't be is kept
   beside the row.

Scale: one pass for types, one for the content of the columns in question with a map-side limit to K rows per column (a
window group limit), then batches of about PAIRS pairs of files' profiles, i.e. 2 x fields x K rows a pair, whatever the
size of a file; the matching never sees more.

Defined cases: lines that are null, not whole or not objects don't count; a null value shows that a field is there
but has no type; lines sent twice count once per record key; a field with several types has its most frequent one.
An empty table gives an empty report.
"""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.session import bounded, written

#: Records kept in the sketch of each column.
K = 128
#: Least share of common records on which a renamed field agrees, least bits of evidence, and least likeness of names
#: where the values tell nothing (constant columns).
AGREE, BITS, NAMES = 0.8, 3.0, 0.55
#: Common records on which two columns must agree without exception where the values are too common to tell more.
ALL_AGREE = 3
#: File pairs that are compared in one call.
PAIRS = 100
RECORD_KEYS = ("finding_id", "function_id")


def _type(variant: Column) -> Column:
    kind = F.schema_of_variant(variant)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", None).otherwise("number")
    )


def content(text: Column) -> Column:
    """The scalar leaves in a JSON text in one notation: no keys, lower case, numbers as doubles, flags as 0/1."""
    leaves = F.split(F.lower(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"\s*:', "")), r'[\[\]{},"\\]+')
    flag = F.transform(F.filter(leaves, lambda x: F.trim(x) != ""), lambda x: F.when(x == "true", "1").when(x == "false", "0").otherwise(F.trim(x)))
    number = F.transform(flag, lambda x: F.coalesce(F.regexp_replace(x, r"^[a-z]+-(?=\d+$)", "").try_cast("double").cast("string"), x))
    plain = F.array_join(F.filter(number, lambda x: x != "null"), "\x1f")
    return F.regexp_replace(plain, r"^(\d+\.0)(?:\x1f0\.0)+$", "$1")


def scalar(text: Column) -> Column:
    """The content of one scalar without brackets, quotes and commas: the same as `content`, without arrays."""
    s = F.lower(F.trim(text))
    number = F.regexp_replace(s, r"^[a-z]+-(?=\d+$)", "").try_cast("double").cast("string")
    return F.coalesce(number, F.when(s == "true", "1.0").when(s == "false", "0.0").otherwise(s))


def fields(raw: DataFrame, record_keys: tuple[str, ...] = RECORD_KEYS) -> DataFrame:
    """feed, file_name, written_at, line_no, record, field, type, _v: a row per top-level field of each whole line."""
    lines = raw.select("feed", "file_name", "written_at", "line_no", F.try_parse_json("body").alias("v"))
    key = F.coalesce(*[F.try_variant_get("v", f"$['{k}']", "string") for k in record_keys])
    keyed = lines.withColumn("record", key)  # what is no object has no keys, so it drops out below without being parsed twice
    exploded = keyed.lateralJoin(keyed.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return exploded.where(F.col("key").isNotNull() & ~F.col("key").isin(*record_keys)).select("feed", "file_name", "written_at", "line_no", "record", F.col("key").alias("field"), _type(F.col("value")).alias("type"), F.col("value").alias("_v"))


def with_content(rows: DataFrame, asked: Column) -> DataFrame:
    """rows of `fields` with content in place of _v; rows for which `asked` isn't true have none."""
    plain = F.when(F.col("type") == "string", F.try_variant_get("_v", "$", "string"))
    text = F.when(F.col("type").isNull(), None).otherwise(F.to_json("_v"))
    rows = rows.select("feed", "file_name", "record", "field", "type", text.alias("text"), plain.alias("plain"), asked.alias("asked"))
    inner = F.when(F.col("plain").rlike(r"^\s*[\[{]"), F.to_json(F.try_parse_json("plain")))
    simple = F.coalesce("plain", F.when(~F.col("type").isin("array", "object"), F.col("text")))
    nested = simple.isNull() | simple.rlike(r'[\[\]{},"\\]')
    value = F.when(nested, content(F.coalesce(inner, F.col("text")))).otherwise(scalar(simple))
    return rows.select("feed", "file_name", "record", "field", F.when(F.col("asked"), value).alias("content"))


def column_types(rows: DataFrame) -> DataFrame:
    """feed, file_name, field, written_at, type, types: the type of each column of each file, and how often it has each."""
    by_type = rows.groupBy("feed", "file_name", "field", "type").agg(F.count("*").alias("n"), F.max("written_at").alias("written_at"))
    main = F.max_by("type", F.when(F.col("type").isNotNull(), F.struct("n", "type")))
    return by_type.groupBy("feed", "file_name", "field").agg(F.max("written_at").alias("written_at"), main.alias("type"), F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "n"))).alias("types"))


def file_pairs(kinds: DataFrame) -> DataFrame:
    """feed, to_file, from_file: each file of a feed with the one before it."""
    files = kinds.groupBy("feed", "file_name").agg(F.max("written_at").alias("written_at"))
    order = Window.partitionBy("feed").orderBy("written_at", "file_name")
    return files.select("feed", F.col("file_name").alias("to_file"), F.lag("file_name").over(order).alias("from_file")).where("from_file is not null")


def sketches(rows: DataFrame, kinds: DataFrame, pairs: DataFrame, k: int = K) -> DataFrame:
    """feed, file_name, field, sketch: the sketches of the columns that vanished or came where both happened at once."""
    sides = pairs.select("feed", "to_file", F.inline(F.array(F.struct(F.col("from_file").alias("file_name"), F.lit(0).alias("side")), F.struct(F.col("to_file").alias("file_name"), F.lit(1).alias("side")))))
    seen = sides.join(kinds.select("feed", "file_name", "field"), ["feed", "file_name"]).groupBy("feed", "to_file", "field").agg(F.count("*").alias("n"), F.max("side").alias("side"), F.max("file_name").alias("file_name"))
    lone = seen.where("n = 1").select("feed", "to_file", "field", "side", "file_name")
    both = lone.groupBy("feed", "to_file").agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("feed", "to_file")
    wanted = lone.join(both, ["feed", "to_file"], "left_semi").groupBy("feed", "file_name", "field").agg(F.max("side").alias("side"))
    # a condition on both sides of the join, so that content isn't worked out below it for every column of the table
    values = with_content(rows.where("record is not null").join(bounded(wanted), ["feed", "file_name", "field"]), F.col("side") >= 0).where("content is not null")
    values = values.select("feed", "file_name", "field", F.xxhash64("record").alias("r"), "content")
    smallest = Window.partitionBy("feed", "file_name", "field").orderBy("r", "content")
    entry = F.struct("r", F.xxhash64("content").alias("c"), F.regexp_extract("content", r"^\d+\.0$", 0).try_cast("double").alias("num"))
    kept = values.withColumn("k", F.row_number().over(smallest)).where(F.col("k") <= k)
    return kept.groupBy("feed", "file_name", "field").agg(F.collect_list(entry).alias("sketch"))


@lru_cache(maxsize=100_000)
def name_likeness(a: str, b: str) -> float:
    """0..1: the better of the likeness of the letters and the share of common words."""
    words = lambda s: {w.lower() for w in "".join("_" + c if c.isupper() else c for c in s).split("_") if w}
    wa, wb = words(a), words(b)
    plain = lambda s: s.replace("_", "").lower()
    return max(SequenceMatcher(None, plain(a), plain(b)).ratio(), len(wa & wb) / max(1, min(len(wa), len(wb))) if wa & wb else 0.0)


def match(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching of rows and columns with positive weights (successive shortest paths)."""
    n, m = len(weights), len(weights[0]) if weights else 0
    size = max(n, m)
    cost = [[-weights[i][j] if i < n and j < m else 0.0 for j in range(size)] for i in range(size)]
    row_price, col_price, owner = [0.0] * size, [0.0] * size, [-1] * size
    for start in range(size):
        dist, back, done, row, col = [math.inf] * size, [-1] * size, [False] * size, start, -1
        while True:
            best, nxt = math.inf, -1
            for j in range(size):
                if done[j]:
                    continue
                d = cost[row][j] - row_price[row] - col_price[j] + (dist[col] if col >= 0 else 0.0)
                if d < dist[j] - 1e-12:
                    dist[j], back[j] = d, col
                if dist[j] < best:
                    best, nxt = dist[j], j
            col, done[nxt] = nxt, True
            if owner[col] < 0:
                break
            row = owner[col]
        total = dist[col]
        row_price[start] += total
        for j in range(size):
            if done[j] and j != col:
                col_price[j] += dist[j] - total
                row_price[owner[j]] += total - dist[j]
        while col >= 0:
            owner[col] = owner[back[col]] if back[col] >= 0 else start
            col = back[col]
    return [(i, j) for j, i in enumerate(owner) if i < n and j < m and weights[i][j] > 0]


def _values(column: tuple) -> dict[int, tuple[int, float | None]]:
    """record -> (content, number) of a column's sketch; of several contents of a record the least."""
    _, records, contents, numbers = column
    if records is None:
        return {}
    rows = sorted(zip(records.tolist(), contents.tolist(), numbers.tolist()), reverse=True)
    return {r: (c, None if n != n else n) for r, c, n in rows}


def evidence(a: str, b: str, old: dict, new: dict) -> float:
    """How sure it is that field a goes on as b; 0 if the evidence doesn't do."""
    names = name_likeness(a, b)
    common = old.keys() & new.keys()
    counts = Counter(v[0] for v in old.values()) + Counter(v[0] for v in new.values())
    total = sum(counts.values())
    same = [k for k in common if old[k][0] == new[k][0]]
    bits = sum(-math.log2(counts[old[k][0]] / total) for k in same)
    one_old, one_new = {v for v in old.values()}, {v for v in new.values()}
    if len(one_old) == 1 and len(one_new) == 1 and names >= NAMES:  # constants: a version that may have been raised
        (x,), (y,) = one_old, one_new
        return 1.0 + names if x[0] == y[0] or (x[1] is not None and y[1] is not None and x[1] <= y[1]) else 0.0
    if common:
        share = len(same) / len(common)
        certain = bits >= BITS or names >= NAMES or (share == 1.0 and len(same) >= ALL_AGREE)
        return share * (1.0 + math.log2(1.0 + bits)) + names if share >= AGREE and certain else 0.0
    a_set, b_set = {v[0] for v in old.values()}, {v[0] for v in new.values()}
    like = len(a_set & b_set) / max(1, min(len(a_set), len(b_set)))
    return like + names if like >= AGREE and names >= NAMES and a_set else 0.0


REPORT = "feed string, file_name string, drift_kind string, field_name string, new_name string"


def _changes(old: dict[str, tuple], new: dict[str, tuple]) -> list[tuple[str, str, str]]:
    """(kind, field, new name) of the changes between two files' columns; sketches are opened only where a field is
    gone or new."""
    out: list[tuple[str, str, str]] = []
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    renamed: dict[str, str] = {}
    if gone and come:
        a_values, b_values = [_values(old[a]) for a in gone], [_values(new[b]) for b in come]
        pairs = match([[evidence(a, b, x, y) for b, y in zip(come, b_values)] for a, x in zip(gone, a_values)])
        renamed = {gone[i]: come[j] for i, j in pairs}
    out += [("renamed", a, b) for a, b in renamed.items()]
    out += [("removed", a, a) for a in gone if a not in renamed]
    out += [("added", b, b) for b in come if b not in renamed.values()]
    for a, b in [*renamed.items(), *((f, f) for f in old.keys() & new.keys())]:
        if old[a][0] and new[b][0] and old[a][0] != new[b][0]:
            out.append(("retyped", b, b))
    return out


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """The changes of all file pairs in one batch of pairs."""
    pairs: dict[tuple[str, str], tuple[dict, dict]] = {}
    for feed, file, side, field, *column in zip(*[pdf[c] for c in ("feed", "to_file", "side", "field", "type", "r", "c", "num")]):
        pairs.setdefault((feed, file), ({}, {}))[side][field] = tuple(column)
    rows = [(*pair, *x) for pair, (old, new) in pairs.items() if old and new for x in _changes(old, new)]
    return pd.DataFrame(rows, columns=["feed", "file_name", "drift_kind", "field_name", "new_name"])


def _report(rows: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    pairs = file_pairs(kinds)
    columns = kinds.join(sketches(rows, kinds, pairs, k), ["feed", "file_name", "field"], "left")
    sides = pairs.select("feed", "to_file", F.posexplode(F.array("from_file", "to_file")).alias("side", "file_name"))
    batches = max(1, -(-kinds.select("feed", "file_name").distinct().count() // PAIRS))
    sketch = [F.col(f"sketch.{c}").alias(c) for c in ("r", "c", "num")]
    both = sides.join(columns.select("feed", "file_name", "field", "type", *sketch), ["feed", "file_name"])
    return both.withColumn("batch", F.pmod(F.xxhash64("feed", "to_file"), F.lit(batches))).groupBy("batch").applyInPandas(_compare, REPORT)


def drift_report(raw: DataFrame, k: int = K) -> DataFrame:
    """feed, file_name, drift_kind, field_name, new_name: every change of a file against the one before it."""
    rows = fields(raw)
    return _report(rows, written(column_types(rows), "profiles"), k)


def _lineage(pdf: pd.DataFrame) -> pd.DataFrame:
    """feed, file_name, field, column_name of every field of a feed's files. pdf: the files in order (ord), each with its
    fields and renames. A column is named after its first field; see the module's docstring for names that come again."""
    lives: dict[str, str] = {}  # field -> its column, as of the file before
    out = []
    for _, name, present, renames in sorted(zip(pdf["ord"], pdf["file_name"], pdf["fields"], pdf["renames"]), key=lambda x: x[0]):
        old_of = {r["new_name"]: r["field_name"] for r in (renames if renames is not None else [])}
        new: dict[str, str] = {}
        for field in present:
            source = old_of.get(field, field if field not in old_of.values() else None)
            if source is not None and source in lives:
                new[field] = lives[source]
        taken = set(new.values()) | {c for f, c in lives.items() if f not in old_of.values() and f not in present}
        for field in sorted(set(present) - new.keys()):
            new[field] = field if field not in taken else f"{field}@{name}"
            taken.add(new[field])
        lives = {f: c for f, c in lives.items() if f not in old_of.values() and f not in new and c not in new.values()} | new
        out += [(pdf["feed"].iloc[0], name, f, c) for f, c in new.items()]
    return pd.DataFrame(out, columns=["feed", "file_name", "field", "column_name"])


def lineage(kinds: DataFrame, report: DataFrame) -> DataFrame:
    """feed, file_name, field, column_name: the unified column of each column of each file. A task holds the names of the
    fields of one feed's files, no values."""
    renames = report.where("drift_kind = 'renamed'").groupBy("feed", "file_name").agg(F.collect_list(F.struct("field_name", "new_name")).alias("renames"))
    files = kinds.groupBy("feed", "file_name").agg(F.max("written_at").alias("written_at"), F.collect_set("field").alias("fields"))
    numbered = files.withColumn("ord", F.row_number().over(Window.partitionBy("feed").orderBy("written_at", "file_name"))).drop("written_at")
    return numbered.join(renames, ["feed", "file_name"], "left").groupBy("feed").applyInPandas(_lineage, "feed string, file_name string, field string, column_name string")


def unified_columns(kinds: DataFrame, names: DataFrame) -> DataFrame:
    """feed, column_name, type, n_files, n_values: the columns of the one table. The type is the most frequent one over all
    values of the column in its feed; string if it has none."""
    typed = kinds.join(names, ["feed", "file_name", "field"]).select("feed", "column_name", "file_name", F.inline_outer("types"))
    by_type = typed.groupBy("feed", "column_name", "type").agg(F.sum("n").alias("n"), F.collect_set("file_name").alias("f"))
    main = F.coalesce(F.max_by("type", F.when(F.col("type").isNotNull(), F.struct("n", "type"))), F.lit("string"))
    return by_type.groupBy("feed", "column_name").agg(main.alias("type"), F.size(F.array_distinct(F.flatten(F.collect_list("f")))).cast("long").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"))


def _quoted(text: Column) -> Column:
    """The text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _converted(kind: Column, own: Column, v: Column) -> Column:
    """The value as JSON text of the type `kind`, null if it can't be converted. own: the type it has."""
    text = F.to_json(v)
    plain = F.coalesce(F.when(own == "string", F.try_variant_get(v, "$", "string")), text)
    number = F.regexp_extract(plain, r"^\s*[+]?(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*$", 1)
    flag = F.lower(F.trim(plain))
    packed = F.to_json(F.try_parse_json(F.when(own == "string", plain)))
    as_list = F.when(own == "object", F.concat(F.lit("["), text, F.lit("]"))).when(own == "string", F.when(packed.startswith("["), packed))
    return (
        F.when(kind == own, text)
        .when(kind == "string", _quoted(plain))
        .when(kind == "number", F.when(own == "boolean", F.when(flag == "true", "1").otherwise("0")).when(number != "", F.regexp_replace(number, r"^(-?)0+(?=\d)", "$1")))
        .when(kind == "boolean", F.when(flag.isin("true", "1", "1.0", "yes", "y"), "true").when(flag.isin("false", "0", "0.0", "no", "n"), "false"))
        .when(kind == "array", as_list)
        .when(kind == "object", F.when(packed.startswith("{"), packed))
    )


def _object(entries: Column) -> Column:
    """A JSON object of (key, value text) entries, of equal keys the first; null without any."""
    ordered = F.array_sort(entries)
    once = F.filter(ordered, lambda x, i: (i == 0) | (x["key"] != F.try_element_at(ordered, i)["key"]))
    members = F.transform(once, lambda x: F.concat(_quoted(x["key"]), F.lit(":"), x["value"]))
    return F.when(F.size(once) > 0, F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))


def unified(raw: DataFrame, k: int = K) -> DataFrame:
    """feed, file_name, line_no, record, fields, written: every whole line with its values under their unified columns.

    fields: a JSON object whose members have the types of `unified_columns` (null where the line has null); `written`: the
    values, as they are written, that can't be converted to their column's type, null if there are none."""
    rows = fields(raw)
    kinds = written(column_types(rows), "profiles")
    names = written(lineage(kinds, _report(rows, kinds, k)), "names")
    types = names.join(unified_columns(kinds, names).select("feed", "column_name", F.col("type").alias("kind")), ["feed", "column_name"])
    named = rows.join(bounded(types), ["feed", "file_name", "field"])
    text = F.when(F.col("type").isNotNull(), F.to_json("_v"))
    cells = named.select("feed", "file_name", "line_no", "record", F.col("column_name").alias("key"), "type", text.alias("text"), F.when(F.col("type").isNotNull(), _converted(F.col("kind"), F.col("type"), F.col("_v"))).alias("value"))
    entry = F.struct("key", F.coalesce("value", F.lit("null")).alias("value"))
    lost = F.when(F.col("type").isNotNull() & F.col("value").isNull(), F.struct("key", F.col("text").alias("value")))
    grouped = cells.groupBy("feed", "file_name", "line_no", "record").agg(F.collect_set(entry).alias("e"), F.collect_set(lost).alias("l"))
    return grouped.select("feed", "file_name", "line_no", "record", _object(F.col("e")).alias("fields"), _object(F.col("l")).alias("written"))


SPARK_TYPES = {"string": "string", "number": "double", "boolean": "boolean", "array": "string", "object": "string"}


def typed(rows: DataFrame, columns: DataFrame, feed: str) -> DataFrame:
    """The rows of `unified` of one feed as a table with a typed column for each unified column (lists and objects as JSON
    text). The names are collected: as many as the feed has columns."""
    own = columns.where(F.col("feed") == feed).orderBy("column_name").collect()
    value = lambda r: F.try_variant_get("v", "$['" + r.column_name.replace("'", "\\'") + "']", SPARK_TYPES[r.type]).alias(r.column_name)
    return rows.where(F.col("feed") == feed).withColumn("v", F.parse_json("fields")).select("feed", "file_name", "line_no", "record", *map(value, own))
