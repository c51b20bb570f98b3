"""Joins that have no plain equality: nearest ancestor, ranges, tolerance, suffixes, as-of, wildcards, best match.

Each has an equality on a blocking key, so no plan compares all pairs: ancestors are exploded into keys, paths are
blocked on their last part (two paths of which one ends with the other have the same), intervals on the buckets they
touch or are made of, as-of lookups become one sorted union. Candidate pairs are checked exactly afterwards.
Null keys never match. Empty sides give what an outer or inner join of that kind gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a block that line ranges are entered into.
BLOCK = 64


def path_parts(path: Column) -> Column:
    """The parts of a path: slashes either way, without empty and '.' parts."""
    return F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))


def normal_path(path: Column) -> Column:
    return F.array_join(path_parts(path), "/")


def basename(path: Column) -> Column:
    return F.coalesce(F.try_element_at(path_parts(path), F.lit(-1)), F.lit(""))


def ancestors(directory: Column) -> Column:
    """array<struct<dir, depth>>: the directory itself and all above it, however deep, '' being the root."""
    parts = path_parts(directory)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("dir"), k.alias("depth")))


def nearest_ancestor(lower: DataFrame, upper: DataFrame, keys: list[str], lower_dir: str, upper_dir: str, row: str, position: str, keep: str) -> DataFrame:
    """row, matched_dir, keep of the nearest directory above that has an upper row with the same keys (its first by
    position); null where there is none. One explode by depth, one equi-join, one aggregation."""
    up = upper.groupBy(*keys, normal_path(F.col(upper_dir)).alias("dir")).agg(F.min(F.struct(F.col(position).alias("p"), F.col(keep).alias("v"))).alias("m"))
    climbed = lower.select(row, *keys, F.inline(ancestors(F.col(lower_dir))))
    found = climbed.join(up, [*keys, "dir"], "left").groupBy(row).agg(F.max(F.when(F.col("m").isNotNull(), F.struct("depth", "dir", F.col("m.v").alias("v")))).alias("b"))
    return found.select(row, F.col("b.dir").alias("matched_dir"), F.col("b.v").alias(keep))


def tolerance_match(expected: DataFrame, produced: DataFrame, drift: int, families: dict[str, list[str]] | None = None) -> DataFrame:
    """expected_id, produced_id of all pairs that agree within tolerance.

    expected(expected_id, file, cwe, line_start, line_end), produced(produced_id, file, cwe, start_line, end_line).
    One path must end with the other, the line ranges widened by drift must meet (a null line_start matches any line),
    and the CWEs must be equal or siblings. Joined on the last part of the path, the CWE (the expected side is entered
    under each of its siblings) and the blocks of BLOCK lines that the ranges touch; a pair counts in the first block that
    it has in common, so it comes once. Only expected rows without a line meet all lines of their file name and CWE."""
    e = expected.select("expected_id", normal_path(F.col("file")).alias("e_file"), F.col("cwe").alias("e_cwe"), "line_start", F.coalesce("line_end", "line_start").alias("line_end"), basename(F.col("file")).alias("base")).where("base <> ''")
    p = produced.select("produced_id", normal_path(F.col("file")).alias("p_file"), F.upper("cwe").alias("p_cwe"), "start_line", F.coalesce("end_line", "start_line").alias("end_line"), basename(F.col("file")).alias("base"))
    names = F.array("e_cwe")
    if families:
        siblings = F.create_map(*[x for k, v in families.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        names = F.array_union(names, F.coalesce(F.try_element_at(siblings, F.col("e_cwe")), F.array().cast("array<string>")))
    e = e.withColumn("p_cwe", F.explode(names))
    block = lambda c: F.floor(c / BLOCK)
    lo, hi = F.col("line_start") - drift, F.greatest("line_end", "line_start") + drift
    placed = e.where("line_start is not null").withColumns({"e_lo": block(lo), "_b": F.explode(F.sequence(block(lo), block(hi)))})
    first, last = F.least("start_line", "end_line"), F.greatest("start_line", "end_line")
    ranges = p.where("start_line is not null").withColumns({"p_lo": block(first), "_b": F.explode(F.sequence(block(first), block(last)))})
    near = placed.join(ranges, ["base", "p_cwe", "_b"]).where(F.col("_b") == F.greatest("e_lo", "p_lo"))
    near = near.where((F.col("start_line") <= F.col("line_end") + drift) & (F.col("end_line") >= F.col("line_start") - drift))
    anywhere = e.where("line_start is null").join(p, ["base", "p_cwe"])
    found = near.select("expected_id", "produced_id", "e_file", "p_file").unionByName(anywhere.select("expected_id", "produced_id", "e_file", "p_file"))
    return found.where(F.col("p_file").endswith(F.col("e_file")) | F.col("e_file").endswith(F.col("p_file"))).select("expected_id", "produced_id")


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, row: str, width: int = 64) -> DataFrame:
    """row, name of the innermost span lo..hi of the same key around each point: greatest lo, of equals the later span.

    spans(key, name, lo, hi, position). Spans are entered into the blocks of `width` lines they touch, so a point meets
    only the spans of its block."""
    blocks = spans.where("lo <= hi").select(key, "name", "lo", "hi", "position", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("_b"))
    met = points.withColumn("_b", F.floor(F.col(at) / width)).join(blocks, [key, "_b"]).where(F.col(at).between(F.col("lo"), F.col("hi")))
    best = met.groupBy(row).agg(F.max_by("name", F.struct("lo", "position")).alias("name"))
    return points.select(row).join(best, row, "left")


def first_containing(points: DataFrame, spans: DataFrame, key: str, at: str, row: str) -> DataFrame:
    """row, name of the first span in list order that holds the point (of equals the greater lo); else of the open-ended
    span (null hi) with the greatest lo at or before it (of equals the first).

    spans(key, name, lo, hi, position). No point meets all spans of its key: a closed span is entered under the aligned
    blocks of 1, 2, 4, ... lines that it is made of (at most two of each size), each block keeps its first position, and a
    distinct place looks up the blocks it lies in, one of each size. Open spans are an as-of lookup."""
    place = Window.partitionBy(row)
    position = F.coalesce(F.col("position").cast("long"), F.lit((1 << 63) - 1))
    spans = spans.where(F.col(key).isNotNull())
    closed = spans.where("lo <= hi").select(key, "name", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), position.alias("_pos"))
    places = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).cast("long").alias("_at")).distinct()
    first = places.select(key, "_at", F.explode(_blocks_around(F.col("_at"))).alias("_b")).join(
        closed.select(key, "_pos", F.explode(_blocks_within(F.col("lo"), F.col("hi"))).alias("_b")).groupBy(key, "_b").agg(F.min("_pos").alias("_pos")), [key, "_b"]
    ).groupBy(key, "_at").agg(F.min("_pos").alias("_pos"))
    hit = lambda *order: F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col("name")).alias("_hit")
    held = first.join(closed, [key, "_pos"]).where(F.col("_at").between(F.col("lo"), F.col("hi")))
    held = held.groupBy(key, "_at").agg(F.min(hit(F.lit(0), F.col("_pos"), -F.col("lo"))).alias("_hit"))
    opened = spans.where("lo is not null and hi is null").select(key, "name", F.col("lo").cast("long").alias("lo"), position.alias("_pos"))
    opened = opened.groupBy(key, "lo").agg(F.min(hit(F.lit(1), -F.col("lo"), F.col("_pos"))).alias("_hit"))
    rest = places.join(held, [key, "_at"], "left_anti").withColumn("_place", F.struct(key, "_at"))
    before = as_of(rest, opened, key, "_at", "lo", "_place", "_hit").select(f"_place.{key}", "_place._at", "_hit")
    named = points.select(row, key, F.col(at).cast("long").alias("_at")).join(held.unionByName(before), [key, "_at"], "left")
    return named.select(row, F.when(F.col(row).isNotNull(), F.min("_hit").over(place)["name"]).alias("name"))


def _blocks_around(at: Column) -> Column:
    """The aligned blocks that a line lies in, one of each size up to the line itself. Lines below 1 are mirrored (0 is -1)."""
    side, x = F.when(at < 1, -1).otherwise(1), F.when(at < 1, 1 - at).otherwise(at)
    return F.transform(F.sequence(F.lit(0), F.length(F.bin(x)) - 1), lambda k: side * (F.call_function("shiftright", x, k) * 64 + k))


def _blocks_within(lo: Column, hi: Column) -> Column:
    """The aligned blocks, as _blocks_around numbers them, that lo..hi is made of, disjoint and at most two of each size."""

    def part(side: int, a: Column, b: Column) -> Column:
        def of_size(k: Column) -> Column:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), k)
            left, right = F.call_function("shiftright", a + one - 1, k), F.call_function("shiftright", b + 1, k)
            odd = [F.when((left < right) & (left % 2 == 1), left), F.when((left < right) & (right % 2 == 1), right - 1)]
            return F.transform(F.array_compact(F.array(*odd)), lambda n: side * (n * 64 + k))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(b)) - 1), of_size))

    none = F.array().cast("array<bigint>")
    above = F.when(hi >= 1, part(1, F.greatest(lo, F.lit(1)), hi)).otherwise(none)
    return F.concat(above, F.when(lo < 1, part(-1, 1 - F.least(hi, F.lit(0)), 1 - lo)).otherwise(none))


def resolve_suffix(raw: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """path, resolved: the known path itself, else the one known path of which one ends with the other, else null."""
    r = raw.select(path).distinct().select(path, normal_path(F.col(path)).alias("_n"), basename(F.col(path)).alias("_b"))
    k = known.select(normal_path(F.col(path)).alias("known")).distinct().withColumn("_b", F.element_at(F.split("known", "/"), -1))
    met = r.join(k, "_b", "left").where(F.col("known").isNull() | F.col("known").endswith(F.concat(F.lit("/"), "_n")) | F.col("_n").endswith(F.concat(F.lit("/"), "known")) | (F.col("known") == F.col("_n")))
    best = met.groupBy(path).agg(F.max(F.when(F.col("known") == F.col("_n"), F.col("known"))).alias("exact"), F.countDistinct("known").alias("n"), F.max("known").alias("one"))
    return raw.select(path).distinct().join(best, path, "left").select(path, F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("resolved"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, row: str, value: str) -> DataFrame:
    """row, value: the value of the latest right row of the same key at or before each left row, null if there is none.

    One sorted union instead of a range join: values are carried down over (key, time), rights before lefts."""
    a = left.select(key, F.col(left_at).alias("_t"), F.lit(1).alias("_o"), F.col(row).alias("_row"), F.lit(None).alias("_v"))
    b = right.where(F.col(right_at).isNotNull()).select(key, F.col(right_at).alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast(left.schema[row].dataType).alias("_row"), F.struct(F.col(value).alias("v")).alias("_v"))
    a = a.withColumn("_v", F.lit(None).cast(b.schema["_v"].dataType))
    down = Window.partitionBy(key).orderBy("_t", "_o", F.col("_v.v").asc()).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_last", F.last("_v", True).over(down)).where("_o = 1").select(F.col("_row").alias(row), F.col("_last.v").alias(value))


def first_rule(rows: DataFrame, rules: DataFrame, row: str, keys: list[str], today: Column) -> DataFrame:
    """row, rule_no, reason of the first rule that matches: each key of the rule is null or equal to the row's, one at
    least is not null, and it has not expired (today > expires). rules(rule_no, reason, expires, *keys).

    One pass per pattern of non-null keys (at most 2^keys): an equi-join on exactly those keys."""
    live = rules.where(F.coalesce(~(today > F.col("expires")), F.lit(True)))
    out = None
    for mask in range(1, 1 << len(keys)):
        on = [k for i, k in enumerate(keys) if mask >> i & 1]
        pattern = live
        for i, k in enumerate(keys):
            pattern = pattern.where(F.col(k).isNotNull() if mask >> i & 1 else F.col(k).isNull())
        hit = rows.select(row, *on).join(pattern.select("rule_no", "reason", *on), on).select(row, "rule_no", "reason")
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy(row).agg(F.min(F.struct("rule_no", "reason")).alias("m")).select(row, "m.rule_no", "m.reason")


def best_scored(pairs: DataFrame, left: str, order: list[Column], keep: list[str]) -> DataFrame:
    """One candidate per left row: the greatest in the given order."""
    best = F.max(F.struct(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("o"), F.struct(*keep).alias("r"))).alias("m")
    return pairs.groupBy(left).agg(best).select(left, *[F.col(f"m.r.{c}").alias(c) for c in keep])
