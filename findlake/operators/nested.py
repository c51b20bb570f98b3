"""Deeply nested semi-structured records into related flat tables that keep parent-child links.

1. Each record is decoded and becomes path-value-ordinal triples: every scalar leaf with its path, whose list places
   are ordinals. A list item that is a scalar is a leaf of its own. Nothing recurses, so records may be nested to any depth.
2. Paths are grouped by repeated ancestor: the innermost list above a leaf (`affected[].ranges[].events[]`). A bare
   item in place of a list counts as item 0 of it; the schema says which paths are lists.
3. Each group is pivoted into one table: a row per item with its own path, its parent's path and one column per leaf.

Each triple carries its whole path, so the pivot is one aggregation with map-side partial results per record; no
record is joined with itself and none is collected across records.

Defined cases: wrappers around records (lists, objects without the record's mark, JSON inside a JSON string) are taken
off, however many there are, and every record in them is read, each with paths of its own; a text that is null, blank or
not readable gives no triple (`unreadable` lists such rows); null items give none but keep their place; an empty list gives none. Numbers keep the text they are written with. Repeated rows of a record
give the same children once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Triples that a task holds before it passes them on.
FLUSH = 20_000
COLUMNS = ["record", "ancestor", "parent_path", "item_path", "leaf", "ordinal", "value"]
TRIPLES = "record string, ancestor string, parent_path string, item_path string, leaf string, ordinal int, value string"


class _Number(str):
    """A number as it is written."""


def _no_constant(text: str) -> str:
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_no_constant)


_SPACE = re.compile(r"[ \t\r\n]*")
_PLAIN = re.compile(r"(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def decode_deep(text: str) -> object:
    """The same as the decoder, token by token with a stack of its own, for texts too deep for recursion."""
    root: list = []
    stack: list[tuple[list | dict, str | None]] = [(root, None)]  # an open list or object, and the key that waits for its value
    at, due = _SPACE.match(text).end(), "value"  # what may come next: a value, a key, or what follows a value
    while at < len(text):
        holder, key = stack[-1]
        c = text[at]
        if due in ("value", "first") and not (c == "]" and due == "first" and isinstance(holder, list)):
            if c in "[{":
                value: object = [] if c == "[" else {}
                at += 1
            elif c == '"':
                value, at = scanstring(text, at + 1, True)
            else:
                m = _PLAIN.match(text, at)
                if not m:
                    raise ValueError(f"no value at {at}")
                value, at = _Number(m.group()) if m.group("number") else _WORDS[m.group()], m.end()
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[key] = value
            due = "after"
            if isinstance(value, list) or isinstance(value, dict):
                stack.append((value, None))
                due = "first" if isinstance(value, list) else "first key"
        elif due in ("key", "first key") and c == '"':
            name, at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            stack[-1], at, due = (holder, name), at + 1, "value"
        elif len(stack) > 1 and c == ("]" if isinstance(holder, list) else "}") and due in ("after", "first", "first key"):
            stack.pop()
            at, due = at + 1, "after"
        elif len(stack) > 1 and c == "," and due == "after":
            at, due = at + 1, "value" if isinstance(holder, list) else "key"
        else:
            raise ValueError(f"unexpected text at {at}")
        at = _SPACE.match(text, at).end()
    if len(stack) > 1 or len(root) != 1:
        raise ValueError("not whole")
    return root[0]


def decode(text: str) -> object:
    """The value of a JSON text, numbers as they are written; ValueError if it isn't readable."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return decode_deep(text)


def read_records(text: str | None, mark: str) -> list[dict]:
    """The records in text without wrappers, i.e. the outermost objects that have the field `mark`, in order."""
    out, waiting = [], [text]
    while waiting:
        value = waiting.pop()
        if isinstance(value, str) and not isinstance(value, _Number):
            try:
                waiting.append(decode(value.strip("\ufeff \t\r\n\x00")))
            except ValueError:
                continue
        elif isinstance(value, dict) and mark in value:
            out.append(value)
        elif isinstance(value, dict):
            inside = list(value.values())
            waiting += reversed(inside if len(inside) == 1 else [x for x in inside if isinstance(x, (dict, list))])
        elif isinstance(value, list):
            waiting += reversed(value)
    return out


def _text(value: object) -> str:
    return {True: "true", False: "false"}.get(value, value) if isinstance(value, bool) else str(value)


def triples(record: dict, lists: frozenset[str]) -> Iterator[tuple[str, str, str, str, int, str]]:
    """(ancestor, parent path, item path, leaf, ordinal, value) of each scalar of the record.

    lists: the paths (without ordinals) whose value is a list of items, so that a bare item can be told."""
    # (value, ancestor pattern, parent path, item path, ordinal, path below the item, pattern of the whole path, whole path)
    stack: list[tuple] = [(record, "$", "", "$", 0, "", "", "")]
    while stack:
        value, ancestor, parent, item, ordinal, leaf, pattern, path = stack.pop()
        if value is None:
            continue
        if isinstance(value, list) or (pattern in lists and not pattern.endswith("[]")):
            holder = path[: -len(leaf) - 1] if leaf and path != leaf else ""
            holder = item if leaf and item != "$" else (holder or "$")
            for k, x in enumerate(value if isinstance(value, list) else [value]):
                stack.append((x, pattern + "[]", holder, f"{path}[{k}]", k, "", pattern + "[]", f"{path}[{k}]"))
        elif isinstance(value, dict):
            for key, x in value.items():
                dot = "." if path else ""
                stack.append((x, ancestor, parent, item, ordinal, f"{leaf}.{key}" if leaf else key, f"{pattern}{dot}{key}", f"{path}{dot}{key}"))
        else:
            yield ancestor, parent, item, leaf, ordinal, _text(value)


def to_triples(df: DataFrame, key: str, text: str, mark: str, lists: list[str]) -> DataFrame:
    """The triples of the record in column `text` of each row, under `key`. See TRIPLES for the columns."""
    wanted = frozenset(lists)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for k, t in zip(pdf["k"].tolist(), pdf["t"].tolist()):
                for record in read_records(t, mark):
                    out += [(k, *x) for x in triples(record, wanted)]
                if len(out) >= FLUSH:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out = []
            yield pd.DataFrame(out, columns=COLUMNS)

    return df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null").mapInPandas(parse, TRIPLES)


def unreadable(df: DataFrame, text: str, mark: str) -> DataFrame:
    """The rows in whose text no record can be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[not read_records(t, mark) for t in pdf[text].tolist()]]

    return df.mapInPandas(run, df.schema)


def pivot_table(rows: DataFrame, ancestor: str, leaves: dict[str, str]) -> DataFrame:
    """One flat table: the items of a repeated ancestor, leaves {path below the item: column}; '' is the item itself."""
    own = rows.where(F.col("ancestor") == ancestor)
    columns = [F.max(F.when(F.col("leaf") == leaf, F.col("value"))).alias(name) for leaf, name in leaves.items()]
    return own.groupBy("record", "parent_path", "item_path", "ordinal").agg(*columns)


#: The lists of an advisory record; the key-value objects in events are items whose every leaf is a value.
ADVISORY_LISTS = [
    "aliases", "references", "severity", "credits", "affected", "affected[].versions", "affected[].ranges",
    "affected[].ranges[].events", "credits[].contact", "affected[].ecosystem_specific.functions",
]
#: child kind: (ancestor, leaves in order of preference)
ADVISORY_CHILDREN = {
    "alias": ("aliases[]", [""]),
    "severity": ("severity[]", ["score", ""]),
    "reference": ("references[]", ["url", ""]),
    "credit": ("credits[]", ["name", ""]),
    "affected": ("affected[]", ["package.name", "package", ""]),
    "range": ("affected[].ranges[]", ["type", ""]),
    "version": ("affected[].versions[]", [""]),
}
EVENTS = "affected[].ranges[].events[]"


def advisory_triples(advisories: DataFrame) -> DataFrame:
    return to_triples(advisories, "osv_id", "json", "id", ADVISORY_LISTS)


def advisory_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of an advisory corpus by child kind, each with record, parent_path, item_path and ordinal."""
    return {
        "alias": pivot_table(rows, "aliases[]", {"": "alias"}),
        "severity": pivot_table(rows, "severity[]", {"type": "type", "score": "score"}),
        "reference": pivot_table(rows, "references[]", {"type": "type", "url": "url"}),
        "credit": pivot_table(rows, "credits[]", {"name": "name"}),
        "affected": pivot_table(rows, "affected[]", {"package.ecosystem": "ecosystem", "package.name": "package", "package.purl": "purl"}),
        "range": pivot_table(rows, "affected[].ranges[]", {"type": "type", "repo": "repo"}),
        "version": pivot_table(rows, "affected[].versions[]", {"": "version"}),
        "event": pivot_table(rows, EVENTS, {k: k for k in ("introduced", "fixed", "last_affected", "limit")}),
    }


def advisory_children(rows: DataFrame) -> DataFrame:
    """osv_id, child_kind, parent_path, child_path, item_value of all distinct children: the pivots of all groups at once.

    An event has a case per key; every other item one, whose value is the first leaf it has."""
    kinds = F.create_map(*[F.lit(x) for kind, (ancestor, _) in ADVISORY_CHILDREN.items() for x in (ancestor, kind)])
    order = F.create_map(*[x for ancestor, leaves in ADVISORY_CHILDREN.values() for k, leaf in enumerate(leaves) for x in (F.lit(f"{ancestor}\x1f{leaf}"), F.lit(k))])
    place = F.try_element_at(order, F.concat_ws("\x1f", "ancestor", "leaf"))
    event = F.col("ancestor") == EVENTS
    cases = rows.select(
        F.col("record").alias("osv_id"), F.when(event, "event").otherwise(F.try_element_at(kinds, F.col("ancestor"))).alias("child_kind"), "parent_path",
        F.col("item_path").alias("child_path"), F.when(event, F.col("leaf")).otherwise("").alias("own"), F.when(event, F.lit(0)).otherwise(place).alias("place"),
        F.when(event, F.concat_ws(":", "leaf", "value")).otherwise(F.col("value")).alias("value"),
    ).where(F.col("child_kind").isNotNull() & F.col("place").isNotNull())
    items = cases.groupBy("osv_id", "child_kind", "parent_path", "child_path", "own", "value").agg(F.min("place").alias("place"))
    best = items.groupBy("osv_id", "child_kind", "parent_path", "child_path", "own").agg(F.min("place").alias("place"), F.collect_set(F.struct("place", "value")).alias("all"))
    chosen = F.transform(F.filter("all", lambda x: x["place"] == F.col("place")), lambda x: x["value"])
    return best.select("osv_id", "child_kind", "parent_path", "child_path", F.explode(chosen).alias("item_value"))
