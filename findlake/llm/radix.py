"""Duplicates hidden by formatting differences: recursive radix partitioning on canonical bytes, then counting tries.

1. Each record becomes one canonical key: every field in lower case without blanks and punctuation, fields joined
   by a separator, fields that tell records apart first; key-value pairs are sorted. Null has a mark of its own.
2. Every map task counts its rows in a trie (terminal counters) and emits each key once, so a key that holds a
   third of all rows crosses the shuffle once per task.
3. Radix planning: buckets are key prefixes. A prefix that holds more than `capacity` entries and more than one
   key is split `step` bytes behind the first place at which its keys differ, which its least and its greatest key show,
   and so on until each bucket fits. A level therefore parts every bucket it splits, however long the common prefixes
   are, and `capacity` doesn't rise with the data. At most entries/capacity prefixes are oversized per level; they are a
   table in the shared folder, broadcast only if it is small.
4. Each bucket goes to one task, which merges the counters in a trie and emits the terminals.

Defined cases: null equals only null; an empty text, a blank one and one of punctuation only are equal to each
other but not to null. Repeated rows count as copies. Empty input gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.session import alnum, bounded, written

SEP, NULL = "\x1f", "\x00"
#: Entries a bucket may hold without being split.
CAPACITY = 50_000
#: Bytes of the first digit and of each further one.
FIRST, STEP = 4, 4
#: Keys a map task's trie holds before it is flushed.
FLUSH = 200_000


def canonical(col: Column) -> Column:
    return F.coalesce(alnum(col.cast("string")), F.lit(NULL))


def canonical_pairs(col: Column) -> Column:
    """Key-value pairs in any order and notation (k=v;k=v, "k": "v", lines) as sorted canonical pairs."""
    pairs = F.split(col, r"[;,|\r\n]+")
    clean = F.transform(pairs, lambda p: F.concat_ws("=", F.transform(F.split(p, "[=:]", 2), alnum)))
    return F.when(col.isNull(), NULL).otherwise(F.concat_ws(";", F.array_sort(F.filter(clean, lambda p: ~p.isin("", "=")))))


def canonical_key(fields: list[Column]) -> Column:
    return F.concat_ws(SEP, *fields)


class Trie:
    """Counts keys. Edges are the key's fields; a way without branches is kept as one leaf [rest, count, first row], so
    memory goes with the keys and not with their fields. A key that ends where others go on is the leaf under None."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def add(self, key: str | None, count: int, first: int) -> None:
        node, rest = self.root, key
        while True:
            if rest is None:
                edge = tail = None
            else:
                edge, sep, tail = rest.partition(SEP)
                tail = tail if sep else None
            child = node.get(edge)
            if child is None:
                node[edge] = [tail, count, first]
                self.size += 1
                return
            if type(child) is list:
                if child[0] == tail:
                    child[1] += count
                    if first < child[2]:
                        child[2] = first
                    return
                other, n, row = child  # two keys part here: push the leaf one field down
                nxt: dict = {}
                if other is None:
                    nxt[None] = [None, n, row]
                else:
                    head, sep, below = other.partition(SEP)
                    nxt[head] = [below if sep else None, n, row]
                child = node[edge] = nxt
            node, rest = child, tail

    def terminals(self) -> Iterator[tuple[str, int, int]]:
        stack: list[tuple[dict, tuple]] = [(self.root, ())]
        while stack:
            node, path = stack.pop()
            for edge, child in node.items():
                here = path if edge is None else (*path, edge)
                if type(child) is list:
                    yield SEP.join(here if child[0] is None else (*here, child[0])), child[1], child[2]
                else:
                    stack.append((child, here))


def _frame(trie: Trie) -> pd.DataFrame:
    return pd.DataFrame(list(trie.terminals()), columns=["key", "n", "first"])


def _map_side(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = Trie()
    for pdf in batches:
        for key, row in zip(pdf["key"].tolist(), pdf["row"].tolist()):
            trie.add(key, 1, row)
        if trie.size > FLUSH:
            yield _frame(trie)
            trie = Trie()
    yield _frame(trie)


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    for key, n, first in zip(pdf["key"].tolist(), pdf["n"].tolist(), pdf["first"].tolist()):
        trie.add(key, n, first)
    return _frame(trie)


def _parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """prefix, common: how long the beginning is that the least and the greatest key of a prefix share."""
    for pdf in batches:
        common = [len(os.path.commonprefix([lo, hi])) for lo, hi in zip(pdf["lo"], pdf["hi"])]
        yield pd.DataFrame({"prefix": pdf["prefix"], "common": pd.Series(common, dtype="int32")})


def radix_plan(entries: DataFrame, capacity: int = CAPACITY, first: int = FIRST, step: int = STEP) -> list[DataFrame]:
    """The oversized prefixes (prefix, longer: the length its keys are split at) of each level; see the module's docstring."""
    plan: list[DataFrame] = []
    rest = entries.select("key", F.lit(first).alias("length"))
    while True:
        prefix = F.col("key").substr(F.lit(1), F.col("length"))
        over = (
            rest.groupBy(prefix.alias("prefix"))
            .agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
            .where((F.col("n") > capacity) & (F.col("lo") != F.col("hi")))
        )
        split = written(over.select("prefix", "lo", "hi").mapInPandas(_parted, "prefix string, common int").select("prefix", (F.col("common") + step).alias("longer")), "split")
        if not split.limit(1).count():
            return plan
        plan.append(split)
        rest = rest.join(bounded(split), prefix == F.col("prefix")).select("key", F.col("longer").alias("length"))


def with_bucket(entries: DataFrame, plan: list[DataFrame], first: int = FIRST) -> DataFrame:
    """entries with `bucket`: the shortest prefix that needn't be split."""
    out = entries.withColumn("_length", F.lit(first))
    for split in plan:
        prefix = F.col("key").substr(F.lit(1), F.col("_length"))
        out = out.join(bounded(split.withColumnRenamed("prefix", "_prefix")), prefix == F.col("_prefix"), "left")
        out = out.withColumn("_length", F.coalesce("longer", "_length")).drop("_prefix", "longer")
    return out.withColumn("bucket", F.col("key").substr(F.lit(1), F.col("_length"))).drop("_length")


def count_copies(keyed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """keyed(key, row) -> key, n, first: each distinct key with its number of rows and smallest row."""
    entries = written(keyed.select("key", "row").mapInPandas(_map_side, "key string, n long, first long"), "tries")
    bucketed = with_bucket(entries, radix_plan(entries, capacity))
    return bucketed.select("bucket", "key", "n", "first").groupBy("bucket").applyInPandas(_bucket, "key string, n long, first long")


def finding_keys(finding: DataFrame) -> DataFrame:
    """row, key of each finding: the fields that describe it, the most telling ones first."""
    path = F.coalesce("file", "file_path")
    line = F.coalesce("line", "start_line")
    key = canonical_key(
        [canonical(F.col("function")), canonical(line), canonical_pairs(F.col("detail")), canonical(path), canonical(F.col("vuln_type")), canonical(F.col("cwe_id")), canonical(F.col("tool")), canonical(F.col("repo_url"))]
    )
    return finding.select(F.col("finding_row").alias("row"), key.alias("key"))


def collapse(keyed: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """keyed(key, row) -> (terminals: key, n, first; rows with a 128-bit digest of their key in place of it)."""
    kept = written(keyed.withColumns(digest(F.col("key"))), "keys")
    return count_copies(kept, capacity), kept


def digest(key: Column) -> dict[str, Column]:
    return {"h1": F.xxhash64(key), "h2": F.xxhash64(F.lit("findlake"), key)}


def copies(keyed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """first_row, copy_row: for each set of copies its smallest row with every other one.

    Only rows join back whose key has copies; the join is on the 128-bit digest, so a set that holds a third of all
    rows is a skewed side that AQE splits, never a collected group."""
    terminals, kept = collapse(keyed, capacity)
    sets = terminals.where("n > 1").select("first", *[c.alias(k) for k, c in digest(F.col("key")).items()])
    return kept.select("row", "h1", "h2").join(sets, ["h1", "h2"]).where(F.col("row") != F.col("first")).select(F.col("first").alias("first_row"), F.col("row").alias("copy_row"))
