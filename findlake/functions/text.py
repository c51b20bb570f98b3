"""Scalar functions on text: names, paths, hashes, redaction, look-alikes, references. Built-in expressions, so they stay
in the JVM; what no built-in can express (edit distance with transpositions, comment lexing, MACs) is Arrow-batched.
Null gives null unless stated."""

from __future__ import annotations

import hashlib
import hmac
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of secrets and what takes their place, applied in this order.
SECRETS = [
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[token]"),
    (r"AKIA[0-9A-Z]{16}", "[key]"),
    (r"([Bb]earer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1[token]"),
    (r"((?:password|passwd|secret|token|api_key)\s*[=:]\s*)[^\s,;&\"']+", "$1[redacted]"),
    (r"(https?://)[^/\s:@]+:[^/\s@]+@", "$1[redacted]@"),
]
#: Characters that look like others.
LOOKALIKES = ("0135", "oles")
#: Idioms of a text, the first that matches being the primary one.
IDIOMS = {
    "injection": r"(?i)\b(sql|command) injection|shell without quoting",
    "overflow": r"(?i)overflow|more than the buffer",
    "use_after_free": r"(?i)free the same|double free|use after free",
    "race": r"(?i)race condition|lock is released",
    "secret": r"(?i)secret to the log|hardcoded",
    "traversal": r"(?i)escapes the upload directory|path traversal",
}


def package_name(ecosystem: Column, name: Column) -> Column:
    """PyPI: runs of . _ - as one dash, lower case; npm and crates.io: lower case; others as they are."""
    pypi = F.lower(F.regexp_replace(name, r"[-_.]+", "-"))
    return F.when(F.lower(ecosystem) == "pypi", pypi).when(F.lower(ecosystem).isin("npm", "crates.io", "cargo"), F.lower(name)).otherwise(name)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def slice_lines(text: Column, first: int, last: int) -> Column:
    """Lines first..last, counted from 1 and inclusive."""
    return F.array_join(F.slice(lines(text), first, last - first + 1), "\n")


def span_hash(text: Column, first: int, last: int) -> Column:
    return F.substring(F.sha2(slice_lines(text, first, last), 256), 1, 12)


def tree_hash(hashes: Column) -> Column:
    """One hash of a set of hashes, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(hashes), ""), 256)


def redact(text: Column) -> Column:
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    return text


def repo_slug(url: Column) -> Column:
    """owner/repo of a forge URL in lower case, without .git and trailing punctuation; null if there is none."""
    slug = F.regexp_extract(F.lower(url), r"https?://[^/\s]+/([^/\s]+/[^/#?\s]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(slug, r"[)\]>,.;]+$", ""), r"\.git$", "")
    return F.when(bare != "", bare)


def spdx_operands(text: Column) -> Column:
    """The operands of a compound licence expression; an empty array for anything else."""
    compound = F.trim(text).rlike(r"^[A-Za-z0-9.+\-]+(?:\s+(?:AND|OR|WITH)\s+[A-Za-z0-9.+\-]+)+$")
    return F.when(compound, F.split(F.trim(text), r"\s+(?:AND|OR|WITH)\s+")).otherwise(F.array().cast("array<string>"))


def image_ref(ref: Column) -> Column:
    """struct<registry, repository, tag, digest> of a container image reference, with the customary defaults."""
    digest = F.regexp_extract(ref, r"@(sha256:[0-9a-f]+)$", 1)
    rest = F.regexp_replace(ref, r"@sha256:[0-9a-f]+$", "")
    tag = F.regexp_extract(rest, r":([^/:]+)$", 1)
    name = F.regexp_replace(rest, r":[^/:]+$", "")
    host = F.regexp_extract(name, r"^([^/]*[.:][^/]*|localhost)/", 1)
    path = F.when(host != "", F.regexp_replace(name, r"^[^/]+/", "")).otherwise(F.when(~F.contains(name, F.lit("/")), F.concat(F.lit("library/"), name)).otherwise(name))
    return F.struct(
        F.when(host != "", host).otherwise("docker.io").alias("registry"), path.alias("repository"),
        F.when(tag != "", tag).when(digest == "", "latest").alias("tag"), F.when(digest != "", digest).alias("digest"),
    )


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """pkg:type/name@version; the version is left out if it is null."""
    kind = F.lower(ecosystem)
    base = F.concat(F.lit("pkg:"), F.regexp_replace(kind, r"[^a-z0-9.+-]", ""), F.lit("/"), name)
    return F.when(version.isNotNull(), F.concat(base, F.lit("@"), version)).otherwise(base)


def wheel_tags(filename: Column) -> Column:
    """array<struct<python, abi, platform>>: the tag triples of a wheel file name; empty if it isn't one."""
    parts = F.split(F.regexp_replace(filename, r"\.whl$", ""), "-")
    get = lambda k: F.split(F.try_element_at(parts, F.lit(k)), r"\.")
    triples = F.flatten(F.flatten(F.transform(get(-3), lambda p: F.transform(get(-2), lambda a: F.transform(get(-1), lambda x: F.struct(p.alias("python"), a.alias("abi"), x.alias("platform")))))))
    empty = F.array().cast("array<struct<python:string,abi:string,platform:string>>")
    return F.when(filename.endswith(".whl") & (F.size(parts) >= 5), triples).otherwise(empty)


def numeric_version(text: Column) -> Column:
    """array<decimal(38)> of the first dotted number in a text; null if there is none. Arrays order part by part; a part
    of more than 38 digits is null."""
    found = F.regexp_extract(text, r"(\d+(?:\.\d+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.try_cast("decimal(38,0)")))


def display_rule(rule: Column) -> Column:
    """The last part of a rule id with blanks and capitals."""
    return F.initcap(F.regexp_replace(F.regexp_extract(rule, r"([^./:]+)$", 1), "[_-]+", " "))


def collapse_lookalikes(name: Column) -> Column:
    """Lower case, digits that look like letters replaced, joins and a plural or js/py suffix dropped."""
    swapped = F.translate(F.lower(name), *LOOKALIKES)
    return F.regexp_replace(F.regexp_replace(swapped, r"[-_.]+", ""), r"(js|py|s)$", "")


def char_mask(name: Column) -> Column:
    """Bit mask of the letters a..z that a name has."""
    letters = F.filter(F.split(F.lower(name), ""), lambda c: c.between("a", "z"))
    return F.aggregate(letters, F.lit(0), lambda m, c: m.bitwiseOR(F.pow(F.lit(2), F.ascii(c) - 97).cast("int")))


def idioms(text: Column) -> Column:
    """array<string> of the idioms whose pattern matches, in the order of IDIOMS."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in IDIOMS.items()]))


def finding_key(producer: Column, rule: Column, *places: Column) -> Column:
    """producer_rule_hash12: a stable id of a finding."""
    slug = F.regexp_replace(F.lower(rule), "[^a-z0-9]+", "-")
    return F.concat_ws("_", producer, slug, F.substring(F.sha2(F.concat_ws("|", producer, rule, *places), 256), 1, 12))


def json_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as compact JSON with sorted keys; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def coerce_number(text: Column, default: float = 0.0) -> Column:
    """The number in a text; the default for anything else and for values that are not finite."""
    value = text.try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, value).otherwise(F.lit(default))


def osa_distance(a: str, b: str, cutoff: int) -> int:
    """Optimal string alignment (a swap of neighbours costs 1); the cutoff if it is that or more."""
    if abs(len(a) - len(b)) >= cutoff:
        return cutoff
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) >= cutoff:
            return cutoff
        before, last = last, row
    return min(last[-1], cutoff)


def osa(cutoff: int):  # noqa: ANN201
    """Pandas UDF (a, b) -> int."""

    @F.pandas_udf(T.IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else osa_distance(x, y, cutoff) for x, y in zip(a, b)], dtype="Int32")

    return distance


def byte_entropy(text: str) -> float:
    data = text.encode()
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0.0


@F.pandas_udf(T.DoubleType())
def entropy(text: pd.Series) -> pd.Series:
    """Shannon entropy of the UTF-8 bytes, 0 to 8 bits."""
    return pd.Series([None if t is None else byte_entropy(t) for t in text], dtype="float64")


def strip_comments(text: str, language: str) -> str:
    """The text without comments; quotes are respected, and line ends stay."""
    line_mark = "#" if language in ("python", "ruby", "shell") else "//"
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c in "\"'`":
            j = i + 1
            while j < n and text[j] != c:
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith(line_mark, i):
            i = text.find("\n", i) if "\n" in text[i:] else n
        elif line_mark == "//" and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            block = text[i : end + 2 if end >= 0 else n]
            out.append("\n" * block.count("\n"))
            i += len(block)
        else:
            out.append(c)
            i += 1
    return "".join(out)


def blank_noncode(text: str) -> str:
    """The text with strings and comments as blanks of the same length, so that offsets stay."""
    out = list(text)
    i, n = 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        if text[i] in "\"'`":
            j = i + 1
            while j < n and text[j] != text[i]:
                j += 2 if text[j] == "\\" else 1
            blank(i, j + 1)
            i = j + 1
        elif text.startswith("//", i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            blank(i, j)
            i = j
        else:
            i += 1
    return "".join(out)


def row_mac(secret: bytes):  # noqa: ANN201
    """Pandas UDF text -> HMAC-SHA256 in hex. The secret travels with the function, never in SQL text."""

    @F.pandas_udf(T.StringType())
    def mac(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hmac.new(secret, t.encode(), hashlib.sha256).hexdigest() for t in text], dtype="object")

    return mac
