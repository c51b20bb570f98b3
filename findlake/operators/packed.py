"""Several values packed in one field: one row per value, with its position.

The text is split on its quote characters. Pieces outside quotes are split on delimiters; pieces inside are
literals. Which pieces are inside is found by one fold over the pieces (a SQL array aggregate), whose state is the
open quote character: an odd piece behind an opening quote is a literal until the same quote closes it, another
quote character inside is an ordinary one, a doubled quote or one behind a backslash is an escaped one, and a quote
character in the middle of an unquoted value (an apostrophe) opens nothing. The fold reassembles the values in order.

Everything is a built-in expression on one row: no shuffle, no Python; the number of output rows is that of the values.

Defined cases: a null, empty or blank text, a pair of empty brackets and the words of NO_VALUES give no row; empty
pieces are not numbered; blanks, quotes and one pair of enclosing brackets are not part of a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that say that there is no value, in lower case.
NO_VALUES = ("none", "null", "nil", "nan", "n/a", "na", "-", "--", "?", "root", "no parent", "no parents", "<none>", "undefined")
#: Delimiters outside quotes: comma, semicolon, bar, white space; a slash or plus sign only if it stands alone.
DELIMITERS = r"(?:[,;|\s\u00a0]|(?<=\s)[/+&](?=\s))+"
_BLANK = r"^[\s\u00a0]+|[\s\u00a0]+$"
_BRACKETS = r"^[\s\u00a0]*(?:\[([\s\S]*)\]|\(([\s\S]*)\)|\{([\s\S]*)\})[\s\u00a0]*$"
#: A piece boundary before and behind each quote character.
_QUOTES = r"(?=[\"'])|(?<=[\"'])"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, _BLANK, "")


def unwrapped(text: Column) -> Column:
    """The text without one pair of enclosing brackets."""
    return F.regexp_replace(text, _BRACKETS, "$1$2$3")


def split_packed(text: Column) -> Column:
    """array<string> of the values packed in text, in order; empty for null and texts without values."""
    body = strip(unwrapped(text))
    pieces = F.split(body, _QUOTES)
    # q: open quote, '' outside; cur: value being built; lit: whether cur holds a literal; last: the quote that has just closed
    start = F.struct(
        F.lit("").alias("q"), F.lit("").alias("cur"), F.lit(False).alias("lit"), F.lit("").alias("last"), F.array().cast("array<string>").alias("out")
    )

    def state(q: Column, cur: Column, lit: Column, last: Column, out: Column) -> Column:
        return F.struct(q.alias("q"), cur.alias("cur"), lit.alias("lit"), last.alias("last"), out.alias("out"))

    def step(s: Column, p: Column) -> Column:
        quote = p.isin('"', "'")
        outside = s["q"] == ""
        escaped = s["cur"].endswith("\\")
        # outside, a text piece: its first part continues the current value, each delimiter ends one
        parts = F.split(F.concat(s["cur"], p), DELIMITERS)
        literal_parts = F.split(p, DELIMITERS)
        done = F.slice(parts, 1, F.size(parts) - 1)
        after_literal = F.concat(F.array(F.concat(s["cur"], F.element_at(literal_parts, 1))), F.slice(literal_parts, 2, F.greatest(F.size(literal_parts) - 2, F.lit(0))))
        text_state = (
            F.when(s["lit"] & (F.size(literal_parts) == 1), state(s["q"], F.concat(s["cur"], p), s["lit"], F.lit(""), s["out"]))
            .when(s["lit"], state(F.lit(""), F.element_at(literal_parts, -1), F.lit(False), F.lit(""), F.concat(s["out"], after_literal)))
            .otherwise(state(F.lit(""), F.element_at(parts, -1), F.lit(False), F.lit(""), F.concat(s["out"], done)))
        )
        return (
            F.when(~outside & quote & escaped, state(s["q"], F.concat(F.substring(s["cur"], 1, F.length(s["cur"]) - 1), p), s["lit"], F.lit(""), s["out"]))
            .when(~outside & (p == s["q"]), state(F.lit(""), s["cur"], F.lit(True), p, s["out"]))
            .when(~outside, state(s["q"], F.concat(s["cur"], p), s["lit"], F.lit(""), s["out"]))
            .when(quote & (s["last"] == p), state(p, F.concat(s["cur"], p), F.lit(True), F.lit(""), s["out"]))  # doubled
            .when(quote & (strip(s["cur"]) == ""), state(p, F.lit(""), F.lit(True), F.lit(""), s["out"]))
            .when(quote, state(F.lit(""), F.concat(s["cur"], p), s["lit"], F.lit(""), s["out"]))
            .otherwise(text_state)
        )

    folded = F.aggregate(pieces, start, step, lambda s: F.concat(s["out"], F.array(s["cur"])))
    values = F.filter(F.transform(folded, strip), lambda v: v != "")
    nothing = F.coalesce(F.lower(strip(text)).isin("", *NO_VALUES) | F.lower(body).isin("", *NO_VALUES), F.lit(True))
    return F.when(nothing, F.array().cast("array<string>")).otherwise(values)


def unpack(df: DataFrame, key: str, packed: str, *, position: str = "position", value: str = "value") -> DataFrame:
    """key, position (from 1), value: one row per value packed in the column."""
    values = df.select(key, split_packed(F.col(packed)).alias("_v"))
    return values.select(key, F.posexplode("_v").alias("_p", value)).select(key, (F.col("_p") + 1).alias(position), value)
