"""Several values packed in one field: one row per value, with its position.

Each field is cut into tokens (quoted text, signs and words that may separate, ordinary text). Their classes, one character each, are the field's
skeleton: ordinary characters are masked, signs stand for themselves. Fields are many, skeletons few; what a skeleton means (which signs separate,
which tokens make up a value, which lose quotation marks) is resolved once per distinct skeleton, and the rules are joined back, broadcast where
their counted rows allow it. Values are then picked by their position in the token array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartalog.functions.blanks import BLANKS, trim
from cartalog.session import broadcast_if_small, cut

#: Single signs that separate values, among them full-width ones, tabs and line ends.
SIGNS = ";,/|&+；，、｜／＆＋\\t\\n\\r\\u000b\\u000c\\u0085\\u2028\\u2029"
#: Signs of full width, and the signs that they are; tabs and all ends of lines count as one sign.
SAME_SIGNS = ("；，、｜／＆＋\t\r\u000b\u000c\u0085\u2028\u2029", ";,,|/&+\n\n\n\n\n\n\n")
#: Words that join the last values of a list, in the corpus' languages.
WORDS = ("und", "and", "et", "sowie")
#: Opening and closing quotation marks; a closing one doubled inside is text.
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("„", "“”"), ("«", "»"), ("»", "«"), ("‘", "’"), ("‚", "‘’"), ("‹", "›"), ("＂", "＂"))

_WORD = f"(?i:{'|'.join(WORDS)})"
_JOINER = f"(?:(?<=^|[{SIGNS}])|[{BLANKS}]+){_WORD}(?=[{BLANKS}{SIGNS}]|$)"
_ENDS = f"(?=[{BLANKS}]*(?:[{SIGNS}]|$)|[{BLANKS}]+{_WORD}(?:[{BLANKS}{SIGNS}]|$))"
_QUOTED = "|".join(f"[{BLANKS}]*{a}[^{b}]*+(?:(?:{'|'.join(x + x for x in b)})[^{b}]*+)*+[{b}]{_ENDS}" for a, b in QUOTES)
#: Quoted text counts only where a value can begin; elsewhere its marks are ordinary characters, as an apostrophe is.
_AT_START = f"(?<=^|[{SIGNS}]|(?:^|[{SIGNS}{BLANKS}]){_WORD})"
_PLAIN = f"(?:(?!{_JOINER})[^{SIGNS}])+"
TOKEN = f"(?s:{_AT_START}(?:{_QUOTED})|{_JOINER}|[{SIGNS}]|{_PLAIN})"


def tokens(field: Column) -> Column:
    """The field cut into quoted text, separators and ordinary text; nothing is lost."""
    return F.regexp_extract_all(field, F.lit(TOKEN), F.lit(0))


def _class(token: Column) -> Column:
    quoted = F.lit(False)
    for a, b in QUOTES:
        quoted = quoted | token.rlike(f"(?s)^[{BLANKS}]*{a}.*[{b}]$")
    before, after = token.rlike(f"^[{BLANKS}]"), token.rlike(f"[{BLANKS}]$")
    return (
        F.when(token.rlike(f"^[{SIGNS}]$"), F.translate(token, *SAME_SIGNS))
        .when(token.rlike(f"^[{BLANKS}]*{_WORD}$"), "w")
        .when(token.rlike(f"^[{BLANKS}]*$"), "b")
        .when(quoted, "q")
        .when(before & after, "o")
        .when(before, "l")
        .when(after, "r")
        .otherwise("x")
    )


def skeleton(token_array: Column) -> Column:
    """One character per token: a sign stands for itself, w for a joining word, b for blanks, q for quoted text; ordinary text is x, or l, r, o with
    blanks before it, after it, or on both sides."""
    return F.array_join(F.transform(token_array, _class), "")


def resolve(shape: str, tight: str = "") -> list[tuple[int, int, bool]]:
    """(first token, last token, quoted) of each value in a skeleton, tokens from 1.

    A sign among tight, written without blanks between two ordinary texts, belongs to a value if another sign or a word separates elsewhere in the
    skeleton; standing alone, or with blanks, it separates. A word that joins nothing is the value itself.
    """
    inner = {k for k in range(1, len(shape) - 1) if shape[k] in tight and shape[k - 1] in "xl" and shape[k + 1] in "xr"}
    if not any(c not in "xlrobq" and k not in inner for k, c in enumerate(shape)):
        inner = set()
    values: list[tuple[int, int, bool]] = []
    for k, c in enumerate(shape):
        if c in "xlroq" or (c == "w" and not (set(shape[:k]) & set("qxlrow") or set(shape[k + 1 :]) & set("qxlrow"))):
            if k - 1 in inner and values and values[-1][1] == k - 1:
                values[-1] = (values[-1][0], k + 1, False)
            else:
                values.append((k + 1, k + 1, c == "q"))
    return values


def _unquote(token: Column) -> Column:
    body = token.substr(F.lit(2), F.length(token) - 2)
    for mark in ('"', "'", "”", "»", "’", "›", "＂"):
        body = F.when(F.right(token, F.lit(1)) == mark, F.replace(body, F.lit(mark * 2), F.lit(mark))).otherwise(body)
    return body


def split_packed(df: DataFrame, key: str, field: str, least: int = 1, tight: str = "") -> DataFrame:
    """(key, pos, item): the values of each field, pos from 0 as written, for the rows with at least that many values.

    Repeated pairs of key and field count once. A null, empty or blank field has no values; so have empty places, blanks in quotes, and
    words or signs that join. An unclosed quotation mark is ordinary text. tight: signs that belong to a value where they stand without blanks
    and another sign separates, as in S1/2, S3 if it holds /. Other columns of df, whatever their names, play no part. Every token is linear in
    its field, so very long fields only cost their length.
    """
    k, f = "_key", "_field"
    cells = df.select(F.col(key).alias(k), F.col(field).alias(f)).where(F.col(f).isNotNull()).distinct()
    cells = cells.withColumn("tokens", tokens(F.col(f))).withColumn("skeleton", skeleton(F.col("tokens"))).drop(f)
    shapes = cells.groupBy("skeleton").agg(F.lit(1).alias("one")).select("skeleton")

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[{"first": a, "last": b, "quoted": q} for a, b, q in resolve(s, tight)] for s in batch["skeleton"]]
            yield pd.DataFrame({"skeleton": batch["skeleton"], "values": found})

    resolved = cut(shapes.mapInPandas(rules, "skeleton string, values array<struct<first:int,last:int,quoted:boolean>>").where(F.size("values") >= least))
    placed = cells.join(broadcast_if_small(resolved), "skeleton")
    whole = lambda v: F.when(v["first"] == v["last"], F.element_at("tokens", v["first"])).otherwise(F.array_join(F.slice("tokens", v["first"], v["last"] - v["first"] + 1), ""))
    items = placed.select(k, F.transform("values", lambda v: F.struct(trim(whole(v)).alias("t"), v["quoted"].alias("quoted"))).alias("picked"))
    texts = F.filter(F.transform("picked", lambda v: trim(F.when(v["quoted"], _unquote(v["t"])).otherwise(v["t"]))), lambda t: t != "")
    return items.select(k, texts.alias("texts")).where(F.size("texts") >= least).select(F.col(k).alias(key), F.posexplode("texts").alias("pos", "item"))
