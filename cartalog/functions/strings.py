"""String functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that trimming takes away, characters that escaping takes away, and the digits of short ids, least significant first.
TRIMMED = " \n\r\t"
ESCAPED = "\"/\\\b\f\n\r\t'"
DIGITS_36 = "abcdefghijklmnopqrstuvwxyz0123456789"
DIGITS_64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def trim(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{TRIMMED}]+|[{TRIMMED}]+$", "")


def trim_left(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{TRIMMED}]+", "")


def trim_right(value: Column) -> Column:
    return F.regexp_replace(value, f"[{TRIMMED}]+$", "")


def erase(value: Column, characters: str) -> Column:
    return F.translate(value, characters, "")


def escape(value: Column) -> Column:
    """Trimmed, without quotes, slashes and controls."""
    return erase(trim(value), ESCAPED)


def quote(value: Column, mark: str = '"') -> Column:
    return F.concat(F.lit(mark), value, F.lit(mark))


def words(value: Column) -> Column:
    """Split at blanks, without empty words."""
    return F.filter(F.split(value, "\\s+"), lambda w: w != "")


def filter_words(word_array: Column) -> Column:
    """Words without punctuation, empty ones left out."""
    return F.filter(F.transform(word_array, lambda w: F.regexp_replace(w, "\\p{Punct}", "")), lambda w: w != "")


def prefix(value: Column, length: int) -> Column:
    return F.left(value, F.lit(length))


def tokenize(value: Column, delimiter: str = ",", omit: bool = False) -> Column:
    """Split at a delimiter outside double quotes; quotes stay. For blanks, omit drops the empty tokens of runs and ends.

    Null where the quotes are unbalanced.
    """
    mark = {" ": " ", "|": "\\|", ".": "\\.", "+": "\\+", "*": "\\*"}.get(delimiter, delimiter)
    parts = F.split(value, f'{mark}(?=(?:[^"]*"[^"]*")*[^"]*$)')
    if omit and delimiter == " ":
        parts = F.filter(parts, lambda t: t != "")
    quotes = F.length(value) - F.length(F.translate(value, '"', ""))
    return F.when(quotes % 2 == 0, parts)


def _digits(number: Column, alphabet: str) -> Column:
    """A whole number's digits, the least significant first; 0 has one digit."""
    base = len(alphabet)
    steps = F.sequence(F.lit(1), F.lit(13 if base == 36 else 11))
    start = F.struct(number.cast("bigint").alias("left"), F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        digit = F.substr(F.lit(alphabet), (state["left"] % base + 1).cast("int"), F.lit(1))
        rest = ((state["left"] - state["left"] % base) / base).cast("bigint")
        return F.struct(
            F.when(state["done"], state["left"]).otherwise(rest).alias("left"),
            F.when(state["done"], state["text"]).otherwise(F.concat(state["text"], digit)).alias("text"),
            (state["done"] | (rest == 0)).alias("done"),
        )

    return F.aggregate(steps, start, step)["text"]


def base36(number: Column) -> Column:
    """Little-endian digits a-z, 0-9: 0 is a, 36 is ab. Exact up to 2**53."""
    return _digits(number, DIGITS_36)


def base64_number(number: Column) -> Column:
    """Little-endian digits A-Z, a-z, 0-9, + and /."""
    return _digits(number, DIGITS_64)


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(F.encode(value, "UTF-8")))


def base64_text(value: Column) -> Column:
    return F.base64(F.encode(value, "UTF-8"))


def base64_decoded(value: Column) -> Column:
    """The text; null where the value is no base64."""
    return F.decode(F.try_to_binary(value, F.lit("base64")), "UTF-8")


def lexical_int(value: Column) -> Column:
    """The leading whole number, 0 where there is none."""
    return F.coalesce(F.regexp_extract(value, "^\\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def search_words(value: Column) -> Column:
    """Distinct words of full-text search: lower case, without accents, cut at all but letters, digits and #, & and +."""
    plain = F.lower(value)
    for bare, accented in (("a", "áàâãäå"), ("c", "ç"), ("e", "éèêë"), ("i", "íìîï"), ("n", "ñ"), ("o", "óòôõö"), ("u", "úùûü"), ("y", "ýÿ")):
        plain = F.translate(plain, accented, bare * len(accented))
    return F.array_distinct(F.filter(F.split(plain, "[^\\p{L}\\p{N}#&+]+"), lambda w: w != ""))
