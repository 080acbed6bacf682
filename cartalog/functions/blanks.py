"""Blanks as people and editors see them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of Unicode's categories Zs, Zl and Zp, the controls that count as blanks, and the zero-width no-break space.
BLANKS = "\\u0009-\\u000d\\u001c-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff"


def trim(value: Column) -> Column:
    """Without outer blanks of any kind; null stays null."""
    return F.regexp_replace(value, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def blank_to_null(value: Column) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(trim(value), F.lit(""))
