"""Conditions on tags and ids, put together to searches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare(column: Column, operator: str, value: Any) -> Column:
    """Operators: = < > <= >=, ^ for begins with, IN for a list."""
    match operator:
        case "^":
            return column.startswith(value)
        case "IN":
            return column.isin(*value) if value else F.lit(False)
        case "=":
            return column == value
        case "<":
            return column < value
        case ">":
            return column > value
        case "<=":
            return column <= value
        case ">=":
            return column >= value
    raise ValueError(f"unknown operator {operator}")


@dataclass(frozen=True)
class FieldConditions:
    """Comparisons that one tag row has to meet together: (column, operator, value)."""

    rules: tuple[tuple[str, str, Any], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [compare(F.col(c), o, v) for c, o, v in self.rules], F.lit(True))


def key_is(key: str, value: str | None = None) -> FieldConditions:
    rules = [("key", "=", key)] + ([("value", "=", value)] if value is not None else [])
    return FieldConditions(tuple(rules))


def key_begins(key: str, value: str) -> FieldConditions:
    return FieldConditions((("key", "=", key), ("value", "^", value)))


def ids_in(ids: Sequence[int]) -> FieldConditions:
    return FieldConditions((("objectid", "IN", tuple(ids)),))
