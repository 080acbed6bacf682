"""An immutable relational query builder over DataFrames; Catalyst plans what it builds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The key column of each table of a map file, by name.
PRIMARY_KEYS = {"vertex": "verid", "vertexpoint": "vertexid", "osm": "objectid", "osm_id": "internal_id", "osm_fulltext": "docid", "osm_rel": "groupid", "osm_tag": "en", "osm_tag_hash": "tag", "addrdecoder_areas": "id", "map_info": "objectid"}
OPERATORS = {"=": "__eq__", "<>": "__ne__", "!=": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}


@dataclass(frozen=True)
class Query:
    """Each call gives a new query. Conditions are AND-ed, ascending keys come before descending ones, limit 0 is none.

    A query without conditions is the identity of unite() and intersect(), as operand and as receiver.
    """

    source: DataFrame | None = None
    columns: tuple[str, ...] = ()
    conditions: tuple[Column, ...] = ()
    semi: tuple[tuple[str, DataFrame], ...] = ()
    group: str = ""
    filters: tuple[Column, ...] = ()
    ascending: tuple[str, ...] = ()
    descending: tuple[str, ...] = ()
    most: int = 0
    skipped: int = 0
    sets: tuple[tuple[str, Query], ...] = field(default=())

    def select(self, *columns: str) -> Query:
        """Columns or expressions; a first one that begins with DISTINCT makes the result distinct."""
        return replace(self, columns=columns)

    def from_(self, source: DataFrame | Query | Sequence[DataFrame], alias: str = "") -> Query:
        """A table, a query, or several tables to be joined by conditions."""
        if isinstance(source, Query):
            source = source.build()
        if not isinstance(source, DataFrame):
            source = reduce(lambda a, b: a.join(b), source)
        return replace(self, source=source.alias(alias) if alias else source)

    def where(self, column: str | Column, operator: str | None = None, value: Any = None) -> Query:
        condition = getattr(F.col(column), OPERATORS[operator])(value) if operator else F.expr(column) if isinstance(column, str) else column
        return replace(self, conditions=(*self.conditions, condition))

    def between(self, column: str, low: Any, high: Any) -> Query:
        return self.where(F.col(column).between(low, high))

    def has_prefix(self, column: str, value: str) -> Query:
        return self.where(F.col(column).startswith(value))

    def in_(self, column: str, values: Sequence | Query | DataFrame) -> Query:
        """In a list, which may be empty and then holds nothing, or in the first column of a query."""
        if isinstance(values, Query):
            values = values.build()
        if isinstance(values, DataFrame):
            return replace(self, semi=(*self.semi, (column, values)))
        return self.where(F.col(column).isin(*values) if values else F.lit(False))

    def in_any(self, column: str, queries: Sequence[Query]) -> Query:
        """In any of several queries."""
        keys = [q.build().select(F.expr("*")).toDF(column) for q in queries]
        return self.in_(column, reduce(lambda a, b: a.union(b), keys))

    def match(self, column: str, words: Sequence[str]) -> Query:
        """An array of words has all of the words; one that ends with * stands for all that begin so."""

        def has(word: str) -> Column:
            return F.exists(column, lambda t: t.startswith(word[:-1])) if word.endswith("*") else F.array_contains(column, word)

        return reduce(lambda q, w: q.where(has(w)), words, self)

    def join(self, other: DataFrame, columns: Sequence[str]) -> Query:
        return replace(self, source=self.source.join(other, list(columns)))

    def join_all(self, others: Sequence[DataFrame], columns: Sequence[str]) -> Query:
        return reduce(lambda q, o: q.join(o, columns), others, self)

    def group_by(self, column: str) -> Query:
        return replace(self, group=column)

    def having(self, condition: str) -> Query:
        return replace(self, filters=(*self.filters, F.expr(condition)))

    def order_asc(self, *columns: str) -> Query:
        return replace(self, ascending=(*self.ascending, *columns))

    def order_desc(self, *columns: str) -> Query:
        return replace(self, descending=(*self.descending, *columns))

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skipped=n)

    def unite(self, other: Query) -> Query:
        return self._combined("union", other)

    def intersect(self, other: Query) -> Query:
        return self._combined("intersect", other)

    def _combined(self, kind: str, other: Query) -> Query:
        if not other.is_valid():
            return self
        return replace(self, sets=(*self.sets, (kind, other))) if self.is_valid() else other

    def is_valid(self) -> bool:
        return bool(self.conditions or self.semi or self.sets)

    def build(self) -> DataFrame:
        df = self.source
        for condition in self.conditions:
            df = df.where(condition)
        for column, keys in self.semi:
            df = df.join(keys.toDF(column), column, "left_semi")
        distinct = bool(self.columns) and self.columns[0].upper().startswith("DISTINCT ")
        columns = [self.columns[0][9:], *self.columns[1:]] if distinct else list(self.columns)
        if self.group:
            keys = [k.strip() for k in self.group.split(",")]
            df = df.groupBy(*keys).agg(*[F.expr(c) for c in columns if c not in keys])
            for condition in self.filters:
                df = df.where(condition)
            df = df.selectExpr(*[c.split(" AS ")[-1].split(" as ")[-1] for c in columns])
        elif columns:
            df = df.selectExpr(*columns)
        df = df.distinct() if distinct else df
        for kind, other in self.sets:
            df = df.union(other.build()).distinct() if kind == "union" else df.intersect(other.build())
        if self.ascending or self.descending:
            df = df.orderBy(*[F.asc(c) for c in self.ascending], *[F.desc(c) for c in self.descending])
        df = df.offset(self.skipped) if self.skipped else df
        return df.limit(self.most) if self.most else df


def create_table(columns: Sequence[tuple[str, str]]) -> StructType:
    """The schema of a table of (name, type) pairs."""
    return StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in columns))


def primary_key(table: str, columns: Sequence[str] = ()) -> str:
    """The key column of a known table, else the first of the columns."""
    return PRIMARY_KEYS.get(table, columns[0] if columns else "")


def exists_table(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def explain(df: DataFrame) -> str:
    """The formatted plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def next_id(df: DataFrame, column: str) -> DataFrame:
    """One row: the largest id and one; 1 for an empty table."""
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def bounds(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row: north, west, south and east of all points."""
    return df.agg(F.max(lat).alias("hi_lat"), F.min(lon).alias("hi_lon"), F.min(lat).alias("lo_lat"), F.max(lon).alias("lo_lon"))


def dense_ids(df: DataFrame, column: str, name: str = "dense_id") -> DataFrame:
    """Each distinct value with a whole number from 0 on, in the values' order.

    Ranges of the sorted values are numbered in parallel, each from the count of what lies before it.
    """
    from pyspark.sql import Window

    from cartalog.session import cut

    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = cut(values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count()  # one row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    within = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1)
    return within.join(F.broadcast(before), "_part").select(column, (F.col("_before") + F.col("_row")).alias(name))
