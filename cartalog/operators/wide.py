"""Attribute-value rows into wide tables with typed columns.

First each entity's deciding row per attribute is found by a partial aggregation, so an entity with a third of all rows shrinks to one
row per attribute before anything is shuffled. Its value is parsed natively to the attribute's type. The few rows left are sorted by entity
within partitions, attributes encoded as column indices, and streamed into columnar batch builders: one typed buffer and one validity
mask per column, filled by index, handed over as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartalog.functions.blanks import trim

#: Words for yes and no.
TRUE = ("yes", "y", "true", "t", "1", "on", "ja", "j", "wahr", "oui", "o", "vrai")
FALSE = ("no", "n", "false", "f", "0", "off", "nein", "falsch", "non", "faux")
#: Metric units of length as people write them, and their powers of ten in metres.
UNITS = (("m|metres?|meters?|mètres?", 0), ("cm|centimetres?|zentimeter", -2), ("mm|millimetres?|millimeter", -3), ("dm", -1), ("km|kilometres?|kilometer", 3))
#: How the names of the months begin in English, German and French.
MONTHS = ("jan", "feb|fév|fev", "mar|mär|mrz", "apr|avr", "may|mai", "jun|juin", "jul|juil", "aug|aoû|aou", "sep", "oct|okt", "nov", "dec|dez|déc")


@dataclass(frozen=True)
class Attribute:
    """A column of the wide table: kind is text, boolean, whole, length (metres) or date."""

    name: str
    kind: str


def _plain(value: Column) -> Column:
    return F.translate(trim(value), "−–＋", "--+")


def parse_boolean(value: Column) -> Column:
    word = F.lower(trim(value))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def _replaced(value: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        value = F.regexp_replace(value, pattern, by)
    return value


def parse_whole(value: Column) -> Column:
    """A whole number: a sign, marks between groups of three digits, and decimals that are all 0 are allowed."""
    mark = "[, \u00a0\u202f'’]"
    v = _replaced(_plain(value), ("\\.0*$", ""), (f"(?<=(?:^|[^0-9])[0-9]{{1,3}}){mark}(?=[0-9]{{3}}(?:{mark}[0-9]{{3}})*$)", ""))
    return F.regexp_extract(v, "^[+-]?[0-9]+$", 0).try_cast("bigint")


def parse_length(value: Column) -> Column:
    """Metres: a number, whose comma marks decimals, and perhaps a metric unit, which is read as a power of ten."""
    v = _replaced(F.lower(_plain(value)), ("^([+-]?[0-9]*),", "$1."))
    v = _replaced(v, *[(f"^([+-]?[0-9]*\\.?[0-9]*)\\s*(?:{words})\\.?$", f"$1e{power}") for words, power in UNITS])
    return F.regexp_extract(v, "^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:e-?[0-9])?$", 0).try_cast("double")


def parse_date(value: Column) -> Column:
    """A day that exists: year first, or with dots the day first, or with the month's name; a time of day is left out."""
    v = _replaced(
        F.lower(trim(value)),
        ("(?<=[0-9])(?:t|\\s+)[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?:z|[+-][0-9]{2}:?[0-9]{2})?$", ""),
        ("^([0-9]{4})([-/.])([0-9]{1,2})\\2([0-9]{1,2})$", "$1-$3-$4"),
        ("^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3"),
        ("^([0-9]{1,2})\\.\\s*([0-9]{1,2})\\.\\s*([0-9]{4})$", "$3-$2-$1"),
        ("^(\\p{L}{3,})\\.?\\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\\s+([0-9]{4})$", "$2 $1 $3"),
        *[(f"^([0-9]{{1,2}})(?:st|nd|rd|th|er|\\.)?[ -]*(?:{starts})\\p{{L}}*\\.?,?[ -]*([0-9]{{4}})$", f"$2-{k}-$1") for k, starts in enumerate(MONTHS, 1)],
    )
    return F.try_to_timestamp(v, F.lit("yyyy-M-d")).cast("date")


_ARROW = {"text": pa.string(), "boolean": pa.bool_(), "whole": pa.int64(), "length": pa.float64(), "date": pa.date32()}
_SPARK = {"text": "string", "boolean": "boolean", "whole": "bigint", "length": "double", "date": "date"}


def deciding_rows(df: DataFrame, entity: str, key: str, value: str, order: Sequence[str], attributes: Sequence[Attribute]) -> DataFrame:
    """(entity, col, value): of each entity and attribute, the value of the row that comes last by the order's columns.

    Keys count without outer blanks and letter case. Rows that tie in all of the order's columns are told apart by value, null lowest.
    """
    place = F.create_map(*[x for k, a in enumerate(attributes) for x in (F.lit(a.name.lower()), F.lit(k))])
    rows = df.select(F.col(entity).alias("entity"), F.lower(trim(F.col(key))).alias("key"), F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(value).alias("value")).alias("row"))
    rows = rows.where(F.col("entity").isNotNull() & F.col("key").isin(*[a.name.lower() for a in attributes])).withColumn("col", place[F.col("key")])
    return rows.groupBy("entity", "col").agg(F.max("row").alias("row")).select("entity", "col", F.col("row.value").alias("value"))


def _builder(attributes: Sequence[Attribute], entity_type: pa.DataType):
    """Streams rows sorted by entity into Arrow batches: buffers typed by column, masks of which places are filled."""
    schema = pa.schema([("entity", entity_type)] + [(f"c{k}", _ARROW[a.kind]) for k, a in enumerate(attributes)])
    numbers = {"boolean": np.bool_, "whole": np.int64, "length": np.float64, "date": np.int32}

    def build(table: pa.Table) -> pa.RecordBatch:
        entities = table.column("entity").combine_chunks()
        same = np.zeros(len(entities), dtype=np.int64)
        if len(entities) > 1:
            same[1:] = np.cumsum(np.asarray(pa.compute.not_equal(entities[1:], entities[:-1]).to_numpy(zero_copy_only=False), dtype=np.int64))
        count = int(same[-1]) + 1
        starts = np.searchsorted(same, np.arange(count))
        cols = table.column("col").to_numpy()
        out = [entities.take(pa.array(starts))]
        whole, real = table.column("whole").to_numpy(), table.column("real").to_numpy()
        for k, a in enumerate(attributes):
            at = np.flatnonzero(cols == k)
            missing = np.ones(count, dtype=bool)
            missing[same[at]] = False
            if a.kind == "text":
                places = np.full(count, -1, dtype=np.int64)
                places[same[at]] = at
                out.append(table.column("text").combine_chunks().take(pa.array(np.where(missing, 0, places), mask=missing)))
                continue
            buffer = np.zeros(count, dtype=numbers[a.kind])
            buffer[same[at]] = (real if a.kind == "length" else whole)[at]
            out.append(pa.array(buffer, mask=missing).cast(_ARROW[a.kind]) if a.kind != "date" else pa.array(buffer, type=pa.int32(), mask=missing).cast(pa.date32()))
        return pa.RecordBatch.from_arrays(out, schema=schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last entity of a batch may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            entities = rows.column("entity").combine_chunks()
            last = entities[-1]
            end = len(entities)
            while end and entities[end - 1] == last:  # at most one row per attribute
                end -= 1
            if end:
                yield build(rows.slice(0, end))
            held = rows.slice(end)
        if held is not None and held.num_rows:
            yield build(held)

    return stream


def to_wide(df: DataFrame, entity: str, key: str, value: str, order: Sequence[str], attributes: Sequence[Attribute]) -> DataFrame:
    """One row per entity that has any value: the entity and a typed column per attribute, null where there is no current value.

    The row that is last by the order's columns decides; a null value, or one that is not a single value of the attribute's kind, leaves the
    place empty. Rows without entity or key are left out; repeated rows change nothing; an empty table gives an empty one. The input's
    other columns, whatever their names, play no part. Texts are trimmed, and blank ones count as none; they may be of any length.
    """
    kinds = {k: a.kind for k, a in enumerate(attributes)}
    parsers = {"boolean": lambda v: parse_boolean(v).cast("bigint"), "whole": parse_whole, "date": lambda v: F.unix_date(parse_date(v)).cast("bigint")}

    def of_kind(kind: str) -> Column:
        return F.col("col").isin(*[k for k, x in kinds.items() if x == kind])

    whole = F.lit(None).cast("bigint")
    for kind, parse in parsers.items():
        if kind in kinds.values():
            whole = F.when(of_kind(kind), parse(F.col("value"))).otherwise(whole)
    present = deciding_rows(df, entity, key, value, order, attributes).where(F.col("value").isNotNull())
    has = lambda kind: kind in kinds.values()
    typed = present.select(
        "entity",
        "col",
        whole.alias("whole"),
        (F.when(of_kind("length"), parse_length(F.col("value"))) if has("length") else F.lit(None).cast("double")).alias("real"),
        (F.when(of_kind("text"), F.nullif(trim(F.col("value")), F.lit(""))) if has("text") else F.lit(None).cast("string")).alias("text"),
    ).where(F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull(), F.lit(False)))
    ready = typed.select("entity", "col", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("real", F.lit(0.0)).alias("real"), "text")
    ready = ready.repartition("entity").sortWithinPartitions("entity", "col")
    entity_field = df.schema[entity].dataType
    entity_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[entity_field.simpleString()]
    wide = ready.mapInArrow(_builder(attributes, entity_arrow), f"entity {entity_field.simpleString()}, " + ", ".join(f"c{k} {_SPARK[a.kind]}" for k, a in enumerate(attributes)))
    return wide.select(F.col("entity").alias(entity), *[F.col(f"c{k}").alias(a.name) for k, a in enumerate(attributes)])


def to_long(wide: DataFrame, entity: str, attributes: Sequence[Attribute]) -> DataFrame:
    """(entity, attr, val): the filled places of a wide table as text; booleans as true and false, lengths with two decimals, days as YYYY-MM-DD."""
    texts = []
    for a in attributes:
        c = F.col(f"`{a.name}`")
        if a.kind == "length":
            # Adding 0 makes -0.0 plain 0.
            c = F.format_string("%.2f", F.bround(c, 2) + F.lit(0.0))
            c = F.when(F.col(f"`{a.name}`").isNotNull(), c)
        elif a.kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        else:
            c = c.cast("string")
        texts.append(F.struct(F.lit(a.name).alias("attr"), c.alias("val")))
    return wide.select(entity, F.inline(F.array(*texts))).where(F.col("val").isNotNull())
