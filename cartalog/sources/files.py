"""Feeds, configurations, and sinks."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a timetable feed's files that are read, with their types; others are ignored.
FEED = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string",
    "routes": "route_id string, route_short_name string, route_long_name string, agency_id string, route_type string",
    "trips": "trip_id string, route_id string, service_id string, trip_short_name string, shape_id string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "shapes": "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double, shape_dist_traveled double",
}


def read_feed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file of a feed by its header: known columns cast, missing ones null, rows with another number of fields dropped."""
    header = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.txt")
    # With pruned columns the parser would not see how many fields a row has.
    raw = spark.read.option("header", True).option("columnPruning", False).option("mode", "DROPMALFORMED").option("quote", '"').option("escape", '"').schema(header.schema).csv(f"{folder}/{name}.txt")
    raw = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
    out = []
    for part in FEED[name].split(", "):
        column, kind = part.split(" ")
        out.append((F.trim(F.col(column)).try_cast(kind) if column in raw.columns else F.lit(None).cast(kind)).alias(column))
    return raw.select(*out)


def write_feed(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_table(df: DataFrame, folder: str, name: str, cluster_by: tuple[str, ...] = ()) -> int:
    """A parquet table, ranged and sorted by columns that queries filter by; returns the rows written, as read back."""
    ordered = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    ordered.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return df.sparkSession.read.parquet(f"{folder}/{name}.parquet").count()


def write_pipes(df: DataFrame, folder: str, name: str) -> None:
    """Lines of values with pipes between, as bulk imports read them."""
    df.write.mode("overwrite").option("sep", "|").option("header", False).csv(f"{folder}/{name}")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def xml_row(columns: list[str], tag: str = "row") -> Column:
    """An element with a child per column; marks of XML in values are written as entities, nulls left out."""

    def safe(value: Column) -> Column:
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            value = F.replace(value, F.lit(sign), F.lit(entity))
        return value

    parts = [F.coalesce(F.concat(F.lit(f"<{c}>"), safe(F.col(c).cast("string")), F.lit(f"</{c}>")), F.lit("")) for c in columns]
    return F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag}>"))


def find_file(folder: str, name: str) -> str | None:
    """The first file of that name, nearest levels first."""
    level = [Path(folder)]
    while level:
        below = []
        for d in level:
            for p in sorted(d.iterdir()):
                if p.is_file() and p.name == name:
                    return str(p)
                if p.is_dir():
                    below.append(p)
        level = below
    return None


def read_config(text: str) -> dict:
    """A configuration of nested property elements: strings, booleans, arrays, maps, associative arrays and lists of objects."""

    def value(e: ET.Element):
        match e.get("type"):
            case "boolean":
                return (e.text or "").strip().lower() == "true"
            case "array":
                return [(v.text or "") for v in e.findall("value")]
            case "map":
                return {p.get("key"): p.get("value") for p in e.findall("pair")}
            case "associativeArray":
                return {p.get("key"): [(v.text or "") for v in p.findall("value")] for p in e.findall("entry")}
            case "objects":
                return [children(o) for o in e.findall("object")]
            case "string":
                return e.text or ""
        return children(e) if e.findall("property") else e.text or ""

    def children(e: ET.Element) -> dict:
        return {p.get("name"): value(p) for p in e.findall("property")}

    return children(ET.fromstring(text))
