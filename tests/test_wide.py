import pytest
from pyspark.sql import functions as F

from cartalog.operators.wide import Attribute, parse_boolean, parse_date, parse_length, parse_whole, to_long, to_wide

CASES = {
    parse_boolean: [("yes", True), (" Ja ", True), ("FALSE", False), ("0", False), ("limited", None), ("", None), (None, None), ("12", None)],
    parse_whole: [("12", 12), (" +63", 63), ("234.0", 234), ("7 189", 7189), ("5,510", 5510), ("1,234,567", 1234567), ("-4", -4), ("12;14", None), ("10-20", None), ("few", None), ("5,51", None), ("1.5", None), ("1234 567", None), ("", None), (None, None), ("9" * 30, None)],
    parse_length: [("67.5", 67.5), ("3620 cm", 36.2), ("37,6 m", 37.6), ("22.76m", 22.76), ("−8", -8.0), ("−12,8", -12.8), ("1.2 km", 1200.0), ("900 mm", 0.9), ("3 storeys", None), ("~", None), ("12 ft", None), ("1,2,3", None), ("", None), (None, None)],
    parse_date: [("1896-07-17", "1896-07-17"), ("19970219", "1997-02-19"), ("1950/10/16", "1950-10-16"), ("1964-02-07T00:00:00", "1964-02-07"), ("01.10.1983", "1983-10-01"), ("7 Oct 1904", "1904-10-07"), ("3. März 2001", "2001-03-03"), ("3 février 2001", "2001-02-03"), ("May 4, 1999", "1999-05-04"), ("1992-02-30", None), ("1947", None), ("C19", None), ("1970-05", None), ("31.04.2001", None), ("345", None), ("", None), (None, None)],
}


@pytest.mark.parametrize("parse", list(CASES), ids=lambda p: p.__name__)
def test_parsers(spark, parse):
    df = spark.createDataFrame([(v,) for v, _ in CASES[parse]], "v string")
    got = [r["o"] for r in df.select(parse(F.col("v")).alias("o")).collect()]
    assert [str(g) if parse is parse_date and g else g for g in got] == [w for _, w in CASES[parse]]


ATTRIBUTES = [Attribute("name", "text"), Attribute("fee", "boolean"), Attribute("building:levels", "whole"), Attribute("height", "length"), Attribute("start_date", "date")]
SCHEMA = "objectid bigint, key string, value string, edit_no int, loaded_at int, name string"


def test_wide(spark):
    rows = [
        (1, " Name\t", " A ", 1, 1, "x"), (1, "name", "B", 3, 1, "x"), (1, "NAME", "C", 2, 9, "x"), (1, "fee", "yes", 1, 1, "x"), (1, "fee", None, 2, 1, "x"),
        (2, "fee", "no", 1, 1, "x"), (2, "fee", "no", 1, 5, "x"), (2, "height", "3,5 m", 1, 1, "x"), (2, "start_date", "2.3.2004", None, None, "x"), (2, "other", "z", 1, 1, "x"),
        (3, "height", "tall", 2, 1, "x"), (3, "height", "5", 1, 1, "x"), (None, "name", "q", 1, 1, "x"), (4, None, "q", 1, 1, "x"), (5, "building:levels", "4.0", 1, 1, "x"), (6, "name", "y" * 300_000, 1, 1, "x"), (7, "height", "-0", 1, 1, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("Value_2", F.lit(1))
    wide = to_wide(df.union(df), "objectid", "key", "value", ("edit_no", "loaded_at"), ATTRIBUTES)
    assert wide.columns == ["objectid", "name", "fee", "building:levels", "height", "start_date"]
    long = {(r["objectid"], r["attr"]): r["val"] for r in to_long(wide, "objectid", ATTRIBUTES).collect()}
    assert long.pop((6, "name")) == "y" * 300_000
    assert long == {(1, "name"): "B", (2, "fee"): "false", (2, "height"): "3.50", (2, "start_date"): "2004-03-02", (5, "building:levels"): "4", (7, "height"): "0.00"}
    assert to_wide(df.limit(0), "objectid", "key", "value", ("edit_no",), ATTRIBUTES).count() == 0


def test_entities_over_batch_ends(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, key, str(k), 1, 1, "x") for k in range(200) for key in ("name", "building:levels", "height")]
        wide = to_wide(spark.createDataFrame(rows, SCHEMA), "objectid", "key", "value", ("edit_no",), ATTRIBUTES)
        got = wide.collect()
        assert len(got) == 200 and all(r["name"] == str(r["objectid"]) and r["building:levels"] == r["objectid"] and r["height"] == float(r["objectid"]) and r["fee"] is None for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
