import math
import random

import pytest
from pyspark.sql import functions as F

from cartalog.functions import codec, geo, strings, tags, times
from cartalog.functions.curve import peano


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "delimiter", "omit", "tokens"),
    [("a,b,,c", ",", False, ["a", "b", "", "c"]), ('a,"b,c",d', ",", False, ["a", '"b,c"', "d"]), ("  a  b ", " ", True, ["a", "b"]), ('"a b" c', " ", True, ['"a b"', "c"]), ('a,"b', ",", False, None), ("a|b", "|", False, ["a", "b"])],
)
def test_tokenize(spark, text, delimiter, omit, tokens):
    assert one(spark, strings.tokenize(F.lit(text), delimiter, omit)) == tokens


def test_strings(spark):
    assert one(spark, strings.base64_text(F.lit("Test message"))) == "VGVzdCBtZXNzYWdl"
    assert one(spark, strings.base64_decoded(F.lit("VGVzdCBtZXNzYWdl"))) == "Test message"
    assert one(spark, strings.base64_decoded(F.lit("VGV*"))) is None
    assert [one(spark, strings.base36(F.lit(n))) for n in (0, 35, 36, 36**3)] == ["a", "9", "ab", "aaab"]
    assert one(spark, strings.escape(F.lit(' \t"a/b\'c\n '))) == "abc"
    assert one(spark, strings.search_words(F.lit("Crème brûlée & C# R+D, ok"))) == ["creme", "brulee", "&", "c#", "r+d", "ok"]
    assert [one(spark, strings.lexical_int(F.lit(t))) for t in ("12ab", "x", "-3")] == [12, 0, -3]


def test_times(spark):
    t = lambda text: times.seconds_of_day(F.lit(text))
    assert one(spark, times.time_text(times.add_seconds(t("20:44:21"), F.lit(38))[0])) == "20:44:59"
    assert one(spark, times.time_text(times.add_seconds(t("20:44:21"), F.lit(39))[0])) == "20:45:00"
    late = times.add_seconds(t("20:45:00"), F.lit(5 * 3600))
    assert (one(spark, times.time_text(late[0])), one(spark, late[1])) == ("01:45:00", 1)
    moment = times.plus_seconds(times.parse_moment(F.lit("2000-02-28T20:00:00")), F.lit(4 * 3600))
    assert str(one(spark, moment)) == "2000-02-29 00:00:00"
    assert str(one(spark, times.plus_seconds(times.parse_moment(F.lit("20131231"), True), F.lit(1)))) == "2014-01-01 00:00:00"
    assert one(spark, times.weekday(F.lit("2013-03-11").cast("date"))) == 0
    assert one(spark, times.parse_moment(F.lit("nonsense"))) is None
    assert one(spark, t("25:61")) is None
    assert [one(spark, times.is_leap(F.lit(y))) for y in (1900, 2000, 2004, 2005)] == [False, True, True, False]


def test_polyline_random():
    rng = random.Random(2)
    for _ in range(300):
        line = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(rng.randint(1, 100))]
        back = codec.decode_line(codec.encode_line(line))
        assert len(back) == len(line) and all(abs(a - b) < 1.0001e-5 for p, q in zip(line, back, strict=True) for a, b in zip(p, q, strict=True))
        rings = [line, line[::-1]]
        assert [len(r) for r in codec.decode_rings(codec.encode_rings(rings))] == [len(line)] * 2
    assert codec.encode_line([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def test_wkb_and_stored():
    line = [(1.5, -2.25), (3.0, 4.0), (1.5, -2.25)]
    assert codec.read_wkb(codec.wkb(line, 2)) == line == codec.read_wkb(codec.wkb(line, 3))
    assert codec.read_wkb(codec.wkb(line[:1], 1)) == line[:1] and len(codec.wkb(line[:1], 1)) == 21
    assert codec.stored(line, True)[0] == 5 and codec.stored(line[:1], False)[0] == 2
    assert codec.read_stored(codec.stored(line, False)) == line == codec.read_stored(codec.stored(line, True))


def test_geo(spark):
    points = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0))])
    assert one(spark, geo.ring_area(points)) == 4.0
    assert one(spark, geo.line_length(F.slice(points, 1, 2))) == pytest.approx(2 * math.pi / 180 * geo.EARTH_RADIUS)
    assert one(spark, geo.line_length(F.slice(points, 1, 0))) == 0.0
    assert one(spark, geo.centre_of_mass(points)) == (1.0, 1.0)
    assert one(spark, geo.in_box(F.lit(0.0), F.lit(-179.5), F.lit(1.0), F.lit(179.0), F.lit(-1.0), F.lit(-179.0))) is True
    assert one(spark, geo.tile_x(F.lit(13.4), 10)) == 550 and one(spark, geo.tile_y(F.lit(52.5), 10)) == 335


def test_peano_stays_in_range(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    got = [r["v"] for r in spark.createDataFrame(rows, "a double, b double").select(peano(F.col("a"), F.col("b")).alias("v")).collect()]
    assert all(0 <= v < 3**30 for v in got) and len(set(got)) == 300


def test_tags(spark):
    assert one(spark, tags.canonical(F.lit("postal_code"), F.lit("66111"))) == ("addr:postcode", "66111")
    assert one(spark, tags.parent_areas(F.lit("city"))) == ["state", "county", "region", "province", "country"]
    assert one(spark, tags.area_level(F.lit("nothing"))) == -1
    codes = tags.country_codes()
    assert len(codes) > 200 and [one(spark, tags.is_country_code(F.lit(x), codes)) for x in ("DE", "de", "De", "XX")] == [True, True, False, False]
    assert one(spark, tags.is_road({"highway": F.lit("primary"), "access": F.lit("no")})) is False
    assert one(spark, tags.is_road({"highway": F.lit("primary"), "access": F.lit(None).cast("string")})) is True
    assert one(spark, tags.is_splittable(F.lit("phone"))) is True and one(spark, tags.area_prefix(F.lit("addr:zip"))) == "zip"


def test_any_number_of_conditions(spark):
    from cartalog.operators.conditions import key_is
    from cartalog.operators.search import indexed_ids, matching_ids, token_index

    osm = spark.createDataFrame([(o, f"k{k}", "v") for o in (1, 2) for k in range(70) if o == 1 or k != 65] + [(3, "k0", None)], "objectid int, key string, value string")
    assert [r[0] for r in matching_ids(osm, [key_is(f"k{k}", "v") for k in range(70)]).collect()] == [1]
    assert {r[0] for r in matching_ids(osm, [key_is("k0")]).collect()} == {1, 2, 3} == {r[0] for r in matching_ids(osm, []).collect()}
    docs = spark.createDataFrame([(1, ["line", "carriage", "line"]), (2, ["line"]), (3, None), (4, [None, "carry", "line"])], "docid int, tokens array<string>")
    index = token_index(docs)
    assert {r[0] for r in indexed_ids(index, ["line"], ["carr"]).collect()} == {1, 4}
    assert {r[0] for r in indexed_ids(index).collect()} == {1, 2, 4} and indexed_ids(index, ["none"]).count() == 0 == token_index(docs.limit(0)).count()
