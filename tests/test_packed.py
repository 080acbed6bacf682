import pytest

from cartalog.operators.packed import resolve, split_packed

CASES = [
    ("338;S-70", ["338", "S-70"]),
    ('"M14 ""short""";"43;163"', ['M14 "short"', "43;163"]),
    ('"12"; "206 / U6"; "297,RE14"; "Kubabr Ring"', ["12", "206 / U6", "297,RE14", "Kubabr Ring"]),
    ("'240;Express 15'；“RE71”", ["240;Express 15", "RE71"]),
    ('S 63;178;"188"', ["S 63", "178", "188"]),
    ("X-5 and 136\tFubrag\t335\t1.8", ["X-5", "136", "Fubrag", "335", "1.8"]),
    ("'Night 20,5.3' und «38E,209» und '10';", ["Night 20,5.3", "38E,209", "10"]),
    ("39.7, und 84", ["39.7", "84"]),
    ("12;; 13 // 14", ["12", "13", "14"]),
    ("12|13|", ["12", "13"]),
    ("L'Express;d'Or", ["L'Express", "d'Or"]),
    ('"12', ['"12']),
    ('"";"a";" "', ["a"]),
    ("and", ["and"]),
    (None, []),
    ("", []),
    (" ; ", []),
    ("a" * 5 + ";" + "b" * 200_000, ["a" * 5, "b" * 200_000]),
    ('"' + "x;" * 50_000 + '";y', ["x;" * 50_000, "y"]),
    ("14.6 + 15.7 & 8", ["14.6", "15.7", "8"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(k, ref, 7, "x") for k, (ref, _) in enumerate(CASES)], "rel_id int, ref string, POS int, item string")
    got = {}
    for r in split_packed(df.union(df), "rel_id", "ref").collect():
        got.setdefault(r["rel_id"], {})[r["pos"]] = r["item"]
    for k, (ref, items) in enumerate(CASES):
        assert [got.get(k, {}).get(p) for p in range(len(got.get(k, {})))] == items, ref[:50] if ref else ref


def test_least_and_empty(spark):
    df = spark.createDataFrame([(1, "5"), (2, "5;6")], "rel_id int, ref string")
    assert {r["rel_id"] for r in split_packed(df, "rel_id", "ref", least=2).collect()} == {2}
    assert split_packed(df.limit(0), "rel_id", "ref").count() == 0


@pytest.mark.parametrize("sign", list(";,/|&+；，、") + ["\t", "\n", " und ", " and "])
def test_signs(spark, sign):
    df = spark.createDataFrame([(1, sign.join(["A 1", "B-2", "3.4"]))], "k int, v string")
    assert [r["item"] for r in split_packed(df, "k", "v").orderBy("pos").collect()] == ["A 1", "B-2", "3.4"]


TIGHT = [("S1/2, S3", ["S1/2", "S3"]), ("A/B;C/D", ["A/B", "C/D"]), ("302/399", ["302", "399"]), ("12 / 14, 16", ["12", "14", "16"]), ("A/B/C und D", ["A/B/C", "D"]), ('"x"/y;z', ["x", "y", "z"]), ("/a;b/", ["a", "b"])]


def test_signs_that_belong_to_values(spark):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(TIGHT)], "k int, v string")
    for tight, want in (("/", dict(enumerate(w for _, w in TIGHT))), ("", {0: ["S1", "2", "S3"], 1: ["A", "B", "C", "D"], 4: ["A", "B", "C", "D"]})):
        got = {}
        for r in split_packed(df, "k", "v", tight=tight).orderBy("k", "pos").collect():
            got.setdefault(r["k"], []).append(r["item"])
        assert {k: got[k] for k in want} == want
    assert resolve("x/r,l", "/") == [(1, 3, False), (5, 5, False)] and resolve("w") == [(1, 1, False)] and resolve("") == []
