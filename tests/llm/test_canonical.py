import random
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from cartalog.llm.canonical import Matcher, mapped_rows, to_canonical
from cartalog.llm.edits import BkTree, distance

KINDS = [(0, "tram", "Straßenbahn", "tramway"), (1, "subway", "U-Bahn", "métro"), (3, "bus", "Omnibus", "autobus"), (13, "light_rail", "Stadtbahn", "métro léger"), (4, "ferry", "Fähre", "navette fluviale")]
MEANT = [
    ("ttam", 0), ("team", 0), ("STRASSENBAHN", 0), ("Straxenbahn", 0), (" 3", 3), ("03", 3), ("3.0", 3), ("3 - bus", 3), ("13=Stadtbahn", 13), ("type 4", 4), ("bus (3)", 3),
    ("ｂｕｓ", 3), ('"Omnibus"', 3), ("night bus", 3), ("tram; scheduled", 0), ("autobus (seasonal)", 3), ("faehre", 4), ("METRO", 1), ("light rail service", 13), ("Linie light rail", 13), ("lightr_ail", 13), ("U--Bahn", 1), ("b u s", 3),
    ("walk", -1), ("fixme", -1), ("99", -1), ("type 77", -1), ("-1", -1), ("20.0", -1), ("school run on foot", -1), ("???", -1), ("road", -1), ("x" * 100_000, -1),
]


def tables(spark):
    kinds = spark.createDataFrame(KINDS, "kind_code int, label_en string, label_de string, label_fr string")
    values = [(k, v) for k, (v, _) in enumerate(MEANT)] + [(100, "bus"), (101, "3"), (102, None), (103, ""), (104, " \t"), (0, MEANT[0][0])]
    return spark.createDataFrame(values, "id int, value string"), kinds


def test_meant_entries(spark):
    df, kinds = tables(spark)
    got = {r["row_id"]: r["code"] for r in mapped_rows(df, "id", "value", kinds, "kind_code", ["label_en", "label_de", "label_fr"]).collect()}
    assert got == {k: code for k, (_, code) in enumerate(MEANT)}


def test_shards_agree_and_empty_tables(spark):
    df, kinds = tables(spark)
    labels = ["label_en", "label_de", "label_fr"]
    whole, cut = (to_canonical(df, "value", kinds, "kind_code", labels, shard=n) for n in (1000, 1))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in cut.collect()}
    assert {r["code"] for r in to_canonical(df, "value", kinds.limit(0), "kind_code", labels).collect()} == {-1}
    assert to_canonical(df.limit(0), "value", kinds, "kind_code", labels).count() == 0


words = st.text(alphabet="abcd", max_size=7)


@settings(max_examples=300, deadline=None)
@given(words, words, words)
def test_distance_is_a_metric(a, b, c):
    assert distance(a, b) == distance(b, a) >= (a != b)
    assert distance(a, c) <= distance(a, b) + distance(b, c)
    for most in range(5):
        assert distance(a, b, most) == distance(a, b) if distance(a, b) <= most else distance(a, b, most) > most


def test_tree_gives_every_entry_within():
    rng = random.Random(1)
    entries = {"".join(rng.choices("abcde", k=rng.randint(2, 8))) for _ in range(300)}
    tree = BkTree(sorted(entries))
    for _ in range(60):
        word = "".join(rng.choices("abcde", k=rng.randint(2, 8)))
        assert {e for _, e in tree.within(word, 2)} == {e for e in entries if distance(word, e) <= 2}


def test_held_out_typing_errors():
    """Labels with one or two random typing errors: nearly all come back."""
    rng = random.Random(4)
    matcher, right, n = Matcher([(k, list(labels)) for k, *labels in KINDS]), 0, 0
    for code, *labels in KINDS:
        for label in labels:
            for _ in range(40):
                typed = list(label)
                for _ in range(1 if len(label) < 7 else rng.randint(1, 2)):
                    k = rng.randrange(len(typed))
                    match rng.randrange(4):
                        case 0:
                            typed.insert(k, typed[k])
                        case 1:
                            del typed[k]
                        case 2:
                            typed[k] = rng.choice(string.ascii_lowercase)
                        case _:
                            typed[k - 1], typed[k] = typed[k], typed[k - 1]
                hits = sorted(matcher.find("".join(typed)))
                n, right = n + 1, right + bool(hits and hits[0][2] == code)
    assert right / n >= 0.95


def test_long_values_and_many_qualifiers(spark):
    kinds = spark.createDataFrame([(3, "bus"), (5, "tram")], "code int, label string")
    known = {"bus (" + "a remark " * 40 + ")": 3, "tram; " + "see below " * 40: 5, " " * 250 + "bus" + " " * 250: 3, "the public bus service": 3, "the regular public night tram line service": 5}
    unknown = ["x" * 300, "bus " + "word " * 100, "9" * 5000, "the public service line"]
    df = spark.createDataFrame([(v,) for v in [*known, *unknown]], "v string")
    got = {r["value"]: r["code"] for r in to_canonical(df, "v", kinds, "code", ["label"]).collect()}
    assert got == known | dict.fromkeys(unknown, -1)
