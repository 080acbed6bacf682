import unicodedata

from cartalog.llm.visual import same_look_pairs, visual_forms

SAME = [
    ["port brudi", "ｐｏｒｔ ｂｒｕｄｉ", "port brudi", "port brudi ", "　po​rt bru­di", "рort brudі", "port brudi﻿"],
    ["Kläbé", "Kläbé", "Кlӓbé".replace("К", "K"), "K̈".replace("K̈", "K") + "lӓbé"],
    ["ậ", "ậ", "ậ"],
    ["саботазиго", "саботазигo", "сабо⁠тазиго"],
    ["Bahn", "ꓐahn", "Вahn"],
    ["Linie", "Ⅼinie", "ꓡinie"],
    ["linie", "ⅼinie"],
    ["ort", "ᴏrt", "ⲟrt"],
    ["neu-x", "neu‑x", "neu－x", "neu‐x"],
]
DIFFERENT = ["Line 8", "Line ⁸", "line 8", "Lïne 8", "Line  8", "Lin e8", "и", "й", "x–y", "x-y", "ʀʙ", "rb", "Linien²", "Linien2"]


def test_forms(spark):
    texts = [t for group in SAME for t in group] + DIFFERENT + [None, "", " ", "​", "z" * 100_000 + "́"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, form int")
    forms = {r["text"]: r["form"] for r in visual_forms(df, "text").collect()}
    for group in SAME:
        assert len({forms[t] for t in group}) == 1, group
    assert len({forms[t] for t in DIFFERENT}) == len(DIFFERENT)
    assert forms[""] == forms[" "] == forms["​"] == "" and None not in forms
    assert forms["z" * 100_000 + "́"] == unicodedata.normalize("NFC", "z" * 100_000 + "́")
    assert all(unicodedata.is_normalized("NFC", f) for f in forms.values())


def test_pairs(spark):
    rows = [(1, "port x"), (2, "port x"), (3, "pоrt x"), (3, "pоrt x"), (4, None), (5, ""), (6, " "), (None, "port x "), (7, "Port x"), (8, "pоrt x")]
    df = spark.createDataFrame(rows, "id int, name string")
    assert {tuple(r) for r in same_look_pairs(df, "id", "name").collect()} == {(1, 3), (2, 3), (1, 8), (2, 8), (3, 8)}
    assert same_look_pairs(df.limit(0), "id", "name").count() == 0


def test_against_plain_python_on_the_tables(spark, sf):
    from cartalog.llm.visual import mappings

    parts = {r["ch"]: [(p["class"], p["part"]) for p in r["parts"]] for r in mappings().to_pylist()}

    def form(text):
        out, marks = [], []
        for kind, ch in [p for c in text for p in parts.get(c, [(0, c)])]:
            if kind == 0:
                out += [m for _, m in sorted(marks, key=lambda m: m[0])]
                marks = []
                out.append(ch)
            else:
                marks.append((kind, ch))
        out += [m for _, m in sorted(marks, key=lambda m: m[0])]
        return unicodedata.normalize("NFC", "".join(out)).strip(" ")

    names = spark.read.parquet(f"{sf}/osm_relation.parquet").select("name").union(spark.read.parquet(f"{sf}/addrdecoder_areas.parquet").select("name"))
    rows = visual_forms(names, "name").collect()
    assert rows and all(r["form"] == form(r["text"]) for r in rows)
