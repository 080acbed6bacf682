import random

import numpy as np
import pytest

from cartalog.llm.leakage import _best, _local, copied, leaked, leaked_words
from cartalog.llm.words import plain_words

PARTS = ("bra", "klu", "ste", "gro", "mi", "fö", "na", "ti", "lo", "pu")
NAMES = [f"{a}{b}{c}{d}" for a in PARTS for b in PARTS for c in PARTS for d in ("sta", "ve", "kri")]
STOCK = (
    "the walk from {0} takes {1} minutes past an old sign",
    "line {1} now calls at {0} and {2} until further notice",
    "whoever maps {0} should check bench {1} near our chapel",
    "because of ice gate {1} stays locked between {0} and {2}",
    "passengers bound for {2} change here to tram {1} via {0}",
    "a surveyor measured {1} kerbs along quiet lanes behind {0}",
    "on friday two conductors reported {1} lamps missing around {0}",
    "{0} council moved its waiting room {1} steps towards {2}",
)


def sentence(rng):
    return rng.choice(STOCK).format(rng.choice(NAMES), rng.randrange(100, 9999), rng.choice(NAMES)).split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    items = {k: [w for _ in range(7) for w in sentence(rng)] for k in range(40)}
    docs, want = {}, set()
    for d in range(160):
        words = [w for _ in range(rng.randint(2, 8)) for w in sentence(rng)]
        kind = d % 8
        if kind < 5:
            item = rng.randrange(40)
            own = items[item]
            size = {0: 30, 1: 56, 2: 40, 3: 15, 4: len(own)}[kind]
            start = rng.randrange(len(own) - size + 1)
            part = own[start : start + size]
            if kind == 1:  # small changes
                for k in range(4, len(part) - 4, 9):
                    part[k] = part[k] + "x" if k % 2 else "also " + part[k]
            if kind == 2:  # two places
                words = words[:10] + part[:20] + words[10:25] + part[20:] + words[25:]
            else:
                words = words[: len(words) // 2] + part + words[len(words) // 2 :]
            if kind != 3:
                want.add((d, item))
        docs[d] = " ".join(words) if d % 2 else "<p>" + "\n> ".join(" ".join(words[k : k + 9]).upper() for k in range(0, len(words), 9)) + "</p>"
    return docs, {k: " ".join(v).capitalize() + "." for k, v in items.items()}, want


def test_finds_exactly_the_leaks(spark, corpus):
    docs, items, want = corpus
    d = spark.createDataFrame([*docs.items(), (900, None), (901, ""), (902, " "), (None, docs[4])], "doc_id int, text string")
    i = spark.createDataFrame([*items.items(), (77, items[3]), (78, None), (79, "short")], "item_id int, text string")
    got = {(r["doc"], r["item"]) for r in leaked(d.union(d), "doc_id", "text", i, "item_id", "text").collect()}
    assert got == want | {(a, 77) for a, b in want if b == 3}


def test_an_item_in_a_third_of_all_documents(spark, corpus):
    _, items, _ = corpus
    rng = random.Random(2)
    docs = {k: " ".join([w for _ in range(4) for w in sentence(rng)] + (items[5].split() if k % 3 == 0 else [])) for k in range(300)}
    d, i = spark.createDataFrame(list(docs.items()), "doc_id int, text string"), spark.createDataFrame(list(items.items()), "item_id int, text string")
    assert {tuple(r) for r in leaked(d, "doc_id", "text", i, "item_id", "text").collect()} == {(k, 5) for k in range(0, 300, 3)}


def test_nothing_in(spark, corpus):
    docs, items, _ = corpus
    d, i = spark.createDataFrame(list(docs.items()), "doc_id int, text string"), spark.createDataFrame(list(items.items()), "item_id int, text string")
    assert leaked(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leaked(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_alignment_against_plain_tables():
    rng = random.Random(5)
    for _ in range(60):
        a, b = (np.array([rng.randrange(6) for _ in range(rng.randint(1, 30))], dtype=np.int32) for _ in range(2))
        table = np.zeros((len(b) + 1, len(a) + 1), dtype=int)
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (1 if a[j - 1] == b[i - 1] else -2), table[i - 1, j] - 2, table[i, j - 1] - 2)
        score, (d0, d1, i0, i1, matches) = _local(a, b)
        assert score == table.max() and all(a[x] == b[y] for x, y in matches) and d1 - d0 >= len(matches) <= i1 - i0


def test_long_texts_by_windows():
    item = np.arange(50, dtype=np.int32)
    doc = np.full(30_000, -1, dtype=np.int32)
    doc[3_980:4_030] = item
    d0, d1, i0, i1, matches = _best(doc, item)
    assert (d0, d1, i0, i1, len(matches)) == (3_980, 4_030, 0, 50, 50)


def test_plain_words():
    assert plain_words("<p>Suv&ouml;ro um 11:31</p> Fahr-\n> karten​automat, d'Or 3.5") == ["suvoro", "um", "1131", "fahrkartenautomat", "d", "or", "35"]


def test_stock_phrases_take_no_place():
    """Items of 8 stock words, 12 of its own, 8 stock words, 12 of its own; words from 100 on are rare."""
    rare = np.arange(200) >= 100
    stock, more, own, other = np.arange(8), np.arange(10, 22), np.arange(100, 112), np.arange(112, 124)
    item = np.concatenate([stock, own, more, other]).astype(np.int32)
    altered = lambda w: np.where(np.isin(np.arange(12), (4, 8)), -1, w)
    gap = np.full(9, -1)
    doc = lambda *parts: np.concatenate([x for p in parts for x in (gap, p)]).astype(np.int32)
    assert leaked_words(doc(stock, altered(own), altered(other)), item, rare) == 24
    assert leaked_words(doc(stock, more, stock, altered(own), more, altered(other)), item, rare) == 24
    long = np.concatenate([own, other])
    assert leaked_words(doc(stock, more, np.where(np.isin(np.arange(24), (4, 9, 14, 19)), -1, long)), np.concatenate([stock, more, long]).astype(np.int32), rare) == 24
    # Stock phrases alone, one place too short, or the same place twice are no case.
    assert leaked_words(doc(stock, more, stock, more), item, rare) == 0
    assert leaked_words(doc(stock, altered(own), more), item, rare) == 12
    assert leaked_words(doc(altered(own), stock, altered(own)), item, rare) == 12


def test_ordinary_words_copied_as_they_are(spark):
    """28 words in a row that all stand in many other texts are a case; 20 are none."""
    rng = random.Random(9)
    common = "the of and to in a is that it for was on are with as his they at be this from have or by one had not but what all".split()
    items = {k: [rng.choice(common) for _ in range(50)] for k in range(5)}
    docs = {k: [rng.choice(common) for _ in range(60)] for k in range(300)}
    docs[300], docs[301] = docs[0][:20] + items[2][10:38] + docs[1][:20], docs[0][:20] + items[2][10:30] + docs[1][:20]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id int, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id int, text string")
    assert {tuple(r) for r in leaked(d, "doc_id", "text", i, "item_id", "text").collect()} == {(300, 2)}
    assert copied(np.array([7, *range(24)]), np.arange(30)) and not copied(np.arange(23), np.arange(30)) and not copied(np.zeros(0), np.arange(30))


def test_recall_over_planted_edits(spark):
    """Passages of 30 to 45 words with a word changed, put in or left out every seven words on the average, beside texts of the same phrases."""
    rng = random.Random(12)
    items = {k: [w for _ in range(7) for w in sentence(rng)] for k in range(60)}
    docs, want = {}, set()
    for d in range(600):
        words = [w for _ in range(rng.randint(3, 7)) for w in sentence(rng)]
        if d % 3 == 0:
            k, size = rng.randrange(60), rng.randint(30, 45)
            start = rng.randrange(max(1, len(items[k]) - size))
            part = [x for w in items[k][start : start + size] for x in (rng.choice([[], ["other"], [w, "more"]]) if rng.random() < 1 / 7 else [w])]
            words = words[:12] + part + words[12:]
            want.add((d, k))
        docs[d] = " ".join(words)
    d, i = spark.createDataFrame(list(docs.items()), "doc_id int, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id int, text string")
    got = {tuple(r) for r in leaked(d, "doc_id", "text", i, "item_id", "text").collect()}
    print(len(got & want), len(want), len(got - want))
    assert len(got & want) >= 0.9 * len(want) and not got - want
