import itertools
import random

from pyspark.sql import functions as F

from cartalog.llm.edits import distance
from cartalog.llm.variants import NICKNAMES, alignment, assignment, close_edits, entities, link_block, plain, same_entity_pairs, shortened, tokens

ALIKE = [
    ["Dovukera Stadtwerke", "Stadtw. Dovukera", "SW DOVUKERA", "Dovukeraer Stadtwerk e.K.", "Dovkuera - Stadtwerke Ltd.", "stadtwerke, dovukera & Co. KG"],
    ["Richard Stalitasu Coaches", "Stalitasu, Dick Coaches Ltd", "R. Stalitasu Coach", "STALITASU RICHARD COACHES GmbH", "Staltiasu Rick Coaches"],
    ["Omnibus Susanne Zepetobe", "Zepetobe Susi Omnibus GmbH GmbH", "Omnib. Sanne Zepetobe", "Omnibus Zepetobe, S."],
    ["Omnibus Johannes Zepetobe", "Hans Zepetobe Omnibus", "Omnib. Hannes Zepetobe", "omnibus j. zepetobe"],
    ["Püfedrolo Ferry Services", "Puefedrolo Ferries", "Pufedrolo - Ferry Svcs", "Püfedroloer Ferry Serv."],
    ["Transports urbains Nepabruvö", "TU, Nepabruvö", "Nepabruvoeer Transp. urb.", "T. Urbains Nepabruvö"],
    ["Nahverkehrsgesellschaft Bréfuzaze", "NVG Brefuzaze", "Bréfuzaze-Nahverkehrsges."],
    ["Püfedrolo Stadtwerke", "SW Puefedrolo"],
    ["Bus Company Metrubegi", "bu scompany metrubegi", "Metrubegier BusCompany", "Bus Co. Metrubegi AG"],
]


def rows(alike, copies=6):
    out = []
    for e, names in enumerate(alike):
        for c, name in enumerate([names[0]] * copies + names[1:]):
            out.append(("agency" if c % 3 == 0 else "osm_relation", len(out) + 1, name, e))
    return out


def test_links(spark):
    data = rows(ALIKE)
    df = spark.createDataFrame([(t, i, n, "x") for t, i, n, _ in data] + [("agency", 900, None, "x"), ("agency", 901, " ", "x"), ("agency", None, "SW A", "x"), ("agency", 902, "---", "x"), ("osm_relation", 903, "y" * 50_000, "x")], "tab string, id int, name string, entity string")
    got = {tuple(r) for r in same_entity_pairs(df.union(df), "agency").collect()}
    want = {(i, t2, j) for t1, i, _, e in data for t2, j, _, f in data if t1 == "agency" and e == f and i != j and (t2 != "agency" or i < j)}
    assert got == want
    assert same_entity_pairs(df.limit(0), "agency").count() == 0


def test_random_misspellings(spark):
    """Many places of one kind, each with misspelled records: nearly all link to their own and none to another."""
    rng = random.Random(8)
    parts = ["bra", "kle", "sto", "gri", "ma", "fu", "zo", "ti", "ne", "pu", "dra", "vo"]
    places = {"".join(rng.sample(parts, 4)) for _ in range(40)}
    data = []
    for p in sorted(places):
        for c in range(14):
            typed = list(p)
            if c > 6:
                k = rng.randrange(len(typed))
                typed[k : k + 1] = rng.choice([[], [typed[k]] * 2, ["x"]])
            data.append((len(data), "".join(typed).title() + " Stadtwerke", p))
    df = spark.createDataFrame([("agency", i, n) for i, n, _ in data], "tab string, id int, name string")
    true = {i: p for i, _, p in data}
    found = {r["id"]: r["entity"] for r in entities(df).collect()}
    pairs = [(a, b) for a in found for b in found if a < b]
    same = sum(found[a] == found[b] for a, b in pairs if true[a] == true[b]) / sum(true[a] == true[b] for a, b in pairs)
    wrong = sum(found[a] == found[b] for a, b in pairs if true[a] != true[b])
    assert same > 0.97 and wrong == 0


#: Names of organisations and people that no list of the operator knows, with their spellings.
OTHERS = [
    ["Acme Transport Logistics", "Logistics Acme Transport", "A. Transport Logistics", "ACME Transp. Logistics Ltd", "Acme Transport Logisitcs"],
    ["Compagnie Lyonnaise des Tramways", "Cie Lyonnaise de Tramways", "Cie. Lyonnaise des Tramw.", "Compagnie Lyonaise des Tramways SA"],
    ["Robert Miller Haulage", "Bob Miller Haulage", "Haulage Miller, Robert", "R. Miller Haulage Inc.", "Miller Bob Haulage"],
    ["Stadtwerke Hainburg", "SW Hainburg", "Hainburger Stadtwerke GmbH", "Stadtw. Hainburg", "Städtische Werke Hainburg"],
    ["Northern Valley Railroad", "NVR Northern Valley", "Northern Valley RR", "Northern Vally Railroad", "N. Valley Railroad"],
    ["Seebad Schifffahrtsgesellschaft", "Seebad Schifffahrtsges.", "SEEBAD-SCHIFFFAHRTSGESELLSCHAFT mbH", "Schifffahrtsgesellschaft Seebad"],
    ["Harriet Quimby Taxis", "H. Quimby Taxis", "Quimby, Harriet - Taxis", "Harriet Quinby Taxis"],
    ["Harbour Water Taxi Company", "Harbour Water Taxi Co.", "Harbor Water Taxi Company", "Water Taxi Company Harbour"],
    ["Stadtwerke Marchegg", "SW Marchegg", "Marchegg Stadtwerke"],
    ["George Miller Haulage", "Miller George Haulage", "G. Miller Haulage"],
]


def test_names_outside_the_lists(spark):
    data = rows(OTHERS, 3)
    found = {r["id"]: r["entity"] for r in entities(spark.createDataFrame([(t, i, n) for t, i, n, _ in data], "tab string, id int, name string")).collect()}
    true = {i: e for _, i, _, e in data}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(true), 2)]
    same = [found[a] == found[b] for a, b in pairs if true[a] == true[b]]
    assert sum(same) >= 0.9 * len(same)
    assert not [(a, b) for a, b in pairs if true[a] != true[b] and found[a] == found[b]]


def test_alignment():
    same = lambda a, b: alignment(a.split(), b.split())
    assert same("tu nepabruvo", "transports urbains nepabruvo") is not None
    assert same("tu nepabruvo", "transit authority nepabruvo") is None
    assert same("omnibus robert miller", "omnibus susi miller") is None
    assert same("bus co miller", "busbetrieb miller") is None
    assert same(" ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30)) + " a0") is None
    rng = random.Random(3)
    for _ in range(100):
        n, m = rng.randint(1, 4), rng.randint(4, 5)
        costs = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
        best = min(sum(costs[k][p[k]] for k in range(n)) for p in itertools.permutations(range(m), n))
        got = assignment(costs)
        assert len(set(got)) == n and sum(costs[k][j] for k, j in enumerate(got)) == best


def test_tokens_and_edits(spark):
    names = ["Grozeklati, M. Coaches Ltd.", "Gisädrwfuer Trans. Auth. S.A.", "---", "Ｂｕｓ Co", "x " + ", " * 30_000 + "GmbH"]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string").orderBy("k").select(tokens(F.col("name"))).collect()]
    assert got == [["grozeklati", "m", "coaches"], ["gisadrwfu", "trans", "auth"], [], ["bus", "co"], ["x"]]
    rng = random.Random(4)
    pairs = []
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randint(4, 8))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b) - 1)
            b[k : k + 2] = rng.choice([[b[k + 1], b[k]], [b[k]], [b[k], "d", b[k + 1]], ["d", b[k + 1]]])
        pairs.append(("".join(a), "".join(b)))
    # Words over INDEXED_LETTERS long share a form too, wherever their edits are.
    long = "".join(rng.choice("abcdefgh") for _ in range(60))
    pairs += [(long, long[:k] + "z" + long[k:j] + "z" + long[j:]) for k, j in ((0, 1), (5, 39), (39, 50), (2, 59))]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", close_edits(F.col("a"), F.col("b")).alias("d"), F.arrays_overlap(shortened(F.col("a")), shortened(F.col("b"))).alias("met")).collect():
        d = min(distance(r["a"], r["b"]), 3)
        assert r["d"] == d
        assert r["met"] or d > (1 if min(len(r["a"]), len(r["b"])) < 6 else 2)


def test_names_that_share_only_frequent_words(spark):
    """However many names have a word, all that can be aligned under it are."""
    rng = random.Random(6)
    made = lambda k: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(k))
    first = sorted({plain(w) for g in NICKNAMES for w in g.split()})
    crowd = [["verkehr", made(4), *rng.choice([[], [made(3)], ["der", rng.choice(first)], [rng.choice(first), made(3)]])] for _ in range(300)]
    for words in list(crowd):
        w = rng.choice(words[1:])
        near = rng.choice([[w[0]], [w[:3]], [w[:4], w[4:]], [w[0] + w[2::2]], ["ober" + w], [w, made(3)], [w, "der"], [w[:-1] + "x"]])
        crowd.append([x for x in [*rng.sample([y for y in words if y is not w], len(words) - 1), *near] if x])
    names = list({" ".join(sorted(w)): (" ".join(sorted(w)), w, rng.randint(1, 9)) for w in crowd}.values())
    assert link_block(names, "verkehr") == link_block(names) and len(link_block(names)) > 100
    # Both have rarer words than the ones they share.
    rows = [(k, f"Nordland Reisedienst {made(5)}") for k in range(120)] + [(900, "Nordland Reisedienst Qwxylophon"), (901, "Nordland Reisedienst Qwxyl")] * 5
    found = {r["id"]: r["entity"] for r in entities(spark.createDataFrame([("agency", i, n) for i, n in rows], "tab string, id int, name string")).collect()}
    assert found[900] == found[901]
    many = [f"word{made(3)}" for _ in range(20)]
    assert alignment(["x", *many], ["x", *[w[:6] for w in many]]) is not None
