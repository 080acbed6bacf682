import random

import pytest

from cartalog.operators.hierarchy import descendants, hierarchy


def brute(par):
    out, below = {}, dict.fromkeys(par, 0)
    for i in par:
        path, seen, kind = [i], {i}, "tree"
        while True:
            up = par[path[-1]]
            if up is None or up == path[-1] or up not in par:
                break
            if up in seen:
                kind = "on_cycle" if up == i else "below_cycle"
                break
            seen.add(up)
            path.append(up)
        out[i] = [kind, path[-1] if kind == "tree" else -1, len(path) - 1 if kind == "tree" else -1, "/".join(map(str, path[::-1])) if kind == "tree" else ""]
        if kind == "tree":
            for up in path[1:]:
                below[up] += 1
    return {i: (v[0], v[1], v[2], below[i] if v[0] == "tree" else -1, v[3]) for i, v in out.items()}


def rows(df):
    return {r["id"]: (r["node_kind"], r["root_id"], r["n_above"], r["n_below"], r["id_path"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "core"), [(1, 0), (2, 0), (3, 20), (4, 10_000)])
def test_random(spark, seed, core):
    rng = random.Random(seed)
    ids = rng.sample(range(2**53, 2**53 + 500), 120)
    par = {i: rng.choice([None, i, 5, *ids, *ids[:3], *ids[:3]]) if k % 4 else ids[max(0, k - 4)] for k, i in enumerate(ids)}
    df = spark.createDataFrame([(i, p, i, "tree") for i, p in par.items()], "id bigint, parid bigint, root_id bigint, node_kind string")
    assert rows(hierarchy(df.union(df), "id", "parid", core_rows=core)) == brute(par)


def test_one_parent_of_all_and_a_chain(spark):
    par = {0: None, **{i: 0 for i in range(1, 60)}, **{i: i - 1 for i in range(60, 75)}}
    df = spark.createDataFrame(list(par.items()), "id int, parid int")
    assert rows(hierarchy(df, "id", "parid", core_rows=5)) == brute(par)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1)], "id bigint, parid bigint")
    found = hierarchy(df, "id", "parid")
    assert rows(found) == {1: ("tree", 1, 0, 1, "1"), 2: ("tree", 1, 1, 0, "1/2")}
    assert [tuple(r) for r in descendants(found).collect()] == [(1, 2, 1)]
    assert hierarchy(df.limit(0), "id", "parid").count() == 0


def test_only_loops(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "id bigint, parid bigint")
    kinds = {r["id"]: r["node_kind"] for r in hierarchy(df, "id", "parid", core_rows=0).collect()}
    assert kinds == {1: "on_cycle", 2: "on_cycle", 3: "on_cycle", 9: "below_cycle"}


def test_long_chains_and_large_loops(spark):
    """Chains with branches beside loops of several sizes, all by doubling steps."""
    rng = random.Random(7)
    par = {0: None, **{i: i - 1 for i in range(1, 700)}, **{1000 + i: rng.randrange(700) for i in range(300)}}
    for start, size in ((2000, 1), (2010, 2), (2100, 37), (2200, 128)):
        par.update({start + i: start + (i + 1) % size for i in range(size)})
        par[start] = start + 1 if size > 1 else start + 5000
    par.update({3000 + i: rng.choice([2010, 2101, 2205, *range(3000, 3000 + i)]) for i in range(60)})
    df = spark.createDataFrame(list(par.items()), "id bigint, parid bigint")
    assert rows(hierarchy(df, "id", "parid", core_rows=0)) == brute(par)
