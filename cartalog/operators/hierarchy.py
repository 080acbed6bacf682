"""Parent-child links to full hierarchies: root, depth, path, number of descendants, and loops.

Leaves are peeled from below, round by round: each round's leaves send their subtree sizes, summed per parent before the shuffle, and drop
out. Then the rounds are gone through in reverse: when a round's turn comes, the parents of its nodes have their root, depth and path.
Rounds shrink fast, so both directions together shuffle little more than the table itself. Once the rows left are few, by a checked bound, a
single task peels the rest, however deep. Once a round peels hardly anything, chains or loops are left, and these go by steps that double:
rounds are as many as the logarithm of the depth, and nodes that no number of steps brings to a root are on loops or below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartalog.session import broadcast_if_small, cut

#: Rows left, at most, that one task peels to the end.
CORE_ROWS = 10_000
#: A round that peels less than this share of the rows left meets long chains or loops: what is left then goes by doubling steps.
THIN = 0.05
#: Rows of finished parents, at most, that are broadcast to the next round.
FINISHED_ROWS = 50_000

_DONE = "id {t}, node_kind string, root_id {t}, n_above int, n_below bigint, id_path string"


def _peel_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finishes the bounded rest: peels it, marks its loops, and assigns from the roots down."""
    parents, kids, below, kind = {}, {}, {}, pa.int64()
    for batch in batches:
        kind = batch.schema.field("id").type
        for i, up, k, n in zip(*(batch.column(c).to_pylist() for c in ("id", "par", "kids", "below")), strict=True):
            parents[i], kids[i], below[i] = up, k, n
    order, at = [i for i in parents if kids[i] == 0], 0
    while at < len(order):
        node = order[at]
        at += 1
        up = parents[node]
        if up is not None:
            kids[up] -= 1
            below[up] += below[node] + 1
            if kids[up] == 0:
                order.append(up)
    peeled = set(order)
    out = {i: (i, "on_cycle", None, -1, -1, "") for i in parents if i not in peeled}
    for node in reversed(order):
        up = parents[node]
        if up is None:
            out[node] = (node, "tree", node, 0, below[node], str(node))
        elif out[up][1] == "tree":
            out[node] = (node, "tree", out[up][2], out[up][3] + 1, below[node], f"{out[up][5]}/{node}")
        else:
            out[node] = (node, "below_cycle", None, -1, -1, "")
    schema = pa.schema([("id", kind), ("node_kind", pa.string()), ("root_id", kind), ("n_above", pa.int32()), ("n_below", pa.int64()), ("id_path", pa.string())])
    columns = zip(*out.values(), strict=True) if out else [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _doubled(alive: DataFrame, count: int, kind: str) -> DataFrame:
    """Finishes rows left of any depth in rounds that double the steps: ancestors and sizes of whole stretches first, then the paths of trees.

    A node counts what is less than 2^k steps below it; who has it as ancestor of exactly 2^k steps hands up what is counted below itself. After as
    many doublings as there are rows, the only ancestors left are the nodes on loops. Nodes whose ancestor is a root need no further look-up.
    """
    tops = alive.where("par is null").select(F.col("id").alias("anc"), F.lit(True).alias("top"))
    active = alive.where("par is not null").select("id", F.col("par").alias("anc"), (F.col("below") + 1).alias("s")).join(broadcast_if_small(tops, FINISHED_ROWS), "anc", "left")
    start = cut(active.select("id", "anc", F.coalesce("top", F.lit(False)).alias("top"), "s"))
    state, above = start, cut(alive.where("par is null").select("id", (F.col("below") + 1).alias("s")))
    sizes = [above]  # of nodes that need no further look-up, and what is handed up to them later
    for _ in range(max(1, count.bit_length()) + 1):
        handed = state.groupBy(F.col("anc").alias("id")).agg(F.sum("s").alias("more"))
        sizes.append(cut(handed.join(state.select("id"), "id", "left_anti").select("id", F.col("more").alias("s"))))
        sizes.append(cut(state.where("top").select("id", "s").join(handed, "id", "left").select("id", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s"))))
        rest = state.where("not top").join(handed, "id", "left").select("id", "anc", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s"))
        further = state.select(F.col("id").alias("anc"), F.col("anc").alias("next"), "top")
        # Who has an ancestor so far up, but none as far from there, has counted what is below it and hands up no more.
        stepped = cut(rest.join(further, "anc", "left").select("id", F.col("next").alias("anc"), "top", "s"))
        sizes.append(stepped.where("anc is null").select("id", "s"))
        state = stepped.where("anc is not null")
        if not state.limit(1).count():
            break
    loops = cut(state.select("id"))
    cycle = cut(state.groupBy("anc").agg(F.lit(True).alias("on")).select(F.col("anc").alias("id"), "on"))
    none = (F.lit(None).cast(kind).alias("root_id"), F.lit(-1).alias("n_above"), F.lit(-1).cast("bigint").alias("n_below"), F.lit("").alias("id_path"))
    looped = loops.join(cycle, "id", "left").select("id", F.when(F.col("on"), "on_cycle").otherwise("below_cycle").alias("node_kind"), *none)
    # Paths of trees: each round puts the ancestor's stretch before the own one.
    size = reduce(DataFrame.unionByName, sizes).groupBy("id").agg((F.sum("s") - 1).alias("n_below"))
    text = F.col("id").cast("string")
    paths = alive.where("par is null").select("id", F.col("id").alias("root_id"), F.lit(0).alias("n_above"), text.alias("id_path"))
    state = cut(start.join(loops, "id", "left_anti").select("id", "anc", F.lit(1).alias("steps"), text.alias("path")))
    while state.limit(1).count():
        finished = paths.select(F.col("id").alias("anc"), F.col("root_id").alias("found_root"), F.lit(None).cast(kind).alias("next"), F.col("n_above").alias("more"), F.col("id_path").alias("before"))
        going = state.select(F.col("id").alias("anc"), F.lit(None).cast(kind).alias("found_root"), F.col("anc").alias("next"), F.col("steps").alias("more"), F.col("path").alias("before"))
        step = state.select("id", "anc", "steps", "path").join(finished.unionByName(going), "anc")
        step = cut(step.select("id", "found_root", F.col("next").alias("anc"), (F.col("steps") + F.col("more")).alias("steps"), F.concat_ws("/", "before", "path").alias("path")))
        paths = paths.unionByName(step.where("anc is null").select("id", F.col("found_root").alias("root_id"), F.col("steps").alias("n_above"), F.col("path").alias("id_path")))
        state = step.where("anc is not null")
    trees = paths.join(size, "id")
    return looped.unionByName(trees.select("id", F.lit("tree").alias("node_kind"), "root_id", "n_above", "n_below", "id_path"))


def hierarchy(df: DataFrame, node: str, parent: str, core_rows: int = CORE_ROWS) -> DataFrame:
    """(id, node_kind, root_id, n_above, n_below, id_path) of each node, ids as whole numbers.

    A root has a parent that is null, itself or no node. node_kind is tree, on_cycle or below_cycle; but for tree, root_id, n_above and
    n_below are -1 and id_path is ''. Rows without id are left out, repeated rows count once; of several parents of one id the smallest
    is taken. An empty table gives an empty one. The input's other columns, whatever their names, play no part.
    """
    kind = df.schema[node].dataType.simpleString()
    rows = df.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(parent).cast(kind).alias("up"))
    rows = cut(rows)
    # Which parents exist: each is looked up once, however many children it has.
    wanted = rows.where(F.col("up").isNotNull() & (F.col("up") != F.col("id"))).groupBy("up").agg(F.count(F.lit(1)).alias("kids"))
    known = cut(wanted.join(rows.select(F.col("id").alias("up")), "up"))
    linked = rows.join(known.select("up", F.lit(True).alias("known")), "up", "left")
    linked = linked.select("id", F.when(F.col("known") & (F.col("up") != F.col("id")), F.col("up")).alias("par"))
    alive = linked.join(known.select(F.col("up").alias("id"), "kids"), "id", "left").select("id", "par", F.coalesce("kids", F.lit(0)).alias("kids"), F.lit(0).cast("bigint").alias("below"))
    alive = cut(alive)
    rounds: list[DataFrame] = []
    left = alive.count()
    while left > core_rows:
        leaves = alive.where("kids = 0")
        sent = leaves.where("par is not null").groupBy(F.col("par").alias("id")).agg(F.count(F.lit(1)).alias("fewer"), F.sum(F.col("below") + 1).alias("more"))
        rest = alive.where("kids > 0").join(sent, "id", "left")
        rest = cut(rest.select("id", "par", (F.col("kids") - F.coalesce("fewer", F.lit(0))).alias("kids"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")))
        now = rest.count()
        if now == left:  # nothing but loops
            break
        rounds.append(leaves)
        thin = left - now < THIN * left
        alive, left = rest, now
        if thin:
            break
    done = _doubled(alive, left, kind) if left > core_rows else alive.coalesce(1).mapInArrow(_peel_core, _DONE.format(t=kind))
    done, finished = cut(done), left
    for leaves in reversed(rounds):
        above = done.select(F.col("id").alias("par"), F.col("node_kind").alias("k"), F.col("root_id").alias("r"), F.col("n_above").alias("a"), F.col("id_path").alias("p"))
        joined = leaves.join(F.broadcast(above) if finished <= FINISHED_ROWS else above, "par", "left")
        root, tree = F.col("par").isNull(), F.col("k") == "tree"
        text = F.col("id").cast("string")
        new = joined.select(
            "id",
            F.when(root | tree, "tree").otherwise("below_cycle").alias("node_kind"),
            F.when(root, F.col("id")).when(tree, F.col("r")).alias("root_id"),
            F.when(root, 0).when(tree, F.col("a") + 1).otherwise(-1).alias("n_above"),
            F.when(root | tree, F.col("below")).otherwise(-1).alias("n_below"),
            F.when(root, text).when(tree, F.concat_ws("/", "p", text)).otherwise("").alias("id_path"),
        )
        new = cut(new)
        finished += new.count()
        done = done.unionByName(new)
    return done.select("id", "node_kind", F.coalesce("root_id", F.lit(-1).cast(kind)).alias("root_id"), F.col("n_above").cast("int").alias("n_above"), F.col("n_below").cast("int").alias("n_below"), "id_path")


def descendants(hierarchy_rows: DataFrame) -> DataFrame:
    """(above, below, steps): every pair of a node and a node under it, from hierarchy()'s rows; nodes on loops or under them have none."""
    ids = F.split("id_path", "/")
    pairs = hierarchy_rows.where("n_above > 0").select(F.posexplode(F.slice(ids, 1, F.col("n_above"))).alias("at", "above"), F.col("id").alias("below"), "n_above")
    return pairs.select(F.col("above").cast(hierarchy_rows.schema["id"].dataType).alias("above"), "below", (F.col("n_above") - F.col("at")).alias("steps"))
