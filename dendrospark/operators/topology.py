"""Trees of nodes: links to parents, depth, path length, subtree size, distances, branches.

A node table has neuron_id, idx, type_id, x, y, z, radius, parent (-1 for a root)
and, where it comes from files, line_no. Two strategies give the same values:

* ``placed`` and ``closure``: blocks of a tree's indices by themselves, then pointer
  doubling in joins over the ends that lead from block to block. A single tree may be
  as large as the table. Depth, path length and root only.
* ``arrow``: one shuffle by neuron, then vectorised pointer doubling over whole
  trees, many per batch. A task holds one tree beyond a batch. The default, since
  trees are small and deep chains would cost a dozen shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

BLOCK = 65_536  # successive indices of a tree that a task holds at once
NODE = ["neuron_id", "idx", "type_id", "x", "y", "z", "radius", "parent"]
ADDED = "has_parent boolean, px double, py double, pz double, pradius double, seg_len double, n_children int, depth int, path_len double, root int, subtree_size int, soma_idx int, sx double, sy double, sz double, soma_depth int, soma_hops int"


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One row per (neuron_id, idx): the last line's values at the first line's place."""
    rest = [c for c in nodes.columns if c not in ("neuron_id", "idx", "line_no")]
    last = nodes.groupBy("neuron_id", "idx").agg(F.max_by(F.struct(*rest), "line_no").alias("v"), F.min("line_no").alias("line_no"))
    return last.select("neuron_id", "idx", "v.*", "line_no")


def is_soma(t: Column) -> Column:
    return t == 1


def is_axon(t: Column) -> Column:
    return t == 2


def is_dendrite(t: Column) -> Column:
    return t.isin(3, 4)


def node_class(t: Column) -> Column:
    """Names of type ids; unknown ones are OTHER."""
    return F.when(t == 1, "SOMA").when(t == 2, "AXON").when(t == 3, "BASAL_DENDRITE").when(t == 4, "APICAL_DENDRITE").otherwise("OTHER")


def mesh_class(t: Column) -> Column:
    return F.when(t == 1, "soma").when(t == 2, "axon").when(t.isin(3, 4), "dendrite").otherwise("other")


def edges(nodes: DataFrame) -> DataFrame:
    """Each node that has its parent in the tree, with the parent's place and radius and the segment between."""
    p = nodes.select("neuron_id", F.col("idx").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("radius").alias("pradius"))
    return nodes.join(p, ["neuron_id", "parent"]).withColumn("seg_len", F.sqrt(sum((F.col(a) - F.col(f"p{a}")) ** 2 for a in "xyz")))


def soma_index(nodes: DataFrame) -> DataFrame:
    """Per neuron the first soma in file order, else the first root, else null."""
    order = "line_no" if "line_no" in nodes.columns else "idx"
    pick = lambda ok: F.min_by(F.when(ok, F.col("idx")), F.when(ok, F.col(order)))
    return nodes.groupBy("neuron_id").agg(F.coalesce(pick(F.col("type_id") == 1), pick(F.col("parent") == -1)).alias("soma_idx"))


def closure(nodes: DataFrame) -> DataFrame:
    """(neuron_id, idx, depth, path_len, root) for trees of any size; nodes on or below a cycle never reach a root and are left out."""
    return placed(nodes).where("depth is not null").select("neuron_id", "idx", "depth", "path_len", "root")


LOCAL = "neuron_id {}, idx int, parent int, x double, y double, z double, end int, hops bigint, len double, out boolean"


def placed(nodes: DataFrame, block: int | None = None) -> DataFrame:
    """(neuron_id, idx, parent, depth, path_len, root) of all nodes, the last three null on or below a cycle.

    A tree is cut into blocks of ``block`` successive indices (``BLOCK`` by default), so no task
    holds more of one. Each block leads its nodes to their last ancestor in it. Those of
    these ends whose parent lies in another block are few where trees are small or numbered
    along branches; they alone are followed from block to block, by doubling in joins.
    """
    block = block or BLOCK
    kind = nodes.schema["neuron_id"].dataType.simpleString()
    rows = nodes.select("neuron_id", F.col("idx").cast("int").alias("idx"), F.col("parent").cast("int").alias("parent"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.floor(F.col("idx") / block).cast("int").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_trees(batches, 7):
            tree, idx, parent, part = tree_numbers(t.column(0)), *(t.column(i).to_numpy().astype(np.int64) for i in (1, 2, 6))
            group = np.cumsum(np.r_[0, (tree[1:] != tree[:-1]) | (part[1:] != part[:-1])])
            me = np.arange(len(idx))
            key = group * 2**32 + (idx + 2**31)
            order = np.argsort(key, kind="stable")
            want = group * 2**32 + (parent + 2**31)
            at = np.minimum(np.searchsorted(key[order], want), len(idx) - 1)
            has = key[order][at] == want
            up = np.where(has, order[at], me)
            xyz = np.stack([t.column(i).to_numpy() for i in (3, 4, 5)], 1)
            end, hops, length = doubled(up, np.where(has, np.sqrt(((xyz - xyz[up]) ** 2).sum(axis=1)), 0.0))
            lost = has[end]  # a way that ends has an end without a parent here
            out = (end == me) & ~has & (parent != -1) & (parent // block != part)
            cols = [pa.array(idx[end], pa.int32(), mask=lost), pa.array(hops), pa.array(length), pa.array(out)]
            yield from pa.table([*t.select([0, 1, 2, 3, 4, 5]).columns, *cols], names=[f.split()[0] for f in LOCAL.split(", ")]).combine_chunks().to_batches(max_chunksize=65_536)

    dealt = rows.withColumn("key", F.xxhash64("neuron_id", "block")).repartition("key").sortWithinPartitions("neuron_id", "block")
    local = stored(dealt.mapInArrow(run, LOCAL.format(kind)), "blocks")
    plain = lambda df: df.select("neuron_id", "idx", "parent", F.when(F.col("end").isNotNull(), F.col("hops")).cast("int").alias("depth"), F.when(F.col("end").isNotNull(), F.col("len")).alias("path_len"), F.col("end").alias("root"))
    leaving = local.where("out").select("neuron_id", "idx", "parent", "x", "y", "z")
    if leaving.isEmpty():
        return plain(local)
    above = local.select("neuron_id", F.col("idx").alias("parent"), F.lit(True).alias("known"), F.col("end").alias("anc"), "hops", "len", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    step = F.sqrt(sum((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"))
    ways = stored(leaving.join(above, ["neuron_id", "parent"], "left").select("neuron_id", "idx", "known", "anc", (F.col("hops") + 1).alias("hops"), (F.col("len") + step).alias("len")), "ways")
    state = ways.where("known and anc is not null").drop("known")
    live = state.select("neuron_id", F.col("idx").alias("anc"))
    before, left = None, state.join(live, ["neuron_id", "anc"], "left_semi").count()
    # Every round but those that only go around cycles finishes some ends, so the first that finishes none is the last.
    while left and left != before:
        jump = state.select("neuron_id", F.col("idx").alias("anc"), F.col("anc").alias("to"), F.col("hops").alias("h"), F.col("len").alias("l"))
        state = stored(state.join(jump, ["neuron_id", "anc"], "left").select("neuron_id", "idx", F.coalesce("to", "anc").alias("anc"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"), (F.col("len") + F.coalesce("l", F.lit(0.0))).alias("len")), "ways")
        before, left = left, state.join(live, ["neuron_id", "anc"], "left_semi").count()
    lost = ways.where("known and anc is null").select("neuron_id", F.col("idx").alias("anc"))
    done = state.join(live.union(lost), ["neuron_id", "anc"], "left_anti").select("neuron_id", F.col("idx").alias("end"), F.col("anc").alias("to"), F.col("hops").alias("h"), F.col("len").alias("l"))
    # What leaves for a parent that isn't there is a top; other leaving ends without a way are lost.
    tops = ways.where("known is null").select("neuron_id", F.col("idx").alias("end"), F.col("idx").alias("to"), F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("l"))
    fate = ways.select("neuron_id", F.col("idx").alias("end")).join(done.union(tops), ["neuron_id", "end"], "left").withColumn("leaves", F.lit(True))
    both = local.join(fate, ["neuron_id", "end"], "left")
    here = F.col("leaves").isNull()
    return plain(both.select("neuron_id", "idx", "parent", F.when(here, F.col("end")).otherwise(F.col("to")).alias("end"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"), (F.col("len") + F.coalesce("l", F.lit(0.0))).alias("len")))


def doubled(parent: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root position, hops and summed value of every node; ``parent`` points roots at themselves. A node that reaches no root keeps a non-root position."""
    anc, hops = parent.copy(), (parent != np.arange(len(parent))).astype(np.int64)
    total = value.copy()
    for _ in range(max(1, len(parent)).bit_length() + 1):
        nxt = anc[anc]
        if (nxt == anc).all():
            break
        hops += hops[anc]
        total += total[anc]
        anc = nxt
    return anc, hops, total


def of_trees(tree: np.ndarray, idx: np.ndarray, kind: np.ndarray, xyz: np.ndarray, radius: np.ndarray, parent: np.ndarray) -> dict[str, np.ndarray]:
    """The added columns for nodes of many trees at once (``tree`` numbers them in order)."""
    n = len(idx)
    me = np.arange(n)
    key = tree.astype(np.int64) * 2**32 + (idx.astype(np.int64) + 2**31)
    order = np.argsort(key, kind="stable")
    want = tree.astype(np.int64) * 2**32 + (parent.astype(np.int64) + 2**31)
    at = np.minimum(np.searchsorted(key[order], want), n - 1)
    has = (key[order][at] == want) & (parent != -1)
    up = np.where(has, order[at], me)
    seg = np.where(has, np.sqrt(((xyz - xyz[up]) ** 2).sum(axis=1)), 0.0)
    root, hops, path = doubled(up, seg)
    good = (up[root] == root) & ~(has & (up == me))[root]  # a node that is its own parent is a cycle, not a root
    children = np.bincount(up[has], minlength=n)
    size = np.ones(n, np.int64)
    deep = np.flatnonzero(has & good)
    deep = deep[np.argsort(-hops[deep], kind="stable")]
    cuts = np.flatnonzero(np.diff(hops[deep])) + 1
    for level in np.split(deep, cuts):
        np.add.at(size, up[level], size[level])
    # The soma of each tree: its first soma node, else its first root.
    first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    number = np.cumsum(np.r_[True, tree[1:] != tree[:-1]]) - 1
    soma = np.full(len(first), n)
    roots = np.full(len(first), n)
    np.minimum.at(soma, number[kind == 1], me[kind == 1])
    np.minimum.at(roots, number[parent == -1], me[parent == -1])
    soma = np.where(soma < n, soma, roots)
    mine = soma[number]
    known = mine < n
    mine = np.where(known, mine, 0)
    # Hops to the soma: the deepest ancestor that is also above the soma, by doubling with those as ends.
    above = np.zeros(n, bool)
    walk = soma[soma < n]
    for _ in range(int(hops.max()) + 1 if n else 0):
        above[walk] = True
        walk = np.unique(up[walk])
        if above[walk].all():
            break
    meet, _, _ = doubled(np.where(above, me, up), seg)
    away = np.where(known & (root == root[mine]) & good, hops + hops[mine] - 2 * hops[meet], -1)
    return {
        "has_parent": has, "px": xyz[up, 0], "py": xyz[up, 1], "pz": xyz[up, 2], "pradius": radius[up], "seg_len": seg, "n_children": children, "depth": np.where(good, hops, -1), "path_len": path,
        "root": idx[root], "subtree_size": size, "soma_idx": np.where(known, idx[mine], -(2**31)), "sx": xyz[mine, 0], "sy": xyz[mine, 1], "sz": xyz[mine, 2], "soma_depth": hops[mine], "soma_hops": away,
    }


def whole_trees(batches: Iterator[pa.RecordBatch], key: int, least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``least`` rows or more that end where the ``key`` column, by which the batches are sorted, changes."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= least:
            last, keys = held[-1].column(key)[-1], batch.column(key)
            same = pc.fill_null(pc.equal(keys, last), False) if last.is_valid else pc.is_null(keys)
            cut = pc.index(same, False).as_py()
            if cut >= 0:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def tree_numbers(col: pa.ChunkedArray) -> np.ndarray:
    codes = col.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.r_[0, codes[1:] != codes[:-1]])


def topology(nodes: DataFrame, more: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, tuple[np.ndarray, np.ndarray | None]]] | None = None, fields: str = "") -> DataFrame:
    """Nodes with has_parent, the parent's place and radius, seg_len, n_children, depth, path_len, root, subtree_size, the soma and the hops to it.

    ``depth`` is null for nodes that reach no root (cycles); ``soma_hops`` is null
    outside the soma's component. Order within a tree is that of line_no, or idx.
    ``more`` adds ``fields`` in the same pass: it gets the nodes' tree numbers and their columns
    for some whole trees and returns values and which of them are null.
    """
    order = "line_no" if "line_no" in nodes.columns else "idx"
    names = nodes.columns
    added = [*T.StructType.fromDDL(ADDED).fields, *(T.StructType.fromDDL(fields).fields if more else [])]
    schema = T.StructType([*nodes.schema.fields, *added])
    at = {c: names.index(c) for c in NODE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_trees(batches, at["neuron_id"]):
            yield from done(t)

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda c: t.column(at[c]).to_numpy()
        tree, xyz = tree_numbers(t.column(at["neuron_id"])), np.stack([get(c).astype(float) for c in "xyz"], 1)
        out = of_trees(tree, get("idx"), get("type_id"), xyz, get("radius").astype(float), get("parent"))
        rest = more(tree, out | {"parent": get("parent")} | dict(zip("xyz", xyz.T, strict=True))) if more else {}
        cols = []
        for f in added:
            v, null = rest.get(f.name) or (out[f.name], None)
            hide = {"depth": out["depth"] < 0, "subtree_size": out["depth"] < 0, "root": out["depth"] < 0, "path_len": out["depth"] < 0, "soma_hops": out["soma_hops"] < 0, "soma_idx": out["soma_idx"] == -(2**31)}.get(f.name, null)
            cols.append(pa.array(v, {"boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()], mask=hide))
        table = pa.table([*t.columns, *cols], names=schema.names)
        yield from table.combine_chunks().to_batches(max_chunksize=65_536)

    return nodes.repartition("neuron_id").sortWithinPartitions("neuron_id", order).mapInArrow(run, schema)


def ancestors(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(neuron_id, idx, anc, hops): all ancestors of the wanted nodes, themselves at 0 hops, in as many rounds as the greatest depth has binary digits.

    A node on or below a cycle has only itself.
    """
    mine = nodes.join(wanted.select("neuron_id").distinct(), "neuron_id", "left_semi")
    linked = stored(placed(mine).where("depth > 0").select("neuron_id", F.col("idx").alias("anc"), F.col("parent").alias("next"), "depth"), "links")
    deepest, step = linked.agg(F.max("depth")).first()[0] or 0, 1
    jump = linked.drop("depth")
    all_ = wanted.select("neuron_id", "idx", F.col("idx").alias("anc"), F.lit(0).alias("hops")).distinct()
    while step <= deepest:
        more = all_.join(jump, ["neuron_id", "anc"]).select("neuron_id", "idx", F.col("next").alias("anc"), (F.col("hops") + step).alias("hops"))
        all_ = stored(all_.union(more), "ancestors")
        step *= 2
        if step <= deepest:
            jump = stored(jump.join(jump.toDF("neuron_id", "next", "to"), ["neuron_id", "next"]).select("neuron_id", "anc", F.col("to").alias("next")), "jumps")
    return all_


PAIR = "neuron_id {}, a int, b int, distance double, distance_ref double"


def pair_distances(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(neuron_id, a, b, distance, distance_ref) of node pairs (neuron_id, a, b), by their lowest common ancestor.

    ``distance`` is the length of the way between both; ``distance_ref`` is the
    reference's rule: from ``a`` up to the first node also above ``b``, and as many
    steps up from ``b`` (or to its root), so it depends on the order. Both are
    infinite without a common ancestor, also for nodes on or below a cycle, and
    null for nodes that are not there. Neurons of more than ``BLOCK`` nodes are dealt
    to tasks root by root; the ancestors of many trees' pairs are looked up at once by
    binary lifting.
    """
    kind = nodes.schema["neuron_id"].dataType.simpleString()
    large = nodes.groupBy("neuron_id").count().where(F.col("count") > BLOCK).select("neuron_id")
    large = stored(large, "large")
    tagged = nodes.select("neuron_id", F.lit(0).alias("pair"), F.col("idx").cast("int"), F.col("parent").cast("int"), *[F.col(c).cast("double") for c in "xyz"])
    asked = pairs.select("neuron_id", F.lit(1).alias("pair"), F.col("a").cast("int").alias("idx"), F.col("b").cast("int").alias("parent"), *[F.lit(0.0).alias(c) for c in "xyz"])
    rows = tagged.union(asked)
    if not large.isEmpty():
        # Pairs go to the root of ``a``. Of those with a ``b`` of another root, or without any, only whether both are there is asked.
        roots = stored(placed(nodes.join(large, "neuron_id", "left_semi")).select("neuron_id", "idx", F.coalesce("root", F.lit(-1)).alias("part"), F.col("root").isNotNull().alias("rooted")), "roots")
        place = lambda c: roots.select("neuron_id", F.col("idx").alias(c), F.col("part").alias(f"part_{c}"), F.col("rooted").alias(f"rooted_{c}"))
        whole = tagged.join(large, "neuron_id", "left_semi").join(roots.where("rooted").drop("rooted"), ["neuron_id", "idx"])
        known = asked.join(large, "neuron_id", "left_semi").select("neuron_id", F.col("idx").alias("a"), F.col("parent").alias("b")).join(place("a"), ["neuron_id", "a"], "left").join(place("b"), ["neuron_id", "b"], "left")
        share = F.coalesce(F.col("rooted_a") & F.col("rooted_b") & (F.col("part_a") == F.col("part_b")), F.lit(False))
        apart = F.when(F.col("part_a").isNotNull() & F.col("part_b").isNotNull(), F.lit(float("inf")))
        none = known.where(~share).select("neuron_id", "a", "b", apart.alias("distance"), apart.alias("distance_ref"))
        near = known.where(share).select("neuron_id", F.lit(1).alias("pair"), F.col("a").alias("idx"), F.col("b").alias("parent"), *[F.lit(0.0).alias(c) for c in "xyz"], F.col("part_a").alias("part"))
        small = rows.join(large, "neuron_id", "left_anti").withColumn("part", F.lit(0))
        rows = small.unionByName(whole).unionByName(near)
    else:
        none, rows = None, rows.withColumn("part", F.lit(0))
    rows = rows.select("neuron_id", "pair", "idx", "parent", *"xyz", "part", F.xxhash64("neuron_id", "part").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_trees(batches, 8):
            tree, part, pair = tree_numbers(t.column(0)), t.column(7).to_numpy(), t.column(1).to_numpy() == 1
            tree = np.cumsum(np.r_[0, (tree[1:] != tree[:-1]) | (part[1:] != part[:-1])])
            idx, other = (t.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            if not pair.any():
                continue
            key = lambda who, i: tree[who].astype(np.int64) * 2**32 + (i + 2**31)
            own = key(~pair, idx[~pair])
            order = np.argsort(own, kind="stable")
            xyz = np.stack([t.column(i).to_numpy()[~pair] for i in (4, 5, 6)], 1)
            ask = pair.nonzero()[0]
            dist, ref = distances(own[order], order, xyz, key(~pair, other[~pair]), other[~pair] == -1, key(ask, idx[ask]), key(ask, other[ask]))
            out = pa.table({"neuron_id": t.column(0).take(pa.array(ask)), "a": t.column(2).take(pa.array(ask)), "b": t.column(3).take(pa.array(ask)), "distance": pa.array(dist, mask=np.isnan(dist)), "distance_ref": pa.array(ref, mask=np.isnan(ref))})
            yield from out.combine_chunks().to_batches(max_chunksize=65_536)

    found = rows.repartition("key").sortWithinPartitions("neuron_id", "part", "pair").mapInArrow(run, PAIR.format(kind))
    return found if none is None else found.unionByName(none)


def distances(keys: np.ndarray, order: np.ndarray, xyz: np.ndarray, want: np.ndarray, root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both distances of pairs of keys among nodes with sorted ``keys`` at ``order``, whose parents have the keys ``want``; nan where a node is not there."""
    none = np.full(len(a), np.nan)
    if not len(keys):
        return none, none.copy()

    def place(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return order[at], keys[at] == k

    up, has = place(want)
    me = np.arange(len(want))
    up = np.where(has & ~root, up, me)
    top, hops, path = doubled(up, np.sqrt(((xyz - xyz[up]) ** 2).sum(axis=1)))
    (a, in_a), (b, in_b) = place(a), place(b)
    lifts = [up]
    good = (up[top] == top) & ~(has & ~root & (up == me))[top]
    while 2 ** len(lifts) <= int(hops[good].max(initial=0)):
        lifts.append(lifts[-1][lifts[-1]])

    def lifted(x: np.ndarray, steps: np.ndarray) -> np.ndarray:
        for k, lift in enumerate(lifts):
            x = np.where(steps >> k & 1, lift[x], x)
        return x

    share = good[a] & good[b] & (top[a] == top[b])
    steps = np.where(share, hops[a] - hops[b], 0)
    x, y = lifted(a, np.maximum(steps, 0)), lifted(b, np.maximum(-steps, 0))
    for lift in lifts[::-1]:
        apart = lift[x] != lift[y]
        x, y = np.where(apart, lift[x], x), np.where(apart, lift[y], y)
    meet = np.where(x == y, x, up[x])
    far = lifted(b, np.where(share, np.minimum(hops[a] - hops[meet], hops[b]), 0))
    out = [np.where(share, path[a] + path[b] - 2 * path[meet], np.inf), np.where(share, path[a] - path[meet] + path[b] - path[far], np.inf)]
    return tuple(np.where(in_a & in_b, d, np.nan) for d in out)


def path_distance(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(neuron_id, a, b, distance) along the tree; see ``pair_distances``."""
    return pair_distances(nodes, pairs).drop("distance_ref")


def path_distance_ref(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(neuron_id, a, b, distance) by the reference's rule; see ``pair_distances``."""
    return pair_distances(nodes, pairs).select("neuron_id", "a", "b", F.col("distance_ref").alias("distance"))


def branches(nodes: DataFrame) -> DataFrame:
    """Maximal unbranched runs below each start (a root or branch point): (neuron_id, first child, start, node list from start to end, length)."""
    t = topology(nodes).where("depth is not null")
    # A node continues its parent's run if the parent is neither a root nor a branch point.
    cont = t.select("neuron_id", "idx", "parent", "depth", "seg_len", "has_parent")
    inner = t.where((F.col("n_children") == 1) & F.col("has_parent")).select("neuron_id", F.col("idx").alias("parent"), F.lit(True).alias("on"))
    linked = cont.where("has_parent").join(inner, ["neuron_id", "parent"], "left")
    runs = linked.select("neuron_id", "idx", F.when(F.col("on"), F.col("parent")).otherwise(-1).alias("parent"), F.lit(0).alias("type_id"), F.col("seg_len").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("radius"))
    head = topology(runs).select("neuron_id", "idx", F.col("root").alias("first"))
    rows = head.join(cont, ["neuron_id", "idx"])
    out = rows.groupBy("neuron_id", "first").agg(F.sort_array(F.collect_list(F.struct("depth", "idx", "parent"))).alias("p"), F.sum("seg_len").alias("length"))
    return out.select("neuron_id", "first", F.col("p")[0]["parent"].alias("start"), F.concat(F.array(F.col("p")[0]["parent"]), F.col("p.idx")).alias("nodes"), "length")


def typed_branches(nodes: DataFrame) -> DataFrame:
    """``branches`` with the mesh class of the node that each starts at, joined by its id (not by its place, which others may share)."""
    kind = nodes.select("neuron_id", F.col("idx").alias("start"), mesh_class(F.col("type_id")).alias("class"))
    return branches(nodes).join(kind, ["neuron_id", "start"])


def position(nodes: DataFrame) -> DataFrame:
    """Nodes with their position as a vector."""
    return nodes.withColumn("position", F.array("x", "y", "z"))


def junctions(nodes: DataFrame) -> DataFrame:
    """Roots and nodes whose number of children is not one."""
    kids = nodes.where("parent <> -1").groupBy("neuron_id", F.col("parent").alias("idx")).agg(F.count("*").alias("n"))
    rows = nodes.join(kids, ["neuron_id", "idx"], "left")
    return rows.where((F.col("parent") == -1) | (F.coalesce("n", F.lit(0)) != 1)).select(*nodes.columns)


KINDS = ("root", "soma", "axon", "dendrite", "branch_point", "terminal")


def of_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    """Nodes with ``kind``, once for each of the kinds (all of KINDS by default) that they are of; a node without children is a terminal, one with several a branch point."""
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    kids = nodes.where("parent <> -1").groupBy("neuron_id", F.col("parent").alias("idx")).agg(F.count("*").alias("__n"))
    rows = nodes.join(kids, ["neuron_id", "idx"], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    t = F.col("type_id")
    tests = {"root": F.col("parent") == -1, "soma": is_soma(t), "axon": is_axon(t), "dendrite": is_dendrite(t), "branch_point": F.col("__n") > 1, "terminal": F.col("__n") == 0}
    named = F.array_compact(F.array(*[F.when(tests[k], k) for k in kinds or KINDS]))
    return rows.withColumn("kind", F.explode(named)).select(*nodes.columns, "kind")


def subtree(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(neuron_id, start, idx): the nodes at and below each start node (neuron_id, idx)."""
    anc = ancestors(nodes, nodes.join(start.select("neuron_id").distinct(), "neuron_id", "left_semi"))
    return anc.join(start.select("neuron_id", F.col("idx").alias("anc")), ["neuron_id", "anc"]).select("neuron_id", F.col("anc").alias("start"), "idx")


def file_order(nodes: DataFrame) -> DataFrame:
    """Nodes with line_no filled from idx order where files gave none."""
    if "line_no" in nodes.columns:
        return nodes
    return nodes.withColumn("line_no", F.row_number().over(Window.partitionBy("neuron_id").orderBy("idx")))
