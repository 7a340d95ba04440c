"""Parent-child links to full hierarchies: path, depth, root and descendants of each node, and the cycles.

Bottom-up leaf peeling: nodes without unpeeled children send their descendant lists and subtree sizes to their parents
and leave; what never leaves lies on a cycle. The reverse order of peeling hands paths and depths down from the roots.
Whole groups of up to max_group nodes are packed by a hash of the group into tasks of even size, and each task peels
all its groups at once. A larger group is not gathered. There the peel goes over rows, in strides that double: in round
k every node sends what it has gathered from the 2^k levels below it to its ancestor 2^k levels up and gets that one's
path, so log2(depth) rounds do, and descendants come as pairs only.

Defined results: of several rows of a node the one with the largest time holds, of equal times the one with the
largest parent. No list, an empty list, and null or empty names in it are no parent; of several names the first holds.
A parent that is no node of the group ends the chain, so its child is a root. Names, also blank ones, are compared
exactly; a null group or name is equal to another null. Nodes on or below a cycle have no path, depth or root but the
cycle's smallest name, and no descendants. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import buckets_for, cut_lineage, written

#: Nodes of a group, and of a task, that are peeled together. Paths and descendant lists grow with the square of a
#: chain's length, so the bounds keep the worst case within a task's memory.
MAX_GROUP = 2_000
NODES_PER_TASK, NODES_PER_TASK_LISTED = 10_000, 4_000
_TREE = (
    "tenant STRING, def_name STRING, name STRING, parent STRING, path STRING, depth INT, root STRING, "
    "n_descendants BIGINT, descendants ARRAY<STRING>, cycle_head STRING"
)


def current_nodes(rows: DataFrame) -> DataFrame:
    """(tenant, def_name, name, parent): the latest row of each node."""
    parent = F.get(F.filter("depends_on", lambda x: x.isNotNull() & (x != "")), F.lit(0))
    latest = F.max(F.struct("updated_at_ms", parent.alias("parent"))).alias("latest")
    return rows.groupBy("tenant", "def_name", "name").agg(latest).select("tenant", "def_name", "name", "latest.parent")


def peel(parent: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Layers of leaves, bottom up, of a forest given by each node's parent (-1: none); and a mask of the cycles' nodes."""
    has = parent >= 0
    children = np.bincount(parent[has], minlength=len(parent))
    layers, layer = [], np.flatnonzero(children == 0)
    left = np.ones(len(parent), dtype=bool)
    while len(layer):
        layers.append(layer)
        left[layer] = False
        up = parent[layer]
        up = up[up >= 0]
        np.subtract.at(children, up, 1)
        touched = np.unique(up)
        layer = touched[children[touched] == 0]
    return layers, left


def cycle_heads(parent: np.ndarray, on_cycle: np.ndarray, names: list) -> dict[int, str]:
    """The smallest name on its cycle for each node on one."""
    heads: dict[int, str] = {}
    for node in np.flatnonzero(on_cycle):
        if node in heads:
            continue
        ring, at = [], int(node)
        while at not in heads and at not in ring[:1]:
            ring.append(at)
            at = int(parent[at])
        smallest = min(names[i] for i in ring)
        for i in ring:
            heads[i] = smallest
    return heads


def trees(nodes: pd.DataFrame, listed: bool = True) -> pd.DataFrame:
    """Hierarchies of all groups in one frame (tenant, def_name, name, parent); listed: with descendant lists."""
    count = len(nodes)
    keys = list(zip(nodes["tenant"], nodes["def_name"], nodes["name"]))
    at = {key: i for i, key in enumerate(keys)}
    parents = nodes["parent"].tolist()
    parent = np.fromiter(
        (-1 if p is None else at.get((k[0], k[1], p), -1) for k, p in zip(keys, parents)), dtype=np.int64, count=count
    )
    names = [key[2] for key in keys]
    layers, on_cycle = peel(parent)
    size = np.zeros(count, dtype=np.int64)
    below: list[list[int]] = [[] for _ in range(count)]
    for layer in layers:
        for node in layer:
            up = parent[node]
            if up >= 0 and not on_cycle[up]:
                size[up] += size[node] + 1
                if listed:
                    below[up].append(node)
                    below[up].extend(below[node])
    heads = cycle_heads(parent, on_cycle, names)
    path: list[str | None] = [None] * count
    depth, root = [None] * count, [None] * count
    head: list[str | None] = [heads.get(i) for i in range(count)]
    for layer in reversed(layers):
        for node in layer:
            up = parent[node]
            if up < 0:
                path[node], depth[node], root[node] = names[node], 0, names[node]
            elif head[up] is not None:
                head[node] = head[up]
            else:
                path[node], depth[node], root[node] = f"{path[up]}/{names[node]}", depth[up] + 1, root[up]
    return pd.DataFrame(
        {
            "tenant": nodes["tenant"],
            "def_name": nodes["def_name"],
            "name": names,
            "parent": [names[p] if p >= 0 else None for p in parent],
            "path": path,
            "depth": pd.array(depth, dtype="Int32"),
            "root": root,
            "n_descendants": pd.array([None if h is not None else int(s) for h, s in zip(head, size)], dtype="Int64"),
            "descendants": [None if h is not None or not listed else sorted((names[i] for i in b), key=lambda x: (x is not None, x or "")) for h, b in zip(head, below)],
            "cycle_head": head,
        }
    )


_GROUP = ["tenant", "def_name"]


def _told(linked: DataFrame) -> DataFrame:
    """(group..., name, parent, far, low): far is null for the nodes of trees; for others, far lies on the node's cycle and
    low is the smallest name on the way to it, and round the cycle for nodes on one.

    Steps up double: far is the ancestor 2^k steps up. A tree with nodes of some depth has nodes of every smaller depth, so
    once a round leaves as many nodes with a far one as the round before, these never end, and they go on until their steps
    reach round any cycle they can form.
    """
    state = written(linked.select(*_GROUP, "name", "parent", F.col("parent").alias("far"), F.col("name").alias("low")), "told")
    left, steps, settled = state.where("far IS NOT NULL").count(), 1, False
    while left and not (settled and steps > left):
        up = state.select(*_GROUP, F.col("name").alias("far"), F.col("far").alias("far2"), F.col("low").alias("low2"))
        moved = state.where("far IS NOT NULL").join(up, [*_GROUP, "far"]).select(
            *_GROUP, "name", "parent", F.col("far2").alias("far"), F.least("low2", "low").alias("low")
        )
        state = written(state.where("far IS NULL").unionByName(moved), "told", instead_of=state)
        before, left, steps = left, state.where("far IS NOT NULL").count(), 2 * steps
        settled = settled or left == before
    return state


def _gathered(forest: DataFrame) -> DataFrame:
    """(group..., name, parent, chain, size): the names from the root to each node, and the nodes of its subtree.

    Strides double: in round k a node hands what it has gathered from the 2^k levels below it to its ancestor 2^k levels
    up, and takes that one's chain. Sizes are sums, of one row a node; pairs of nodes are never formed.
    """
    state = written(forest.select(*_GROUP, "name", "parent", F.col("parent").alias("far"), F.array("name").alias("chain"), F.lit(1).cast("bigint").alias("size")), "strides")
    while not (open_ := state.where("far IS NOT NULL")).isEmpty():
        up = state.select(*_GROUP, F.col("name").alias("far"), F.col("far").alias("far2"), F.col("chain").alias("chain2"))
        sent = open_.groupBy(*_GROUP, F.col("far").alias("name")).agg(F.sum("size").alias("sent"))
        after = state.join(up, [*_GROUP, "far"], "left").join(sent, [*_GROUP, "name"], "left").select(
            *_GROUP, "name", "parent", F.col("far2").alias("far"),
            F.when(F.col("chain2").isNull(), F.col("chain")).otherwise(F.concat("chain2", "chain")).alias("chain"),
            (F.col("size") + F.coalesce("sent", F.lit(0))).alias("size"),
        )
        state = written(after, "strides", instead_of=state)
    return state.drop("far")


def _strided(nodes: DataFrame) -> DataFrame:
    """Hierarchies of large groups, with chain: the names from the root to the node."""
    nodes = nodes.select(*[F.coalesce(c, F.lit("\x00")).alias(c) for c in (*_GROUP, "name")], "parent")
    exists = nodes.select(*_GROUP, F.col("name").alias("parent"), F.lit(True).alias("known"))
    linked = nodes.join(exists, [*_GROUP, "parent"], "left").select(*_GROUP, "name", F.when(F.col("known"), F.col("parent")).alias("parent"))
    told = _told(linked)
    cyclic = told.where("far IS NOT NULL")
    low_of = cyclic.select(*_GROUP, F.col("name").alias("far"), F.col("low").alias("cycle_head"))
    heads = cyclic.join(low_of, [*_GROUP, "far"]).select(*_GROUP, "name", "parent", "cycle_head")
    trees_ = _gathered(told.where("far IS NULL").select(*_GROUP, "name", "parent"))
    out = trees_.withColumn("cycle_head", F.lit(None).cast("string")).unionByName(heads, allowMissingColumns=True)
    return out.select(*[F.when(F.col(c) != "\x00", F.col(c)).alias(c) for c in (*_GROUP, "name")], "parent", "chain", "size", "cycle_head")


def _chain_pairs(chained: DataFrame) -> DataFrame:
    above = F.slice("chain", F.lit(1), F.size("chain") - 1)
    return chained.where(F.col("chain").isNotNull()).select("tenant", "def_name", F.explode(above).alias("ancestor"), "name")


def _from_chains(chained: DataFrame) -> DataFrame:
    free = F.col("chain").isNotNull()
    return chained.select(
        *_GROUP, "name", "parent", F.when(free, F.array_join("chain", "/")).alias("path"), F.when(free, F.size("chain") - 1).alias("depth"),
        F.when(free, F.get("chain", F.lit(0))).alias("root"), F.when(free, F.col("size") - 1).alias("n_descendants"),
        F.lit(None).cast("array<string>").alias("descendants"), "cycle_head",
    )


def _parts(rows: DataFrame, max_group: int, listed: bool) -> tuple[DataFrame, DataFrame | None]:
    """Peeled hierarchies of the groups up to max_group, and chains of the larger ones if there are any."""
    per_task = NODES_PER_TASK_LISTED if listed else NODES_PER_TASK
    nodes = cut_lineage(current_nodes(rows))
    by_group = nodes.groupBy("tenant", "def_name").agg(F.count("*").alias("n"))
    total, largest = by_group.agg(F.sum("n"), F.max("n")).first()
    small, chained = nodes, None
    if largest is not None and largest > max_group:
        large = by_group.where(F.col("n") > max_group).select(F.col("tenant").alias("t"), F.col("def_name").alias("g"))
        same = nodes["tenant"].eqNullSafe(large["t"]) & nodes["def_name"].eqNullSafe(large["g"])
        small = nodes.join(large, same, "left_anti")
        chained = _strided(written(nodes.join(large, same, "left_semi"), "large"))
    bucket = F.pmod(F.xxhash64("tenant", "def_name"), F.lit(buckets_for(total or 0, per_task)))
    return small.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda pdf: trees(pdf, listed), _TREE), chained


def hierarchies(rows: DataFrame, max_group: int = MAX_GROUP, listed: bool = False) -> DataFrame:
    """One row a node: parent, path (names joined by '/'), depth, root, n_descendants, descendants, cycle_head.

    descendants is null unless listed, and for groups of more than max_group nodes; descendant_pairs has them all.
    """
    peeled, chained = _parts(rows, max_group, listed)
    return peeled if chained is None else peeled.unionByName(_from_chains(chained))


def descendant_pairs(rows: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(tenant, def_name, ancestor, name): each node of a tree with each of its ancestors, whatever the group's
    size."""
    peeled, chained = _parts(rows, max_group, True)
    pairs = peeled.select("tenant", "def_name", F.col("name").alias("ancestor"), F.explode("descendants").alias("name"))
    return pairs if chained is None else pairs.unionByName(_chain_pairs(chained))


def cyclic_nodes(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("cycle_head").isNotNull()).select("tenant", "def_name", "name", "cycle_head")
