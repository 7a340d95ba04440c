import random

import pytest

from weftline.operators.hierarchy import current_nodes, cyclic_nodes, descendant_pairs, hierarchies

SCHEMA = "tenant STRING, def_name STRING, name STRING, depends_on ARRAY<STRING>, updated_at_ms BIGINT, bucket INT, parent STRING, path STRING"


def table(spark, data):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in data], SCHEMA)


def brute(parents):
    out = {}
    for node in parents:
        chain, at = [node], parents[node]
        while at is not None and at not in chain:
            chain.append(at)
            at = parents[at]
        if at is None:
            out[node] = ("/".join(chain[::-1]), len(chain) - 1, chain[-1], None)
        else:
            out[node] = (None, None, None, min(chain[chain.index(at) :]))
    return out


def random_parents(seed, n):
    pick = random.Random(seed)
    names = [f"n{i:03}" for i in range(n)]
    return {x: pick.choice([None, *names[: i + 1 + (pick.random() < 0.05)]]) if pick.random() < 0.9 else names[max(i - 1, 0)] for i, x in enumerate(names)}


@pytest.mark.parametrize("max_group", [1000, 3])
def test_against_walking_up(spark, max_group):
    data, want = [], {}
    for g in range(4):
        parents = random_parents(g, 40 if g else 2)
        data += [("t", f"g{g}", n, [p] if p else None, 1) for n, p in parents.items()]
        want |= {(f"g{g}", n): v for n, v in brute(parents).items()}
    # A chain deeper than any recursion limit.
    data += [("t", "deep", f"d{i}", [f"d{i - 1}"], 1) for i in range(160)]
    got = hierarchies(table(spark, data), max_group).collect()
    assert {(r.def_name, r.name): (r.path, r.depth, r.root, r.cycle_head) for r in got if r.def_name != "deep"} == want
    assert max(r.depth for r in got if r.def_name == "deep") == 159
    below = {(r.def_name, r.ancestor, r.name) for r in descendant_pairs(table(spark, data), max_group).collect()}
    assert below == {(r.def_name, a, r.name) for r in got if r.path for a in r.path.split("/")[:-1]}
    for r in got:
        assert r.n_descendants == (None if r.cycle_head else sum(1 for p in below if p[:2] == (r.def_name, r.name)))


def test_dirty_rows(spark):
    data = [
        ("t", "g", "a", None, 1), ("t", "g", "b", [], 1), ("t", "g", "c", [""], 1), ("t", "g", "d", [None, "", "a", "b"], 1), ("t", "g", "e", ["missing"], 1),
        ("t", "g", "f", ["f"], 1), ("t", "g", "f", ["a"], 2), ("t", "g", "a", None, 1), ("u", "g", "a", ["a"], 1), ("u", "g", "x", ["a"], 1),
        (None, None, "a", None, None), (None, None, "b", ["a"], None), ("t", "g", None, ["a"], 1), ("t", "g", "A", ["a "], 1),
    ]
    tree = {(r.tenant, r.name): r for r in hierarchies(table(spark, data)).collect()}
    assert tree["t", "d"].path == "a/d" and tree["t", "f"].path == "a/f" and tree["t", "e"].depth == 0 and tree["t", "A"].depth == 0
    listed = {(r.tenant, r.name): r.descendants for r in hierarchies(table(spark, data), listed=True).collect()}
    assert listed["t", "a"] == [None, "d", "f"] and listed["u", "a"] is None
    assert tree["t", "a"].n_descendants == 3 and tree[None, "b"].path == "a/b" and tree["t", None].root == "a"
    assert {(r.name, r.cycle_head) for r in cyclic_nodes(hierarchies(table(spark, data))).collect()} == {("a", "a"), ("x", "a")}
    assert hierarchies(table(spark, [])).count() == 0
    assert current_nodes(table(spark, [("t", "g", "a", ["x"], 1), ("t", "g", "a", ["y"], 1)])).first().parent == "y"
