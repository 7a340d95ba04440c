import random

from weftline.operators.intervals import compose_boundaries, periods_and_gaps

SCHEMA = "run_id STRING, s BIGINT, e BIGINT, entity STRING, pid INT"


def run(spark, data, rows):
    return rows(periods_and_gaps(spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA), "run_id", "s", "e"))


def brute(data):
    out = []
    for key in sorted({r for r, s, e in data if r}):
        merged = []
        for s, e in sorted((s, e) for r, s, e in data if r == key and s is not None and e is not None and e > s):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(key, "period", *m) for m in merged] + [(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=lambda r: tuple((True, str(x)) for x in r))


def test_dirty_intervals(spark, rows):
    data = [("a", 1, 5), ("a", 5, 6), ("a", 2, 3), ("a", 9, 9), ("a", 8, 7), ("a", 10, 12), ("a", 10, 11), ("", 1, 2), (None, 1, 2), ("b", None, 3), ("b", 3, None), ("c", 1, 2), ("c", 1, 2)]
    assert run(spark, data, rows) == brute(data)
    assert run(spark, [], rows) == []


def test_a_hot_entity_is_split_and_stitched(spark, rows):
    pick = random.Random(3)
    data = [("hot", s := pick.randrange(200_000), s + pick.choice([3, 40, 3000 if pick.random() < 0.01 else 5])) for _ in range(6000)]
    data += [("hot", 50_000, 120_000)] + [(f"k{i % 300}", s := pick.randrange(1000), s + pick.randrange(1, 90)) for i in range(6000)]
    assert run(spark, data, rows) == brute(data)


def test_boundary_states():
    edges = [(0, "a", 1, 2, True, False), (0, "b", 5, 100, False, True), (1, "b", 50, 60, True, False), (1, "b", 70, 80, False, True), (2, "b", 90, 200, True, True), (3, "b", 300, 301, True, True), (4, "c", 1, 2, True, True)]
    assert compose_boundaries(edges) == [(1, "b", 5, 100), (2, "b", 5, 100), (3, "b", 5, 200)]
