import itertools
import random

import pytest

from weftline.llm import mixing
from weftline.llm.mixing import mix, plan, route


def test_first_uses_come_before_second_ones():
    a, b, ab = frozenset("a"), frozenset("b"), frozenset("ab")
    got = route({a: 10, b: 100, ab: 50}, {"a": 3, "b": 1}, {"a": 60, "b": 90})
    assert got[b, "b"] == 90 and got[a, "a"] == 10 and got[ab, "a"] == 50


@pytest.mark.parametrize("seed", range(6))
def test_routes_are_whole_and_within_bounds(seed):
    pick = random.Random(seed)
    names = "abcd"
    keys = [frozenset(c) for n in (1, 2, 3) for c in itertools.combinations(names, n) if pick.random() < 0.6]
    patterns = {k: pick.randrange(1, 1000) for k in keys}
    repeats = {s: pick.randrange(1, 5) for s in names}
    weights = {s: pick.random() for s in names}
    got, taking, asked = plan(patterns, weights, repeats)
    assert taking == {s for k in keys for s in k}
    total = sum(got.values())
    for (key, s), tokens in got.items():
        assert s in key and 0 < tokens <= patterns[key] * repeats[s]
    alive = {s for k in keys for s in k}
    whole = sum(weights[s] for s in alive)
    for s in alive:
        assert abs(sum(v for (_, x), v in got.items() if x == s) - total * weights[s] / whole) <= len(names) + 1


@pytest.mark.parametrize("seed", range(8))
def test_the_mix_is_the_largest(seed):
    pick = random.Random(seed)
    patterns = {frozenset(pick.sample("abcde", pick.choice([1, 1, 2, 3]))): pick.randrange(1, 5000) for _ in range(8)}
    repeats, weights = {s: pick.randrange(1, 6) for s in "abcde"}, {s: pick.random() + 0.01 for s in "abcde"}
    _, alive, asked = plan(patterns, weights, repeats)
    total, whole = sum(asked.values()), sum(weights[s] for s in alive)

    def fits(size):
        wanted = {s: int(size * weights[s] / whole) for s in alive}
        return sum(route(patterns, repeats, wanted).values()) == sum(wanted.values())

    assert fits(total) and not fits(total * 1.001 + 30)


def test_many_repetitions_are_one_arc():
    got = route({frozenset("a"): 3, frozenset("ab"): 2}, {"a": 10**6, "b": 1}, {"a": 1000, "b": 2})
    # Neither pattern is used much more often than the other.
    assert got[frozenset("ab"), "b"] == 2 and abs(got[frozenset("a"), "a"] / 3 - (got[frozenset("ab"), "a"] + 2) / 2) <= 1


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id BIGINT, text STRING, source STRING, pattern STRING, copies INT")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source STRING, weight DOUBLE, max_repeats INT")


def test_mix_of_uneven_sources(spark):
    pick = random.Random(4)
    rows = [(i, "word " * pick.randrange(1, 9), "big") for i in range(3000)] + [(5000 + i, "word " * pick.randrange(1, 9), "small") for i in range(60)]
    rows += [(9000, None, "big"), (9001, "", "small"), (9002, "x", None), (9003, "x", "other")]
    chosen, report = mix(documents(spark, rows), targets(spark, [("big", 0.6, 1), ("small", 0.3, 4), ("none", 0.1, 2), (None, 0.5, 1)]))
    by = {r.source: r for r in report.collect()}
    assert set(by) == {"big", "small", "none"} and by["none"].tokens == 0
    assert by["small"].most_copies == 4 and by["small"].n_documents == 60
    assert abs(by["big"].share - 0.6 / 0.9) < 0.005 and abs(by["small"].share - 0.3 / 0.9) < 0.005
    assert by["big"].most_copies == 1
    used = chosen.collect()
    assert len({r.doc_id for r in used}) == len(used) and all(r.copies >= 1 for r in used)
    again, _ = mix(documents(spark, rows), targets(spark, [("big", 0.6, 1), ("small", 0.3, 4), ("none", 0.1, 2), (None, 0.5, 1)]))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in used}
    other, _ = mix(documents(spark, rows), targets(spark, [("big", 0.6, 1), ("small", 0.3, 4)]), seed=18)
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in used}


def test_overlapping_sources(spark):
    rows = [(i, "one two three", ["a"] if i < 100 else ["a", "b"] if i < 200 else ["b", "a", None]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source ARRAY<STRING>")
    chosen, report = mix(df, targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)]))
    by = {r.source: r.share for r in report.collect()}
    assert abs(by["a"] - 0.5) < 0.01 and {r.source for r in chosen.where("doc_id < 100").collect()} == {"a"}


def test_more_patterns_than_are_planned_with(spark):
    rows = [(i, "one two three", ["a", "b", "c"][: 1 + i % 3] if i % 2 else ["c"]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source ARRAY<STRING>")
    chosen, report = mix(df, targets(spark, [("a", 0.4, 1), ("b", 0.3, 1), ("c", 0.3, 1)]), most_patterns=2)
    assert all(abs(r.share - r.weight) < 0.02 and r.tokens > 0 for r in report.collect())
    assert chosen.groupBy("doc_id").count().where("count > 1").count() == 0


def test_thousands_of_patterns_are_planned_with(spark):
    names = "abcdefghijklm"
    sets = [list(c) for n in range(1, 14) for c in itertools.combinations(names, n)]
    df = spark.createDataFrame([(i, "one two three", s) for i, s in enumerate(sets)], "doc_id BIGINT, text STRING, source ARRAY<STRING>")
    goals = targets(spark, [(s, 1.0, 1) for s in names])
    # Every source can have all of its 4,096 documents; if the total is less, no document is used twice.
    _, report = mix(df, goals)
    assert {(r.source, r.n_documents, r.tokens) for r in report.collect()} == {(s, 4096, 3 * 4096) for s in names}
    chosen, report = mix(df, goals, total=3 * len(sets))
    assert {(r.source, r.n_documents, r.tokens) for r in report.collect()} == {(s, 630, 1890) for s in names}
    assert chosen.select("doc_id").distinct().count() == 13 * 630


def test_more_documents_elsewhere_do_not_change_the_order(spark, monkeypatch):
    pick = random.Random(5)
    rows = [(i, "word " * pick.randrange(1, 9), "a" if i % 2 else "b") for i in range(400)]
    mixed = lambda: {tuple(r) for r in mix(documents(spark, rows), targets(spark, [("a", 0.7, 1), ("b", 0.3, 1)]))[0].collect()}
    first = mixed()
    monkeypatch.setattr(mixing, "LEAST_BUCKETS", 7)
    assert mixed() == first
    monkeypatch.setattr(mixing, "DOCUMENTS_PER_BUCKET", 1)
    assert mixed() == first


def test_sources_that_take_nothing_part_no_patterns(spark):
    rows = [(i, "one two three" + " four" * (i == 0), ["a", "none"] if i % 3 else ["none", "a", "b"]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source ARRAY<STRING>")
    _, report = mix(df, targets(spark, [("a", 0.5, 1), ("b", 0.5, 1), ("none", 0.0, 1)]))
    by = {r.source: r for r in report.collect()}
    assert by["none"].tokens == 0 and by["none"].longest == 4 and by["a"].longest == 4 and by["a"].asked == by["b"].asked == 301


def test_asked_total_leaves_small_sources_short(spark):
    rows = [(i, "word " * 5, "big" if i < 900 else "small") for i in range(1000)]
    _, report = mix(documents(spark, rows), targets(spark, [("big", 0.5, 1), ("small", 0.5, 2)]), total=8000)
    by = {r.source: r for r in report.collect()}
    assert by["small"].most_copies == 2 and by["big"].tokens > 3900 and by["small"].tokens < 1300


def test_empty_tables(spark):
    for d, t in (([], [("a", 1.0, 1)]), ([(1, "x", "a")], []), ([(1, "x", "a")], [("a", None, None)])):
        chosen, report = mix(documents(spark, d), targets(spark, t))
        assert chosen.count() == 0 and report.count() == len(t)
