import random

import numpy as np
import pytest

from weftline.operators import delivery
from weftline.operators.delivery import SeenState, deduplicate_batch, kept_rows, packed, repeated_rows, take_unseen, unpacked

SCHEMA = "seq BIGINT, id STRING, run_id STRING, kind STRING, key STRING, shard INT"
A = "ab" * 32


def events(spark, data):
    return spark.createDataFrame([(*r, "x", 7) for r in data], SCHEMA)


def test_same_message_however_it_is_written(spark, rows):
    df = events(spark, [
        (5, A, "r1", "run.started"), (1, f" {A.upper()}\n", "r1", "RUN.STARTED"), (2, None, "r1", "run.started"), (3, " ", "r1", "run.started"),
        (4, "other id", "r2", "run.failed"), (9, "Other ID ", "r2", "run.failed"), (6, None, "r3", "run.failed"), (8, "", "r3", "run.failed"),
        (7, None, "r3", "run.started"), (10, None, None, None), (11, None, None, None),
    ])
    assert rows(repeated_rows(df)) == [(11,), (2,), (3,), (5,), (8,), (9,)]
    assert sorted(r["seq"] for r in kept_rows(df).collect()) == [1, 4, 6, 7, 10]


def test_empty_table_and_hot_identifier(spark):
    assert repeated_rows(events(spark, [])).count() == 0
    hot = spark.range(3000).selectExpr("id AS seq", "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS id", "'r' AS run_id", "'k' AS kind")
    assert repeated_rows(hot).count() == 999


def test_row_without_id_takes_the_known_one(spark, rows):
    df = events(spark, [(1, None, "r", "k"), (2, "m", "r", "k"), (3, "m", "r", "k")])
    assert rows(repeated_rows(df)) == [(2,), (3,)]


def test_bitmap_step_is_exact():
    seen = np.zeros(delivery.CONTAINER, dtype=bool)
    assert take_unseen(np.array([4, 9, 4]), seen).tolist() == [True, True, False]
    seen[[4, 9]] = True
    # Bit 4 is set; bits 2 and 65535 are not, whatever the dictionary has.
    assert take_unseen(np.array([9, 2, 2, 4, 65535]), unpacked([packed(seen)])).tolist() == [False, True, False, False, True]
    other = np.zeros(delivery.CONTAINER, dtype=bool)
    other[2] = True
    assert np.flatnonzero(unpacked([packed(seen), packed(other)])).tolist() == [2, 4, 9]
    assert not unpacked([]).any()


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_batches_against_a_committed_state(spark, tmp_path):
    state = SeenState(str(tmp_path / "seen"))
    first = events(spark, [(1, "a", "r1", "k"), (2, "b", "r2", "k"), (3, "a", "r1", "k")])
    second = events(spark, [(4, "A ", "r1", "k"), (5, "c", "r3", "k"), (6, "c", "r3", "k")])
    assert seqs(deduplicate_batch(first, state)) == [1, 2]
    assert seqs(deduplicate_batch(second, state)) == [5]
    assert deduplicate_batch(first, state).count() == 0
    assert deduplicate_batch(events(spark, []), state).count() == 0
    # The dictionary and the bits of each of four batches.
    assert state.manifest(spark)["version"] == 8


def test_a_batch_that_is_run_again_gives_the_same_rows(spark, tmp_path):
    state = SeenState(str(tmp_path / "seen"))
    first = events(spark, [(1, "a", "r1", "k"), (2, "b", "r2", "k"), (3, "a", "r1", "k")])
    assert seqs(deduplicate_batch(first, state, "monday")) == [1, 2]
    # Its result was lost before it was written.
    assert seqs(deduplicate_batch(first, state, "monday")) == [1, 2]
    assert seqs(deduplicate_batch(first, state, "tuesday")) == []
    assert seqs(deduplicate_batch(first, state, "monday")) == [1, 2]
    assert state.manifest(spark)["version"] == 4


def test_a_batch_that_died_between_dictionary_and_bits(spark, tmp_path, monkeypatch):
    state, data = SeenState(str(tmp_path / "seen")), events(spark, [(1, "a", "r1", "k"), (2, "b", "r2", "k")])

    def dies(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(SeenState, "unite", dies)
        with pytest.raises(RuntimeError):
            deduplicate_batch(data, state, "x")
    # Its identifiers have codes now, but no bits.
    assert state.keys(spark, state.manifest(spark)).count() == 2 and state.seen(spark, state.manifest(spark)).count() == 0
    assert seqs(deduplicate_batch(events(spark, [(3, "b", "r2", "k")]), state, "y")) == [3]
    assert seqs(deduplicate_batch(data, state, "x")) == [1]
    assert state.keys(spark, state.manifest(spark)).count() == 2


def test_two_committers(spark, tmp_path, monkeypatch):
    """A batch is committed by another writer while this one is between its steps, in either of them."""
    real = SeenState.commit
    for turn in range(2):
        state, left = SeenState(str(tmp_path / f"seen{turn}")), [turn]

        def slow(self, spark_, found, **changes):
            if left and left[0] == 0:
                left.clear()
                assert seqs(deduplicate_batch(events(spark, [(1, "a", "r1", "k"), (2, "b", "r2", "k")]), state, "other")) == [1, 2]
            elif left:
                left[0] -= 1
            return real(self, spark_, found, **changes)

        with monkeypatch.context() as m:
            m.setattr(SeenState, "commit", slow)
            assert seqs(deduplicate_batch(events(spark, [(3, "a", "r1", "k"), (4, "c", "r3", "k")]), state, "mine")) == [4]
        keys = [bytes(r.key) for r in state.keys(spark, state.manifest(spark)).collect()]
        assert len(keys) == len(set(keys)) == 3
        with pytest.raises(delivery.Behind):
            state.commit(spark, state.manifest(spark, 1))


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_many_batches_are_one_batch(spark, tmp_path, monkeypatch, most):
    """Whether batches are broadcast to the dictionary or not."""
    monkeypatch.setattr(delivery, "MOST_PARTS", 2)
    monkeypatch.setattr(delivery, "BROADCAST_BYTES", most)
    state, pick, kept, rows = SeenState(str(tmp_path / "seen")), random.Random(7), [], []
    for batch in range(5):
        # Each pair of run_id and kind has one identifier, which about half of its rows lack.
        pairs = [pick.randrange(12) for _ in range(10)]
        new = [(10 * batch + i, pick.choice([None, f"m{p}"]), f"r{p}", "k") for i, p in enumerate(pairs)]
        rows += new
        kept += seqs(deduplicate_batch(events(spark, new), state))
    assert sorted(kept) == seqs(kept_rows(events(spark, rows)))
    found = state.manifest(spark)
    assert all(len(found[kind]) <= 2 for kind in ("keys", "names", "seen"))
    keys = [bytes(r.key) for r in state.keys(spark, found).collect()]
    assert len(keys) == len(set(keys))
    bits = {(r.part, r.container): int(unpacked([bytes(r.bits)]).sum()) for r in state.seen(spark, found).groupBy("part", "container").applyInPandas(delivery._united, delivery.TAKEN_SCHEMA).collect()}
    assert sum(bits.values()) == len(keys)


def test_whole_table_in_any_number_of_batches(spark):
    pick = random.Random(3)
    pairs = [pick.randrange(40) for _ in range(200)]
    df = events(spark, [(i, pick.choice([None, " ", f"M{p}", f"m{p}"]), f"r{p}", "k") for i, p in enumerate(pairs)])
    want = sorted(pairs.index(p) for p in set(pairs))
    for batches in (1, 2, 5):
        assert seqs(delivery.select_all(df, batches)[0]) == want


def test_null_and_repeated_seq(spark, rows):
    df = events(spark, [(1, "a", "r", "k"), (1, "a", "r", "k"), (2, "a", "r", "k"), (2, "a", "r", "k"), (None, "a", "r", "k"), (None, "b", "s", "k"), (None, "B", "s", "k"), (None, None, "t", "k"), (None, "", "t", "K")])
    assert rows(repeated_rows(df)) == [(2,)]
    got = [(r.seq, r.run_id) for r in kept_rows(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "r"), (None, "s"), (None, "t")], key=str)


def test_rows_without_id_are_resolved_over_batches(spark, tmp_path):
    for turn, per_pair in enumerate((1, 3)):
        state, pick, kept, data = SeenState(str(tmp_path / f"seen{turn}")), random.Random(turn), [], []
        for batch in range(4):
            pairs = [(f"r{pick.randrange(12)}", pick.choice("kl")) for _ in range(8)]
            new = [(10 * batch + i, pick.choice([None, f"{r}{k}{pick.randrange(per_pair)}"]), r, k) for i, (r, k) in enumerate(pairs)]
            data += new
            kept += [r["seq"] for r in deduplicate_batch(events(spark, new), state).collect()]
        want = sorted(r["seq"] for r in kept_rows(events(spark, data)).collect())
        # With one id a pair the copies are the same; with several, a later id may be the smaller one, but each message has one copy.
        assert sorted(kept) == want if per_pair == 1 else len(kept) == len(want)


def test_id_that_comes_after_its_row_was_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delivery, "MOST_PARTS", 2)
    state = SeenState(str(tmp_path / "seen"))
    turns = [[(1, None, "r", "k")], [(2, " ", "r", "K ")], [(3, "b", "r", "k"), (4, "c", "r", "k")], [(5, "B", "r", "k"), (6, None, "r", "k")], [(7, "a", "r", "k"), (8, None, "r", "k")]]
    kept = [sorted(r["seq"] for r in deduplicate_batch(events(spark, new), state).collect()) for new in turns]
    assert kept == [[1], [], [4], [], [7]]


def test_the_bitmap_chooses_among_arrivals_of_several_tasks(spark):
    arrivals = spark.range(0, 4000, 1, 4).selectExpr("CAST(CAST(id % 10 AS STRING) AS BINARY) AS key", "id AS seq")
    # One row a key and task reaches the containers: no aggregate over the whole table decides before them.
    assert delivery.first_of_chunks(arrivals, ["key"]).count() == 40
    dictionary = spark.range(10).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS key", "1 AS part", "id * 70000 AS place")
    seen = np.zeros(delivery.CONTAINER, dtype=bool)
    seen[70000 % delivery.CONTAINER] = True
    before = spark.createDataFrame([(1, 70000 // delivery.CONTAINER, packed(seen))], "part INT, container BIGINT, bits BINARY")
    got = delivery.unseen_arrivals(arrivals, dictionary, before).where("seq IS NOT NULL")
    assert seqs(got) == [0, *range(2, 10)]


def test_large_seq_stay_exact_beside_returned_ones(spark, tmp_path):
    state, big = SeenState(str(tmp_path / "seen")), (1 << 60) + 1
    assert [r.seq for r in deduplicate_batch(events(spark, [(1, None, "r", "k")]), state).collect()] == [1]
    assert [r.seq for r in deduplicate_batch(events(spark, [(big, "a", "r", "k"), (big + 1, "b", "s", "k")]), state).collect()] == [big + 1]
