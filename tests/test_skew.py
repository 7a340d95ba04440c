import random
from itertools import groupby

from weftline.operators.skew import heavy_keys, merge, per_key_profile

SCHEMA = "id STRING, tenant STRING, def_name STRING, status STRING, created_at_ms BIGINT, pid INT, n INT, marked STRING"


def brute(data, column):
    out = {}
    for key in {r[column] for r in data}:
        own = sorted((r for r in data if r[column] == key), key=lambda r: (r[4] is not None, r[4] or 0, r[0], r[3]))
        times = [r[4] for r in own if r[4] is not None]
        streak = max((len(list(g)) for failed, g in groupby(own, lambda r: r[3] == "failed") if failed), default=0)
        out[key] = (len(own), min(times, default=None), max(times, default=None), max((b - a for a, b in zip(times, times[1:])), default=None), streak)
    return out


def test_profile_of_skewed_keys(spark):
    pick = random.Random(1)
    data = [(f"r{i:05}", "hot" if i % 3 else pick.choice(["a", "b", None]), f"d{pick.randrange(30)}", "failed" if pick.random() < 0.7 else "ok", pick.choice([None, *range(50)]) if i % 50 == 0 else pick.randrange(10**6)) for i in range(9000)]
    data += data[:20]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in data], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        got = per_key_profile(df, ["tenant", "def_name"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for column, place in (("tenant", 1), ("def_name", 2)):
        assert {r.key_value: tuple(r)[2:] for r in got if r.key_column == column} == brute(data, place)
    heavy = {tuple(r) for r in heavy_keys(per_key_profile(df, ["tenant", "def_name"])).collect()}
    assert heavy == {("tenant", x) for x in ("hot", "a", "b")}


def test_threshold_null_and_empty(spark):
    data = [(str(i), None if i < 10 else "x" if i == 10 else f"k{i}", "d", "ok", i) for i in range(25)]
    profile = per_key_profile(spark.createDataFrame([(*r, 1, 2, "x") for r in data], SCHEMA), ["tenant"])
    assert heavy_keys(profile).count() == 15  # one of 25 rows is enough, null is no value
    assert heavy_keys(per_key_profile(spark.createDataFrame([], SCHEMA), ["tenant", "def_name"])).count() == 0


def test_states_merge_like_one_stretch():
    a, b = (3, 1, 9, 5, 0, 2, 2), (2, 11, 12, 1, 2, 2, 2)
    assert merge(a, b) == (5, 1, 12, 5, 0, 4, 4)
    assert merge((1, None, None, None, 1, 1, 1), b) == (3, 11, 12, 1, 3, 3, 3)
