import pytest
from pyspark.sql import functions as F

from weftline import session
from weftline.operators.relational import latest_per_key, numbered
from weftline.session import shared_folder


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class sparkContext:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class conf:
        get = staticmethod(lambda key, default=None: default)


def test_a_cluster_needs_a_shared_folder():
    class Frame:
        sparkSession = Elsewhere

    with pytest.raises(ValueError):
        session.cut_lineage(Frame)
    with pytest.raises(ValueError):
        shared_folder(Elsewhere, "x")


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert session.cut_lineage(spark.range(3)).count() == 3


def test_buckets_follow_the_rows():
    assert [session.buckets_for(n, 100, 2) for n in (0, 100, 250, 10**9)] == [2, 2, 3, 10**7]


def test_latest_row_of_each_key(spark, rows):
    df = spark.createDataFrame([("a", 1, "x", {"k": "1"}), ("a", 2, "y", {"k": "2"}), ("a", 2, "z", None), (None, None, "n", {})], "id STRING, at INT, v STRING, m MAP<STRING,STRING>")
    assert rows(latest_per_key(df, ["id"], ["at"], ["id", "v"])) == [(None, "n"), ("a", "z")]
    assert rows(latest_per_key(df, ["id"], ["at"])) == [(None, None, "n", {}), ("a", 2, "z", None)]


def test_numbers_within_hot_and_null_keys(spark):
    df = spark.range(500).select(F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 < 4, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = {}
    for r in numbered(df, "k", ["id"], "n").orderBy("id").collect():
        got.setdefault(r.k, []).append(r.n)
    assert all(v == list(range(1, len(v) + 1)) for v in got.values()) and len(got["hot"]) == 300
