import datetime as dt

import numpy as np

from weftline.operators.orphans import beyond_runs, find_orphans, orphan_report, orphans_found, parent_runs


def test_runs_and_as_of_match():
    starts, ends = parent_runs(np.array([2, 3, 4, 7, 9, 10]))
    assert starts.tolist() == [2, 7, 9] and ends.tolist() == [4, 7, 10]
    assert beyond_runs(np.array([1, 2, 4, 5, 7, 8, 10, 11]), starts, ends).tolist() == [True, False, False, True, False, True, False, True]
    empty = np.array([], dtype=int)
    assert beyond_runs(np.array([1]), *parent_runs(empty)).tolist() == [True]


def test_kinds_and_hot_key(spark, rows):
    refs = spark.createDataFrame([("a", "k1", 10), ("b", "k2", 10), ("c", "k3", 10), ("d", "k3", 30), ("e", "", 10), ("f", "k4", None)], "ref_id STRING, key STRING, loaded_us BIGINT")
    refs = refs.unionByName(spark.range(500).selectExpr("concat('h', id) AS ref_id", "'hot' AS key", "id AS loaded_us"))
    parents = spark.createDataFrame([("k1", 5, False), ("k2", 20, True), ("k3", 20, False), ("k4", 5, False), ("zz", 1, False)], "key STRING, loaded_us BIGINT, deleted BOOLEAN")
    found = find_orphans(refs, parents)
    assert rows(found.where("key <> 'hot'").select("ref_id", "orphan_kind")) == [("b", "deleted"), ("c", "late"), ("e", "missing")]
    assert found.where("key = 'hot' AND orphan_kind = 'missing'").count() == 500


def write(spark, folder, runs, tasks, workflows):
    at = lambda day: dt.datetime(2027, 1, day)
    opt = lambda x: None if x is None else at(x)
    spark.createDataFrame([(i, t, n, v, opt(x), opt(y), "z") for i, t, n, v, x, y in runs], "id STRING, tenant STRING, def_name STRING, def_version INT, loaded_at TIMESTAMP_NTZ, deleted_at TIMESTAMP_NTZ, key STRING").write.parquet(f"{folder}/runs.parquet")
    spark.createDataFrame([(i, r, opt(x), 1) for i, r, x in tasks], "id STRING, run_id STRING, loaded_at TIMESTAMP_NTZ, loaded_us INT").write.parquet(f"{folder}/task_runs.parquet")
    spark.createDataFrame([(t, n, v, opt(x), opt(y)) for t, n, v, x, y in workflows], "tenant STRING, name STRING, version INT, loaded_at TIMESTAMP_NTZ, deleted_at TIMESTAMP_NTZ").write.parquet(f"{folder}/workflows.parquet")


def test_the_tables_of_the_project(spark, rows, tmp_path):
    write(spark, tmp_path, [("r1", "t", "w5", 1, 2, None), ("r1", "t", "w5", 1, 9, None), ("r2", "t", "w", 51, 2, 3), ("r3", "t", "gone", 1, 2, None), ("r4", "t", None, 1, 2, None), ("r5", "t", "w", 2, None, None)],
          [("a", "r1", 1), ("a", "r1", 8), ("b", "r2", 9), ("c", "", 1), ("d", None, 1), ("e", "R1", 1), ("f", "r1", 5)],
          [("t", "w5", 1, 1, None), ("t", "w", 2, 1, 4), ("t", "w", 3, 1, None), (None, "gone", 1, 1, None)])
    assert rows(orphans_found(spark, str(tmp_path)).drop("loaded_us")) == [
        ("runs", "r2", "def_version", "missing"), ("runs", "r3", "def_name", "missing"), ("runs", "r5", "def_version", "deleted"),
        ("task_runs", "a", "run_id", "late"), ("task_runs", "b", "run_id", "deleted"), ("task_runs", "c", "run_id", "missing"), ("task_runs", "e", "run_id", "missing"),
    ]
    assert orphan_report(spark, str(tmp_path)).agg({"n_orphans": "sum"}).first()[0] == 7


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert orphans_found(spark, str(tmp_path)).count() == 0
