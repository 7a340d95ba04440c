"""References to records that do not exist.

All keys, of parents and of references, are put into one sorted order by range partitioning and numbered there, so
that parent keys become sorted integers; neighbouring parents form contiguous runs (start, end). A reference is
matched as of the run that starts at or before it and is missing if its number lies beyond that run's end. Before
that, references are reduced to one row a key (with its earliest loading), hence a key that a third of all rows refer
to is one row a task. Only keys with a problem return to the rows that carry them, the few heavy ones by broadcast.

Defined results: a null in any part of the key is no reference (and, in a parent, no parent); an empty text is a key
like any other. Rows of the same referring id count once for each key they carry. A parent is deleted if any of its
rows has the deletion set, and its first loading is the earliest of its rows; a null loading time is never late.
Kinds, the first that holds: missing, deleted, late. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.functions.columns import packed_key
from weftline.session import cut_lineage, shuffle_partitions, table


def parent_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the contiguous runs in sorted distinct integers."""
    if len(codes) == 0:
        return codes, codes
    breaks = np.flatnonzero(np.diff(codes) > 1)
    return codes[np.r_[0, breaks + 1]], codes[np.r_[breaks, len(codes) - 1]]


def beyond_runs(references: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each reference that lies in no run: as-of match to the preceding start, then compare with the end."""
    at = np.searchsorted(starts, references, side="right") - 1
    if len(starts) == 0:
        return np.ones(len(references), dtype=bool)
    return (at < 0) | (references > ends[np.maximum(at, 0)])


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, of each key at most one parent row, which comes first, and one reference row."""
    next_code, last_key, last_parent = 0, None, None
    for rows in batches:
        if not len(rows):
            continue
        keys = rows["key"].to_numpy()
        fresh = np.r_[keys[0] != last_key or last_key is None, keys[1:] != keys[:-1]]
        codes = next_code - 1 + np.cumsum(fresh)
        is_parent = rows["is_parent"].to_numpy(dtype=bool)
        parents, parent_rows = codes[is_parent], rows[is_parent]
        if last_parent is not None and codes[0] == last_parent[0]:
            parents = np.r_[last_parent[0], parents]
            parent_rows = pd.concat([last_parent[1], parent_rows])
        references = rows[~is_parent]
        reference_codes = codes[~is_parent]
        missing = beyond_runs(reference_codes, *parent_runs(parents))
        found = np.searchsorted(parents, reference_codes[~missing])
        target = parent_rows.iloc[found]
        deleted = target["deleted"].to_numpy(dtype=bool)
        first = target["loaded_us"].to_numpy(dtype=float, na_value=np.nan)
        late = first > references["loaded_us"][~missing].to_numpy(dtype=float, na_value=np.nan)
        bad = references[~missing].assign(
            orphan_kind=np.where(deleted, "deleted", np.where(late, "late", "")), target_us=target["loaded_us"].to_numpy()
        )
        found = pd.concat([references[missing].assign(orphan_kind="missing", target_us=pd.NA), bad[bad["orphan_kind"] != ""]])
        if len(found):
            yield found[["key", "orphan_kind", "target_us", "n"]].astype({"target_us": "Int64", "n": "int64"})
        next_code, last_key = int(codes[-1]) + 1, keys[-1]
        last_parent = (int(parents[-1]), parent_rows.iloc[[-1]]) if len(parents) else None


def problem_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """(key, orphan_kind, target_us, n) of each referenced key that is missing, deleted, or late for some reference.

    references has (key, loaded_us, n), parents (key, loaded_us, deleted), one row a key each.
    """
    both = references.select("key", "loaded_us", "n", F.lit(False).alias("deleted"), F.lit(False).alias("is_parent")).unionByName(
        parents.select("key", "loaded_us", F.lit(0).cast("bigint").alias("n"), "deleted", F.lit(True).alias("is_parent"))
    )
    ranged = both.repartitionByRange(shuffle_partitions(both.sparkSession), "key").sortWithinPartitions(
        "key", F.desc("is_parent")
    )
    return ranged.mapInPandas(_match, "key STRING, orphan_kind STRING, target_us BIGINT, n BIGINT")


#: A key with at least this part of all references is a hot one; so there are no more of them than this.
HOT_PARTS = 1_000


def find_orphans(references: DataFrame, parents: DataFrame, hot_parts: int = HOT_PARTS) -> DataFrame:
    """(ref_id, key, orphan_kind, loaded_us): references (ref_id, key, loaded_us) whose key has a problem.

    A key that is late for its earliest reference need not be late for others: each is compared again. Problem keys with
    at least 1/hot_parts of all references, at most hot_parts of them, are broadcast; the others meet their references
    in a shuffle in which no key is heavier than that.
    """
    references = cut_lineage(references)
    by_key = cut_lineage(references.groupBy("key").agg(F.min("loaded_us").alias("loaded_us"), F.count("*").alias("n")))
    total = by_key.agg(F.sum("n")).first()[0] or 0
    problems = cut_lineage(problem_keys(by_key, parents))
    is_hot = F.col("n") * hot_parts >= total
    hot, cold = problems.where(is_hot).drop("n"), problems.where(~is_hot).drop("n")
    keys = [r["key"] for r in hot.select("key").collect()]
    if keys:
        hit = references.join(F.broadcast(hot), "key").unionByName(references.where(~F.col("key").isin(keys)).join(cold, "key"))
    else:
        hit = references.join(cold, "key")
    return hit.where((F.col("orphan_kind") != "late") | (F.col("target_us") > F.col("loaded_us"))).drop("target_us")


def referring(rows: DataFrame, ref_id: str, key: Column, loaded: str = "loaded_at") -> DataFrame:
    """(ref_id, key, loaded_us): distinct pairs; loaded_us is the first loading of the referring id."""
    pairs = (
        rows.select(F.col(ref_id).alias("ref_id"), key.alias("key"), _micros(loaded).alias("loaded_us"))
        .repartition("ref_id")
        .groupBy("ref_id", "key")
        .agg(F.min("loaded_us").alias("loaded_us"))
    )
    first = F.min("loaded_us").over(W.Window.partitionBy("ref_id"))
    return pairs.withColumn("loaded_us", first).where(F.col("key").isNotNull())


def targets(rows: DataFrame, key: Column, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """(key, loaded_us, deleted), one row a key."""
    return (
        rows.select(key.alias("key"), _micros(loaded).alias("loaded_us"), F.col(deleted).isNotNull().alias("deleted"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("loaded_us").alias("loaded_us"), F.max("deleted").alias("deleted"))
    )


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def orphans_found(spark, sf_dir: str) -> DataFrame:
    """(ref_table, ref_id, ref_field, orphan_kind, loaded_us) of the project's two references."""
    runs, workflows = table(spark, sf_dir, "runs"), table(spark, sf_dir, "workflows")
    task_refs = referring(table(spark, sf_dir, "task_runs"), "id", F.col("run_id"))
    of_tasks = find_orphans(task_refs, targets(runs, F.col("id"))).select(
        F.lit("task_runs").alias("ref_table"), "ref_id", F.lit("run_id").alias("ref_field"), "orphan_kind", "loaded_us"
    )
    definition = packed_key(F.col("tenant"), F.col("def_name"), F.col("def_version"))
    run_refs = referring(runs.withColumn("_key", definition), "id", F.col("_key"))
    hit = find_orphans(run_refs, targets(workflows, packed_key(F.col("tenant"), F.col("name"), F.col("version"))))
    # A packed key ends in "<length>:<version>"; without that end it is the key of the definition's name.
    version = F.regexp_extract("key", ":(-?[0-9]+)$", 1)
    end = F.length(version) + 1 + F.length(F.length(version).cast("string"))
    name_key = F.substring(F.col("key"), F.lit(1), F.length("key") - end)
    hit = hit.withColumn("name_key", name_key)
    names = workflows.select(packed_key(F.col("tenant"), F.col("name")).alias("key")).where("key is not null").distinct()
    wanted = hit.where("orphan_kind = 'missing'").groupBy(F.col("name_key").alias("key")).agg(F.lit(0).cast("long").alias("loaded_us"), F.count("*").alias("n"))
    nameless = problem_keys(wanted, names.select("key", F.lit(None).cast("long").alias("loaded_us"), F.lit(False).alias("deleted")))
    nameless = nameless.where("orphan_kind = 'missing'").select(F.col("key").alias("name_key"), F.lit(True).alias("no_name"))
    of_runs = hit.join(nameless, "name_key", "left").select(
        F.lit("runs").alias("ref_table"),
        "ref_id",
        F.when(F.col("no_name"), "def_name").otherwise("def_version").alias("ref_field"),
        "orphan_kind",
        "loaded_us",
    )
    return of_tasks.unionByName(of_runs)


def orphan_report(spark, sf_dir: str) -> DataFrame:
    """Number of orphan references per table, field, kind and month in which the referring id was first loaded."""
    found = orphans_found(spark, sf_dir)
    period = F.date_format(F.timestamp_micros("loaded_us"), "yyyy-MM")
    return found.groupBy("ref_table", "ref_field", "orphan_kind", period.alias("period")).agg(F.count("*").alias("n_orphans"))
