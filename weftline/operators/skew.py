"""Per-key results although a few keys hold most records.

The rows are range partitioned on (key, secondary order, id); Spark samples that composite key for its quantiles, so a
heavy key falls apart into as many ranges as its weight asks for, and partitions are even whatever the keys' sizes. A
task folds its sorted rows into one partial state per key. Only a key at a boundary has more than one state, and no key
more than there are partitions; they are stitched in partition order.

Defined results: the null key is a key. Rows without the secondary order's time count, but take no part in times and
gaps; ties are ordered by id and then status. Repeated rows count as often as they are stored. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut_lineage, shuffle_partitions

_STATE = (
    "key_column STRING, key_value STRING, pid INT, n BIGINT, first_ms BIGINT, last_ms BIGINT, max_gap BIGINT, "
    "prefix BIGINT, suffix BIGINT, best BIGINT"
)


def merge(a: tuple, b: tuple) -> tuple:
    """State of a key's rows from those of two neighbouring stretches: (n, first, last, max_gap, prefix, suffix, best)."""
    gaps = [g for g in (a[3], b[3], b[1] - a[2] if a[2] is not None and b[1] is not None else None) if g is not None]
    return (
        a[0] + b[0],
        b[1] if a[1] is None else a[1],
        a[2] if b[2] is None else b[2],
        max(gaps, default=None),
        a[4] + b[4] if a[4] == a[0] else a[4],
        a[5] + b[5] if b[5] == b[0] else b[5],
        max(a[6], b[6], a[5] + b[4]),
    )


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One state for each key of a partition, whose rows come sorted; the last key waits for the next batch."""
    held: tuple | None = None  # (pid, column, value, state)
    fields = ["n", "first_ms", "last_ms", "max_gap", "prefix", "suffix", "best"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(c, v, p, *s) for p, c, v, s in rows], columns=["key_column", "key_value", "pid", *fields])
        return out.astype({"first_ms": "Int64", "last_ms": "Int64", "max_gap": "Int64"})

    for rows in batches:
        if not len(rows):
            continue
        column, value = rows["key_column"].to_numpy(), rows["key_value"].to_numpy()
        change = np.r_[True, (column[1:] != column[:-1]) | (value[1:] != value[:-1])]
        at = np.flatnonzero(change)
        sizes = np.diff(np.r_[at, len(rows)])
        group = np.repeat(np.arange(len(at)), sizes)
        known = rows["at_ms"].notna().to_numpy()
        t, g = rows["at_ms"].to_numpy(dtype="int64", na_value=0)[known], group[known]
        keys = pd.RangeIndex(len(at))
        timed = pd.Series(t).groupby(g)
        inner = g[1:] == g[:-1]
        gaps = pd.Series(np.diff(t)[inner]).groupby(g[1:][inner]).max()
        marked = rows["marked"].to_numpy(dtype=bool)
        # Streaks: islands of equal (key, marked).
        starts = np.flatnonzero(change | np.r_[True, marked[1:] != marked[:-1]])
        lengths = np.diff(np.r_[starts, len(rows)]) * marked[starts]
        owner = group[starts]
        first_of = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last_of = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True])
        optional = [[None if pd.isna(x) else int(x) for x in s.reindex(keys)] for s in (timed.min(), timed.max(), gaps)]
        parts = zip(
            sizes.tolist(), *optional, lengths[first_of].tolist(), lengths[last_of].tolist(), np.maximum.reduceat(lengths, first_of).tolist()
        )
        pid = int(rows["pid"].iloc[0])
        states = [(pid, column[i], value[i], s) for i, s in zip(at, parts)]
        if held is not None:
            if held[1:3] == states[0][1:3]:
                states[0] = (*held[:3], merge(held[3], states[0][3]))
            else:
                states.insert(0, held)
        held = states.pop()
        if states:
            yield frame(states)
    if held is not None:
        yield frame([held])


def per_key_states(rows: DataFrame) -> DataFrame:
    """Partial states of rows (key_column, key_value, at_ms, id, status, marked) in even range partitions."""
    order = ["key_column", "key_value", "at_ms", "id", "status"]
    ranged = (
        rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("pid"), "key_column", "key_value", "at_ms", "marked")
    )
    return ranged.mapInPandas(_states, _STATE)


def stitch(states: DataFrame) -> DataFrame:
    """One row a key from its partial states, folded in their order."""
    fields = ["pid", "n", "first_ms", "last_ms", "max_gap", "prefix", "suffix", "best"]
    listed = states.groupBy("key_column", "key_value").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
    null = F.lit(None).cast("bigint")
    start = F.struct(
        F.lit(0).cast("bigint").alias("n"), null.alias("first_ms"), null.alias("last_ms"), null.alias("max_gap"),
        F.lit(0).cast("bigint").alias("suffix"), F.lit(0).cast("bigint").alias("best"),
    )

    def fold(a, p):
        whole = p["prefix"] == p["n"]
        return F.struct(
            (a["n"] + p["n"]).alias("n"),
            F.least(a["first_ms"], p["first_ms"]).alias("first_ms"),
            F.greatest(a["last_ms"], p["last_ms"]).alias("last_ms"),
            F.greatest(a["max_gap"], p["max_gap"], p["first_ms"] - a["last_ms"]).alias("max_gap"),
            F.when(whole, a["suffix"] + p["n"]).otherwise(p["suffix"]).alias("suffix"),
            F.greatest(a["best"], p["best"], a["suffix"] + p["prefix"]).alias("best"),
        )

    return listed.select("key_column", "key_value", F.aggregate("parts", start, fold).alias("s")).select(
        "key_column",
        "key_value",
        F.col("s.n").alias("n_rows"),
        F.col("s.first_ms").alias("first_ms"),
        F.col("s.last_ms").alias("last_ms"),
        F.col("s.max_gap").alias("max_gap_ms"),
        F.col("s.best").alias("longest_failed"),
    )


def per_key_profile(runs: DataFrame, key_columns: list[str]) -> DataFrame:
    """Per value of each key column: rows, first and last creation, widest gap between neighbours, longest streak of
    failed runs in order of creation."""
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("key_column"), F.col(c).alias("key_value")) for c in key_columns]))
    rows = runs.select(keys.alias("k"), F.col("created_at_ms").alias("at_ms"), "id", "status").select(
        "k.key_column", "k.key_value", "at_ms", "id", "status", (F.col("status") == "failed").alias("marked")
    )
    return stitch(per_key_states(rows.withColumn("marked", F.coalesce("marked", F.lit(False)))))


def heavy_keys(profile: DataFrame, share: int = 25) -> DataFrame:
    """(key_column, key_value) of the values with at least 1/share of all rows; null is no value."""
    # The profile, a row a key, is used twice; the rows behind it are folded once.
    profile = cut_lineage(profile)
    totals = profile.groupBy("key_column").agg(F.sum("n_rows").alias("total"))
    # One row per key column, of which there are as many as the caller named.
    return (
        profile.join(F.broadcast(totals), "key_column")
        .where(F.col("key_value").isNotNull() & (F.col("n_rows") * share >= F.col("total")))
        .select("key_column", "key_value")
    )
