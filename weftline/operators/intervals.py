"""Overlapping and gapped intervals: continuous periods per entity, and the gaps between them.

The rows are range partitioned by (entity, start), so an entity with a third of all rows is spread over many tasks.
Each task sorts, compares every start with the running maximum of the previous ends and labels islands. What one
island before the boundary means for the next task is a state (entity, island start, furthest end); the states of the
partitions, one or two rows each, are composed in order and given back to the islands of the first entity there.

Defined results: rows with a null or empty entity, a null time, or an end not after the start are no intervals.
Intervals that touch are continuous. Repeated rows and equal starts change nothing. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut_lineage, shuffle_partitions

_ISLAND = "pid INT, entity STRING, from_ms BIGINT, to_ms BIGINT, before_ms BIGINT, head BOOLEAN, tail BOOLEAN"


def _islands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Islands of one partition, whose rows come sorted by (entity, from_ms). The last island waits for the next batch."""
    held: pd.DataFrame | None = None
    is_first = True

    def flagged(islands: pd.DataFrame, last: bool) -> pd.DataFrame:
        nonlocal is_first
        islands = islands.assign(head=False, tail=False)
        if len(islands):
            islands.iloc[0, islands.columns.get_loc("head")] = is_first
            islands.iloc[-1, islands.columns.get_loc("tail")] = last
            is_first = False
        return islands.astype({"before_ms": "Int64"})[["pid", "entity", "from_ms", "to_ms", "before_ms", "head", "tail"]]

    for rows in batches:
        if not len(rows):
            continue
        before = None
        if held is not None:
            before = held["before_ms"].iloc[0]
            rows = pd.concat([held[["pid", "entity", "from_ms", "to_ms"]], rows], ignore_index=True)
        entity = rows["entity"].to_numpy()
        changed = np.r_[True, entity[1:] != entity[:-1]]
        group = np.cumsum(changed)
        reach = rows["to_ms"].groupby(group).cummax().to_numpy()
        starts = rows["from_ms"].to_numpy()
        fresh = changed | np.r_[True, starts[1:] > reach[:-1]]
        at = np.flatnonzero(fresh)
        islands = rows.iloc[at].assign(to_ms=reach[np.r_[at[1:] - 1, len(rows) - 1]])
        previous = np.r_[0, islands["to_ms"].to_numpy()[:-1]]
        islands["before_ms"] = pd.array(previous, dtype="Int64")
        islands.loc[changed[at], "before_ms"] = pd.NA
        if before is not None and not pd.isna(before):
            islands.iloc[0, islands.columns.get_loc("before_ms")] = before
        held = islands.iloc[[-1]]
        if len(islands) > 1:
            yield flagged(islands.iloc[:-1], last=False)
    if held is not None:
        yield flagged(held, last=True)


def compose_boundaries(edges: list[tuple]) -> list[tuple]:
    """Incoming state (pid, entity, island start, furthest end) of each partition that continues an entity.

    edges: (pid, entity, from, to, head, tail) of each partition's first and last island, by pid.
    """
    carried, state = [], None
    by_pid: dict[int, dict[str, tuple]] = {}
    for pid, entity, start, end, head, tail in edges:
        place = by_pid.setdefault(pid, {})
        if head:
            place["head"] = (entity, start, end)
        if tail:
            place["tail"] = (entity, start, end)
    for pid in sorted(by_pid):
        head, tail = by_pid[pid]["head"], by_pid[pid]["tail"]
        incoming = state if state is not None and state[0] == head[0] else None
        if incoming:
            carried.append((pid, *incoming))
        if incoming and tail[0] == incoming[0] and tail[1] <= incoming[2]:
            state = (tail[0], incoming[1], max(incoming[2], tail[2]))
        else:
            state = tail
    return carried


def periods_and_gaps(rows: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, span_kind, from_ms, to_ms)."""
    spark = rows.sparkSession
    spans = (
        rows.select(F.col(entity).alias("entity"), F.col(start).alias("from_ms"), F.col(end).alias("to_ms"))
        .where((F.col("entity") != "") & (F.col("to_ms") > F.col("from_ms")))
        .groupBy("entity", "from_ms")
        .agg(F.max("to_ms").alias("to_ms"))
    )
    ranged = (
        spans.repartitionByRange(shuffle_partitions(spark), "entity", "from_ms")
        .sortWithinPartitions("entity", "from_ms")
        .select(F.spark_partition_id().alias("pid"), "entity", "from_ms", "to_ms")
    )
    islands = cut_lineage(ranged.mapInPandas(_islands, _ISLAND))
    # At most two rows a partition come to the driver, and at most one a partition goes back.
    edges = islands.where("head or tail").select("pid", "entity", "from_ms", "to_ms", "head", "tail").collect()
    carried = spark.createDataFrame(
        compose_boundaries([tuple(r) for r in edges]), "pid INT, c_entity STRING, c_from BIGINT, c_to BIGINT"
    )
    joined = islands.join(F.broadcast(carried), "pid", "left")
    same = F.coalesce(F.col("entity") == F.col("c_entity"), F.lit(False))
    absorbed = same & (F.col("from_ms") <= F.col("c_to"))
    labelled = joined.select(
        "entity",
        F.when(absorbed, F.col("c_from")).otherwise(F.col("from_ms")).alias("start_ms"),
        F.when(absorbed, F.greatest("to_ms", "c_to")).otherwise(F.col("to_ms")).alias("to_ms"),
        F.when(~absorbed, F.greatest("before_ms", F.when(same, F.col("c_to")))).alias("gap_from"),
    )
    periods = labelled.groupBy("entity", "start_ms").agg(F.max("to_ms").alias("to_ms"), F.max("gap_from").alias("gap_from"))
    spans_out = F.array(
        F.struct(F.lit("period").alias("span_kind"), F.col("start_ms").alias("from_ms"), F.col("to_ms").alias("to_ms")),
        F.struct(F.lit("gap").alias("span_kind"), F.col("gap_from").alias("from_ms"), F.col("start_ms").alias("to_ms")),
    )
    return periods.select("entity", F.inline(spans_out)).where(F.col("from_ms").isNotNull())
