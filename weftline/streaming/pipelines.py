"""Structured Streaming: change events, deduplicated deliveries, rate limits and delivery retries.

Each pipeline reads files as they arrive and can be drained with an available-now trigger. State lives in Spark's
state store and, like the results, below the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.relational import EVENT_KINDS
from weftline.session import shared_folder


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """A stream over a table's Parquet files; the schema is the one they have now.

    files_per_trigger or bytes_per_trigger bounds a micro-batch, also when everything that is there is drained; a file is
    never parted.
    """
    schema = spark.read.parquet(path).schema
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if fs.getFileStatus(jvm_path).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def timed(events: DataFrame) -> DataFrame:
    """Received messages with event_time, and kind in small letters."""
    return events.withColumns({"event_time": F.col("received_at").cast("timestamp"), "kind": F.lower("kind")})


def first_deliveries(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """One event for each (run_id, kind, in any letter case) within delay of the first. State is kept for delay only, and
    events that come later than that behind the newest are dropped by the watermark; too_late counts them beside it."""
    return timed(events).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["run_id", "kind"])


def change_events(runs: DataFrame, started_after_ms: int, finished_after_ms: int) -> DataFrame:
    """Strict replay of the change watcher from two cursors, on a stream or a table: running runs started, and runs
    finished, after their cursors; phase orders starts before ends.

    Unlike a poller, which loses what carries a time at or before its cursor when first seen, a stream sees every row.
    """
    kind = F.element_at(F.create_map(*[F.lit(x) for p in EVENT_KINDS.items() for x in p]), F.col("status"))
    started = (F.col("status") == "running") & (F.col("started_at_ms") > started_after_ms)
    ended = F.col("status").isin(*EVENT_KINDS) & (F.col("finished_at_ms") > finished_after_ms)
    return runs.where(started | ended).select(
        F.when(started, 0).otherwise(1).alias("phase"), F.when(started, F.col("started_at_ms")).otherwise(F.col("finished_at_ms")).alias("at_ms"),
        F.col("id").alias("run_id"), F.when(started, "run.started").otherwise(kind).alias("kind"), "tenant", "def_name",
    )


def hourly_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tumbling counts per kind; a window of a stream comes out once it lies delay behind the newest event."""
    window = F.window("event_time", "1 hour").alias("w")
    return timed(events).withWatermark("event_time", delay).groupBy(window, "kind").agg(F.count("*").alias("n"))


def too_late(events: DataFrame, delay_s: int) -> DataFrame:
    """(n) events of a table that, in order of seq, come more than a delay behind the newest one before them: what a
    watermark of that delay may drop. Ranges of seq are looked at on their own, each after the newest event of those before."""
    from weftline.operators.relational import ranges_before

    rows = timed(events).select("seq", F.unix_micros("event_time").alias("at"))
    return ranges_before(rows, "seq", "at").agg(F.count_if(F.col("at") < F.col("before") - delay_s * 1_000_000).alias("n"))


def limited_stream(requests: DataFrame, capacity: float, rate_per_s: float) -> DataFrame:
    """Leaky bucket per key over a stream of (id, key, at_ms, cost): (id, key, at_ms, accepted).

    The state of a key is its level and last time. A key's rows of one micro-batch are sorted in memory, so the source has
    to bound its micro-batches (files_per_trigger); over a whole table, lifecycle.leaky_bucket sorts on disk instead.
    """
    capacity, rate = max(capacity, 1.0), max(rate_per_s, 0.001)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (0.0, None)
        out = []
        for r in pd.concat(list(frames)).sort_values(["at_ms", "id"]).itertuples():
            if last is not None:
                level = max(0.0, level - max(r.at_ms - last, 0) / 1000.0 * rate)
            accepted = level + r.cost <= capacity
            level, last = level + r.cost * accepted, r.at_ms
            out.append((r.id, key[0], r.at_ms, accepted))
        state.update((float(level), int(last)))
        yield pd.DataFrame(out, columns=["id", "key", "at_ms", "accepted"])

    return requests.groupBy("key").applyInPandasWithState(
        step, "id STRING, key STRING, at_ms BIGINT, accepted BOOLEAN", "level DOUBLE, last BIGINT", "append", GroupStateTimeout.NoTimeout
    )


def deliver(stream: DataFrame, send: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Outbox drain: every micro-batch of ready items goes to send, which returns (id, ok) and must be idempotent by id."""
    return stream.writeStream.foreachBatch(lambda batch, _: send(batch).count()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recorded(stream: DataFrame, send: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Deliver a stream and record what came of it: send gives the outcomes of a micro-batch, which are written to the batch's
    own folder, so a batch that is run again after a failure takes the place of its first record."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: send(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}"))
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
