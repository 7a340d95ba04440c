"""Joins, aggregates, windows and set operations over runs, definitions, tasks and artifacts.

All are compositions of built-in operators; what is aggregated before a join is said where it matters. No side is
broadcast by hint except tables whose size the engine itself fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bounds of the duration histogram in seconds (fixed values).
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
#: Terminal status -> event kind (fixed values).
EVENT_KINDS = {"succeeded": "run.succeeded", "failed": "run.failed", "timedout": "run.timed_out", "cancelled": "run.cancelled"}
#: Event kind -> the hook list it selects (fixed values).
HOOK_LISTS = {
    "run.started": "on_start",
    "run.succeeded": "on_success",
    "run.failed": "on_failure",
    "run.timed_out": "on_failure",
    "run.cancelled": "on_cancel",
}
#: Error kinds -> codes (fixed values).
ERROR_CODES = {"transient_failure": "transient"}


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The last stored state of each key: upsert semantics over an append-only table. Ties: the greatest row."""
    rest = [c for c in (columns or rows.columns) if c not in keys]
    plain = [c for c in rest if not rows.schema[c].dataType.typeName() == "map"]
    maps = [c for c in rest if c not in plain]
    # Maps cannot be compared, so they travel behind an order that ends with the comparable columns.
    if not maps:
        best = F.max(F.struct(*order, *[c for c in plain if c not in order])).alias("s")
        return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
    best = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in plain if c not in order])).alias("s")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])


def workflow_summary(definitions: DataFrame, runs: DataFrame) -> DataFrame:
    """Definitions (tenant, name, version) with the number of their runs and the newest one, also where there is none.

    Runs are aggregated first, so the join moves one row a definition.
    """
    newest = F.max(F.struct("created_at_ms", "id", "status")).alias("newest")
    by_name = runs.groupBy("tenant", F.col("def_name").alias("name")).agg(F.count("*").alias("run_count"), newest)
    return definitions.join(by_name, ["tenant", "name"], "left").select(
        "tenant", "name", "version", F.coalesce("run_count", F.lit(0)).alias("run_count"),
        F.col("newest.id").alias("latest_run"), F.col("newest.status").alias("latest_status"),
        F.col("newest.created_at_ms").alias("latest_created_ms"),
    )


def status_bucket(status: Column) -> Column:
    """succeeded, running and queued stand for themselves; everything else counts as failed."""
    return F.when(status.isin("succeeded", "running", "queued"), status).otherwise("failed")


def status_distribution(runs: DataFrame) -> DataFrame:
    return runs.groupBy(status_bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("n"))


def status_bar(runs: DataFrame, width: int = 800) -> DataFrame:
    """Share, bar width (half away from zero) and left edge of each bucket, in the fixed order of the bar."""
    place = F.when(F.col("bucket") == "succeeded", 0).when(F.col("bucket") == "running", 1).when(F.col("bucket") == "queued", 2).otherwise(3)
    counts = status_distribution(runs).withColumn("place", place)
    every = W.partitionBy().orderBy("place")  # four rows at most
    share = F.col("n") * 100.0 / F.sum("n").over(W.partitionBy())
    wide = counts.withColumn("pct", F.round(share, 4)).withColumn("bar", F.round(share * (width / 100)).cast("bigint"))
    before = F.coalesce(F.sum("bar").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return wide.select("bucket", "n", "pct", "bar", before.alias("x"))


def gauges(runs: DataFrame, definitions: DataFrame, entries: DataFrame, boot_ms: int, now_ms: int) -> DataFrame:
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("runs", runs), ("workflows", definitions), ("queue_depth", entries))]
    every = counted[0].unionByName(counted[1]).unionByName(counted[2])
    return every.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in ("runs", "workflows", "queue_depth")]).withColumn(
        "uptime_seconds", F.lit(max(now_ms - boot_ms, 0) // 1000).cast("bigint")
    )


def cumulative_histogram(values: DataFrame, value: Column, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """(le, n): cumulative counts, and the total under +Inf; NaN and negative values do not count.

    A value goes to its first bound, so one small aggregate is shuffled; the running sum is over the bounds.
    """
    kept = values.select(value.alias("v")).where((F.col("v") >= 0) & ~F.isnan("v"))
    slot = F.lit(float("inf"))
    for bound in reversed(bounds):
        slot = F.when(F.col("v") <= bound, F.lit(bound)).otherwise(slot)
    counts = kept.groupBy(slot.alias("le")).agg(F.count("*").alias("n"))
    spark = values.sparkSession
    listed = spark.createDataFrame([(b,) for b in (*bounds, float("inf"))], "le DOUBLE")
    running = F.sum("n").over(W.orderBy("le").rowsBetween(W.unboundedPreceding, 0))
    return listed.join(F.broadcast(counts), "le", "left").withColumn("n", F.coalesce("n", F.lit(0))).select(
        F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")).alias("le"), running.alias("n")
    )


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with their number within their key, by order, from 1.

    A key may hold a third of the rows, so rows are numbered inside even ranges of (key, order), and each range starts
    after the counts of the ranges before it; only counts, one a range and key, meet in a window.
    """
    from weftline.session import cut_lineage, shuffle_partitions

    by = [key, *order]
    ranged = cut_lineage(
        rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    parts = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_in")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_key").orderBy("_in").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_key", "_in", (before - F.col("_first") + 1).alias("_shift"))
    joined = ranged.join(starts, ranged[key].eqNullSafe(starts["_key"]) & (ranged["_part"] == starts["_in"]))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def ranges_before(rows: DataFrame, order: str, value: str) -> DataFrame:
    """rows with before: the greatest value of all rows before in order (null for the first).

    Rows are looked at inside even ranges of the order; one row a range with its greatest value meets in a window.
    """
    from weftline.session import cut_lineage, shuffle_partitions

    ranged = cut_lineage(
        rows.repartitionByRange(shuffle_partitions(rows.sparkSession), order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    )
    parts = ranged.groupBy("_part").agg(F.max(value).alias("_most"))
    earlier = F.max("_most").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # one row a range
    inner = F.max(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select("_part", earlier.alias("_earlier"))
    return ranged.withColumn("_inner", inner).join(starts, "_part").withColumn("before", F.greatest("_inner", "_earlier")).drop("_part", "_inner", "_earlier")


def run_numbers(runs: DataFrame) -> DataFrame:
    """Consecutive numbers per definition name, across tenants, in order of creation."""
    return numbered(runs.select("def_name", "created_at_ms", "id"), "def_name", ["created_at_ms", "id"], "number").drop("created_at_ms")


def fair_share_order(items: DataFrame, tenant: str = "tenant", sequence: str = "seq") -> DataFrame:
    """Pop order of a preloaded fair-share queue: rounds over tenants, in order of each tenant's first item."""
    first = items.groupBy(F.col(tenant).alias("_t")).agg(F.min(sequence).alias("tenant_first"))
    turns = numbered(items, tenant, [sequence], "turn")
    return turns.join(first, turns[tenant].eqNullSafe(first["_t"])).drop("_t")


def event_documents(runs: DataFrame, now_ms: int) -> DataFrame:
    """Events of runs that are over; the message only of an error, the output only of a success."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair]), F.col("status"))
    return runs.where(F.col("status").isin(*EVENT_KINDS)).select(
        kind.alias("kind"), F.col("id").alias("run_id"), "tenant", "def_name", "def_version", "run_number", "status",
        "started_at_ms", "finished_at_ms", "attempts", F.col("error.message").alias("error"),
        F.when(F.col("status") == "succeeded", F.get_json_object("document", "$.output")).alias("output"),
        F.lit(now_ms).cast("bigint").alias("created_at_ms"),
    )


def delivery_id(tenant: Column, def_name: Column, run_id: Column, kind: Column) -> Column:
    return F.sha2(F.concat(tenant, F.lit("/"), def_name, F.lit("/"), run_id, F.lit("/"), kind), 256)


def matched_hooks(hooks: DataFrame, kind: Column) -> DataFrame:
    """Outcome of each hook (list_name, event_filter, webhook_url) for an event: matched, filtered or no_url.

    The filter is tested before the URL; it may name the event's code or the code without its prefix.
    """
    lists = F.create_map(*[F.lit(x) for pair in HOOK_LISTS.items() for x in pair])
    code = kind
    short = F.regexp_replace(code, "^(run\\.)+", "")
    passes = F.col("event_filter").isNull() | (F.col("event_filter") == code) | (F.col("event_filter") == short)
    outcome = F.when(~passes, "filtered").when(F.col("webhook_url").isNull(), "no_url").otherwise("matched")
    return hooks.where(F.col("list_name") == F.element_at(lists, code)).withColumn("outcome", outcome)


def hooks_by_kind(hooks: DataFrame) -> DataFrame:
    """Hooks (list_name, event_filter, webhook_url) of all lists with their outcome for each kind of event their list serves."""
    kinds = {n: [k for k, name in HOOK_LISTS.items() if name == n] for n in HOOK_LISTS.values()}
    served = F.create_map(*[x for n, ks in kinds.items() for x in (F.lit(n), F.array(*map(F.lit, ks)))])
    return matched_hooks(hooks.withColumn("kind", F.explode(served[F.col("list_name")])), F.col("kind"))


def run_deliveries(runs: DataFrame, hooks: DataFrame, key: list[str]) -> DataFrame:
    """(run_id, kind, id, url, headers, body): a delivery for each matching hook of each run (id, key..., status, def_name and
    what an event tells) by the kind of event of its status; a running one has started, and a queued one has none.

    A delivery's id does not hold its URL, so the deliveries of one event share it.
    """
    statuses = {"running": "run.started", **EVENT_KINDS}
    kind = F.create_map(*[F.lit(x) for pair in statuses.items() for x in pair])[F.col("status")]
    matched = hooks_by_kind(hooks).where("outcome = 'matched'")
    started = runs.where(F.col("status").isin(*statuses)).withColumn("kind", kind)
    told = F.struct("kind", F.col("id").alias("run_id"), "tenant", "def_name", "def_version", "status", "started_at_ms", "finished_at_ms", "attempts", F.col("error.message").alias("error"))
    joined = started.withColumn("body", F.to_json(told, {"ignoreNullFields": "false"})).join(matched, [*key, "kind"])
    own = delivery_id(F.col("tenant"), F.col("def_name"), F.col("id"), F.col("kind")).alias("id")
    return joined.select(F.col("id").alias("run_id"), "kind", own, F.col("webhook_url").alias("url"), "headers", "body")


def watch_poll(runs: DataFrame, definitions: DataFrame, started_ms: int, finished_ms: int) -> DataFrame:
    """(turn, phase, at_ms, run_id, kind, dispatched) of one poll of the change watcher: running runs that started and runs
    that finished after the cursors, starts before ends, each by time and id. Runs whose definition (tenant, name) is gone
    are not dispatched; they are rows too, so they can be counted."""
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    started = (F.col("status") == "running") & (F.col("started_at_ms") > started_ms)
    ended = F.col("status").isin(*EVENT_KINDS) & (F.col("finished_at_ms") > finished_ms)
    changed = runs.where(started | ended).select(
        F.when(started, 0).otherwise(1).alias("phase"), F.when(started, F.col("started_at_ms")).otherwise(F.col("finished_at_ms")).alias("at_ms"),
        F.col("id").alias("run_id"), F.when(started, "run.started").otherwise(kinds[F.col("status")]).alias("kind"), "tenant", F.col("def_name").alias("name"),
    )
    known = definitions.select("tenant", "name").distinct().withColumn("dispatched", F.lit(True))
    found = changed.join(known, ["tenant", "name"], "left").withColumn("dispatched", F.coalesce("dispatched", F.lit(False)))
    return numbered(found.withColumn("poll", F.lit(1)), "poll", ["phase", "at_ms", "run_id"], "turn").drop("poll", "tenant", "name")


def watch_cursors(polled: DataFrame, started_ms: int, finished_ms: int) -> DataFrame:
    """One row: the cursors after a poll, and how many runs started, finished, were dispatched and dropped in it."""
    of = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("at_ms")))
    return polled.agg(
        F.coalesce(of(0), F.lit(started_ms)).alias("started_ms"), F.coalesce(of(1), F.lit(finished_ms)).alias("finished_ms"),
        F.count_if(F.col("phase") == 0).alias("started"), F.count_if(F.col("phase") == 1).alias("finished"),
        F.count_if("dispatched").alias("dispatched"), F.count_if(~F.col("dispatched")).alias("dropped"),
    )


def snapshot_tasks(runs: DataFrame, task_runs: DataFrame) -> DataFrame:
    """Runs (id, status) with their tasks in order of name: name, status, attempts and last error of each."""
    one = F.struct("task_name", F.col("id").alias("task_id"), F.col("status").alias("task_status"), "attempts", "last_error")
    by_run = task_runs.groupBy("run_id").agg(F.array_sort(F.collect_list(one)).alias("tasks"))
    return runs.join(by_run, runs["id"] == by_run["run_id"], "left").select("id", "status", "tasks")


def run_snapshots(runs: DataFrame, task_runs: DataFrame) -> DataFrame:
    """Runs with the number of their tasks, of the attempted ones, and of those in each end state."""
    by_run = task_runs.groupBy("run_id").agg(
        F.count("*").alias("tasks"), F.count_if(F.col("attempts") > 0).alias("attempted"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.min(F.when(F.col("status") == "failed", F.col("task_name"))).alias("first_failed"),
    )
    numbers = ("tasks", "attempted", "succeeded", "failed")
    return runs.join(by_run, runs["id"] == by_run["run_id"], "left").select(
        "id", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], "first_failed"
    )


def consistency_errors(runs: DataFrame, task_runs: DataFrame) -> DataFrame:
    """(id, error): the first broken invariant between a run's state and its tasks' states.

    Tasks are looked at in order of name; the name is that of the first task that breaks the invariant.
    """
    named = lambda cond: F.min(F.when(cond, F.col("task_name")))
    s = F.col("t_status")
    by_run = (
        task_runs.select("run_id", "task_name", F.col("status").alias("t_status"))
        .groupBy("run_id")
        .agg(
            F.count("*").alias("n"), named(s == "running").alias("running"),
            named(~s.isin("succeeded", "failed", "skipped")).alias("open"), named(s == "skipped").alias("skipped"),
            F.count_if(s == "failed").alias("n_failed"),
        )
    )
    joined = runs.join(by_run, runs["id"] == by_run["run_id"], "left")
    run, bad = F.col("status"), run_ended_badly()
    error = (
        F.when(bad & F.col("running").isNotNull(), F.concat(F.lit("terminal_with_running_task:"), "running"))
        .when((run == "succeeded") & F.col("open").isNotNull(), F.concat(F.lit("succeeded_with_open_task:"), "open"))
        .when((run == "running") & F.col("n").isNull(), "active_with_no_tasks")
        .when((run == "running") & F.col("open").isNull(), "run_blocked")
        .when(bad & F.col("skipped").isNotNull() & (F.col("n_failed") == 0), F.concat(F.lit("skipped_without_failure:"), "skipped"))
    )
    return joined.select("id", error.alias("error")).where(F.col("error").isNotNull())


def run_ended_badly() -> Column:
    return F.col("status").isin("failed", "timedout")


def compatibility_report(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Issues between two versions' tasks (key..., task, handler, deps): removed tasks and changed handlers break,
    added dependencies are a warning."""
    removed = old.join(new, [*key, "task"], "left_anti").select(
        *key, "task", F.lit("breaking").alias("severity"), F.lit("removed").alias("issue"), F.lit(None).cast("string").alias("detail")
    )
    both = old.select(*key, "task", F.col("handler").alias("h0"), F.col("deps").alias("d0")).join(new, [*key, "task"])
    changed = both.where(F.col("h0") != F.col("handler")).select(
        *key, "task", F.lit("breaking"), F.lit("handler"), F.concat("h0", F.lit(" -> "), "handler")
    )
    fresh = F.array_sort(F.array_except("deps", "d0"))
    added = both.where(F.size(fresh) > 0).select(*key, "task", F.lit("warning"), F.lit("dependencies"), F.array_join(fresh, ","))
    return removed.union(changed).union(added)


def timeout_warnings(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of compatibility_report, without a task, for definitions (key..., timeout_ms) whose timeout decreased."""
    both = old.select(*key, F.col("timeout_ms").alias("t0")).join(new, key).where(F.col("timeout_ms") < F.col("t0"))
    detail = F.concat(F.col("t0").cast("string"), F.lit(" -> "), F.col("timeout_ms").cast("string"))
    return both.select(*key, F.lit(None).cast("string").alias("task"), F.lit("warning").alias("severity"), F.lit("timeout").alias("issue"), detail.alias("detail"))


def artifact_sweep(descriptors: DataFrame, active: DataFrame, retention_ms: int, now_ms: int, tenants: list[str] | None = None) -> DataFrame:
    """Descriptors (id, tenant, size_bytes, created_at_ms) of the tenants, one an id, with whether they are reclaimed: not
    active and old. That is the dry run; artifacts_after deletes."""
    if tenants is not None:
        descriptors = descriptors.where(F.col("tenant").isin(*tenants))
    once = descriptors.groupBy("id").agg(F.max("size_bytes").alias("size_bytes"), F.min("created_at_ms").alias("created_at_ms"))
    held = active.select("id").distinct().withColumn("held", F.lit(True))
    age = F.greatest(F.lit(now_ms) - F.col("created_at_ms"), F.lit(0))
    return once.join(held, "id", "left").withColumn("reclaimed", F.col("held").isNull() & (age >= retention_ms)).drop("held")


def artifacts_after(descriptors: DataFrame, swept: DataFrame) -> DataFrame:
    """Descriptors that are left when what a sweep reclaims is deleted."""
    return descriptors.join(swept.where("reclaimed").select("id"), "id", "left_anti")


def illegal_edges(states: list[str], legal: list[tuple[str, str]], spark) -> DataFrame:
    """All pairs of states that are no edge; the tables are as long as the list of states."""
    pairs = [(a, b) for a in states for b in states if (a, b) not in set(legal)]
    return spark.createDataFrame(pairs, "from_state STRING, to_state STRING")
