"""Queues, deliveries and runs as snapshots: every command is a pure transition from one table to the next.

Exclusive claims under concurrent writers are a property of the storage the snapshots are committed to, not of these
plans; within one batch of commands each run has one winner.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.operators.filters import TERMINAL_RUN
from weftline.operators.relational import EVENT_KINDS
from weftline.session import cut_lineage, shuffle_partitions

NO_TOKEN = ""


def enqueue(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after inserting new ones with outcome inserted, conflict or kept; of equal new runs the earliest due wins."""
    first = F.row_number().over(W.partitionBy("run_id").orderBy("due_at_ms", "token"))
    ranked = new.withColumn("turn", first)
    fresh = ranked.where("turn = 1").drop("turn").join(entries.select("run_id"), "run_id", "left_anti")
    clash = ranked.where("turn > 1").select("run_id").unionByName(
        ranked.where("turn = 1").join(entries.select("run_id"), "run_id", "left_semi").select("run_id")
    )
    columns = entries.columns
    return (
        entries.withColumn("outcome", F.lit("kept"))
        .unionByName(fresh.select(*columns).withColumn("outcome", F.lit("inserted")))
        .unionByName(clash.select("run_id", *[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in columns if c != "run_id"]).withColumn("outcome", F.lit("conflict")))
    )


def _with_commands(entries: DataFrame, commands: DataFrame) -> DataFrame:
    """Entries beside one command of their run: the one with the entry's own token if there is one, else that with the
    smallest token. Commands with a null token are none."""
    known = commands.where(F.col("command_token").isNotNull())
    least = known.groupBy("run_id").agg(F.min("command_token").alias("least"))
    own = known.select("run_id", F.col("command_token").alias("token"), F.lit(True).alias("own")).distinct()
    both = entries.join(least, "run_id", "left").join(own, ["run_id", "token"], "left")
    return both.withColumn("command_token", F.when(F.col("own"), F.col("token")).otherwise(F.col("least"))).drop("least", "own")


def claim(entries: DataFrame, commands: DataFrame, now_ms: int, lease_ms: int, steal_expired: bool = False) -> DataFrame:
    """Set token and lease where the entry is free or held by the same token; otherwise the claim is lost.

    An expired lease stays with its holder until it is recovered, unless steal_expired is set.
    """
    free = (F.col("token") == NO_TOKEN) | (F.col("token") == F.col("command_token"))
    if steal_expired:
        free = free | (F.col("lease_until_ms") <= now_ms)
    wins = F.col("command_token").isNotNull() & free
    return _with_commands(entries, commands).select(
        "run_id", F.when(wins, F.col("command_token")).otherwise(F.col("token")).alias("token"), "due_at_ms",
        F.when(wins, F.lit(now_ms + lease_ms)).otherwise(F.col("lease_until_ms")).alias("lease_until_ms"),
        F.when(wins, "dispatcher").otherwise(F.col("claimed_by")).alias("claimed_by"),
        F.when(F.col("command_token").isNull(), "untouched").when(wins, "claimed").otherwise("lost").alias("outcome"),
    )


def ack(entries: DataFrame, commands: DataFrame) -> DataFrame:
    """Entries that are left once those whose token matches are done."""
    done = commands.select("run_id", F.col("command_token").alias("token")).distinct()
    return entries.join(done, ["run_id", "token"], "left_anti")


def _held(entries: DataFrame, commands: DataFrame, changes: dict[str, Column], also: Column | None = None) -> DataFrame:
    mine = (F.col("token") == F.col("command_token")) & (F.col("token") != NO_TOKEN)
    mine = F.coalesce(mine if also is None else mine & also, F.lit(False))
    out = [F.when(mine, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in entries.columns]
    outcome = F.when(F.col("command_token").isNull(), "untouched").when(mine, "done").otherwise("lost").alias("outcome")
    return _with_commands(entries, commands).select(*out, outcome)


def _cleared() -> dict[str, Column]:
    return {"token": F.lit(NO_TOKEN), "lease_until_ms": F.lit(None).cast("bigint"), "claimed_by": F.lit(None).cast("string")}


def release(entries: DataFrame, commands: DataFrame, retry_at_ms: int) -> DataFrame:
    return _held(entries, commands, {**_cleared(), "due_at_ms": F.lit(retry_at_ms)})


def fail_claim(entries: DataFrame, commands: DataFrame) -> DataFrame:
    """As release, but the entry stays due when it was."""
    return _held(entries, commands, _cleared())


def renew_lease(entries: DataFrame, commands: DataFrame, now_ms: int, extend_ms: int) -> DataFrame:
    """Only a live lease can be renewed."""
    return _held(entries, commands, {"lease_until_ms": F.lit(now_ms + extend_ms)}, F.col("lease_until_ms") > now_ms)


def recover_expired(entries: DataFrame, now_ms: int) -> DataFrame:
    expired = F.coalesce(F.col("lease_until_ms") <= now_ms, F.lit(False))
    cleared = _cleared()
    out = [F.when(expired, cleared[c]).otherwise(F.col(c)).alias(c) if c in cleared else F.col(c) for c in entries.columns]
    return entries.select(*out, expired.alias("recovered"))


def cancel_runs(runs: DataFrame, wanted: DataFrame, now_ms: int) -> DataFrame:
    """Runs (id, status, finished_at_ms) after cancelling; what is over stays, and changed tells which did change."""
    marked = runs.join(wanted.select("id").distinct().withColumn("wanted", F.lit(True)), "id", "left")
    hit = F.coalesce("wanted", F.lit(False)) & ~F.col("status").isin(*TERMINAL_RUN)
    return marked.select(
        "id", F.when(hit, "cancelled").otherwise(F.col("status")).alias("status"),
        F.when(hit, F.lit(now_ms)).otherwise(F.col("finished_at_ms")).alias("finished_at_ms"), hit.alias("changed"),
    )


def entries_after_cancel(entries: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Queue entries without those of the runs that cancel_runs changed."""
    gone = cancelled.where("changed").select(F.col("id").alias("run_id"))
    return entries.join(gone, "run_id", "left_anti")


def outbox_enqueue(items: DataFrame, deliveries: DataFrame, max_attempts: int, now_ms: int) -> DataFrame:
    """New items of deliveries (id, seq): an id that is there already, in whatever state, keeps its item, and of several
    deliveries of an id the first one is taken."""
    first = deliveries.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("seq").alias("seq"))
    return first.join(items.select("id"), "id", "left_anti").select(
        "id", "seq", F.lit(0).alias("attempts"), F.lit(max(max_attempts, 1)).alias("max_attempts"), F.lit(now_ms).alias("next_attempt_at_ms"), F.lit("pending").alias("status")
    )


def compare_and_set(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Version after updates (keys..., expected): raised by one where the expectation holds; of several the smallest."""
    once = updates.groupBy(*keys).agg(F.min("expected").alias("expected"))
    hit = F.col("expected") == F.col("version")
    outcome = F.when(F.col("version").isNull(), "missing").when(F.col("expected").isNull(), "untouched").when(hit, "updated").otherwise("conflict")
    return current.join(once, keys, "full").select(*keys, F.when(hit, F.col("version") + 1).otherwise(F.col("version")).alias("version"), outcome.alias("outcome"))


def cascade_delete(task_runs: DataFrame, deleted_runs: DataFrame) -> DataFrame:
    return task_runs.join(deleted_runs.select(F.col("id").alias("run_id")).distinct(), "run_id", "left_anti")


def outbox_after(items: DataFrame, results: DataFrame, now_ms: int, base_backoff_ms: int) -> DataFrame:
    """Pending items after delivery results (id, ok): delivered, put off with growing delay, or dead."""
    from weftline.functions.scalars import outbox_backoff

    once = results.groupBy("id").agg(F.max("ok").alias("ok"))
    hit = (F.col("status") == "pending") & F.col("ok").isNotNull()
    failed = hit & ~F.col("ok")
    dead = failed & (F.col("attempts") + 1 >= F.col("max_attempts"))
    return items.join(once, "id", "left").select(
        "id", (F.col("attempts") + failed.cast("int")).alias("attempts"), "max_attempts",
        F.when(failed & ~dead, F.lit(now_ms) + outbox_backoff(base_backoff_ms, F.col("attempts"))).otherwise(F.col("next_attempt_at_ms")).alias("next_attempt_at_ms"),
        F.when(hit & F.col("ok"), "delivered").when(dead, "dead_letter").otherwise(F.col("status")).alias("status"),
    )


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str, output: list[str]) -> DataFrame:
    """Fold each key's rows (tuples) in order and emit a row for each: state = start(key); out, state = step(state, row).

    The rows of a key stream through one task in sorted order with a constant state; they are never gathered. A fold
    whose next state hangs on every row before cannot be split.
    """
    at_key = rows.columns.index(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in zip(*(batch[c].tolist() for c in batch.columns)):
                if not begun or row[at_key] != at:
                    at, state, begun = row[at_key], start(row[at_key]), True
                result, state = step(state, row)
                out.append(result)
            yield pd.DataFrame(out, columns=output)

    placed = rows.repartition(shuffle_partitions(rows.sparkSession), key).sortWithinPartitions(key, *order)
    return placed.mapInPandas(run, schema)


def leaky_bucket(requests: DataFrame, key: str, capacity: float, rate_per_s: float) -> DataFrame:
    """(id, key, at_ms, accepted, wait_ms) of requests (id, key, at_ms, cost); failed tries advance the clock too. Requests
    without a time or cost take no part, and accepted is null.

    Rows are folded in even ranges of (key, time, id), so a hot key is spread over tasks. After a pause in which a full
    bucket runs empty, what was before does not matter; so a task knows its states from its first pause or change of key
    on. The rows before that, its head, are folded afterwards from the state the task before it ended with. Heads of
    tasks without any pause are folded one behind the other: only a key without pauses is as slow as one task.
    """
    spark = requests.sparkSession
    capacity, rate = max(capacity, 1.0), max(rate_per_s, 0.001)
    pause = capacity / rate * 1000.0 + 1
    types = {f.name: f.dataType.simpleString() for f in requests.schema}
    result = f"id {types['id']}, {key} {types[key]}, at_ms BIGINT, accepted BOOLEAN, wait_ms BIGINT"
    timed = F.col("at_ms").isNotNull() & F.col("cost").isNotNull()

    def step(level, last, now, cost):
        if last is not None:
            level = max(0.0, level - max(now - last, 0) / 1000.0 * rate)
        if level + cost <= capacity:
            return level + cost, True, 0
        return level, False, max(1, math.ceil((level + cost - capacity) / rate * 1000.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = at = last = pid = None
        level, head, begun = 0.0, True, False
        for batch in batches:
            out = []
            for pid, id_, own, now, cost in zip(*(batch[c].tolist() for c in batch.columns)):
                if not begun:
                    first, begun = own, True
                elif own != at or now - last >= pause:
                    level, last, head = 0.0, None if own != at else last, False
                if head:
                    out.append((pid, id_, own, now, cost, None, None, "head"))
                else:
                    level, accepted, wait = step(level, last, now, cost)
                    out.append((pid, id_, own, now, cost, accepted, wait, "done"))
                at, last = own, now
            yield pd.DataFrame(out, columns=names).astype(kinds)
        if begun:
            # What the task ended with: its first and last key, its state, and whether it was all head.
            yield pd.DataFrame([(pid, None, at, last, level, head, None, "end"), (pid, None, first, None, None, None, None, "begin")], columns=names).astype(kinds)

    names = ["pid", "id", key, "at_ms", "cost", "accepted", "wait_ms", "part"]
    kinds = {"at_ms": "Int64", "cost": "float64", "accepted": "boolean", "wait_ms": "Int64"}
    order = [key, "at_ms", "id"]
    ranged = requests.where(timed).select("id", key, "at_ms", F.col("cost").cast("double").alias("cost"))
    ranged = ranged.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("pid"), "id", key, "at_ms", "cost")
    folded = cut_lineage(ranged.mapInPandas(run, f"pid INT, id {types['id']}, {key} {types[key]}, at_ms BIGINT, cost DOUBLE, accepted BOOLEAN, wait_ms BIGINT, part STRING"))

    # Two rows a task come to the driver.
    ends = {r["pid"]: r for r in folded.where("part = 'end'").collect()}
    begins = {r["pid"]: r for r in folded.where("part = 'begin'").collect()}
    chains, states, before = [], {}, None
    for pid in sorted(ends):
        if before is not None and ends[before][key] == begins[pid][key]:
            if ends[before]["accepted"]:
                chain = chains[-1][1]
            else:
                chain = pid
                states[chain] = (ends[before]["cost"], ends[before]["at_ms"])
        else:
            chain = pid
        chains.append((pid, chain))
        before = pid

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, level, last = None, 0.0, None
        for batch in batches:
            out = []
            for chain, id_, own, now, cost in zip(*(batch[c].tolist() for c in batch.columns)):
                if chain != at:
                    at, (level, last) = chain, states.get(chain, (0.0, None))
                level, accepted, wait = step(level, last, now, cost)
                last = now
                out.append((id_, own, now, accepted, wait))
            yield pd.DataFrame(out, columns=["id", key, "at_ms", "accepted", "wait_ms"])

    of_chain = spark.createDataFrame(chains, "pid INT, chain INT")
    heads = folded.where("part = 'head'").join(F.broadcast(of_chain), "pid").select("chain", "id", key, "at_ms", "cost")
    heads = heads.repartition(shuffle_partitions(spark), "chain").sortWithinPartitions("chain", "at_ms", "id").mapInPandas(finish, result)
    done = folded.where("part = 'done'").select("id", key, "at_ms", "accepted", "wait_ms")
    untimed = requests.where(~timed).select("id", key, F.col("at_ms").cast("bigint").alias("at_ms"), F.lit(None).cast("boolean").alias("accepted"), F.lit(None).cast("bigint").alias("wait_ms"))
    return done.unionByName(heads).unionByName(untimed)


def concurrency_limit(events: DataFrame, key: str, limit: int) -> DataFrame:
    """(id, key, action, granted, active) of acquire and release events (id, holder, key, at_ms, action).

    A release frees a permit only if its holder has one.
    """
    limit = max(limit, 1)

    def step(held, r):
        id_, holder, at, _, action = r
        granted = False
        if action == "acquire":
            if holder not in held and len(held) < limit:
                held, granted = held | {holder}, True
        elif holder in held:
            held, granted = held - {holder}, True
        return (id_, at, action, granted, len(held)), held

    rows = events.select("id", "holder", key, "at_ms", "action")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered_fold(
        rows, key, ["at_ms", "id"], lambda k: frozenset(), step,
        f"id {types['id']}, {key} {types[key]}, action STRING, granted BOOLEAN, active INT", ["id", key, "action", "granted", "active"],
    )


def permit_events(events: DataFrame) -> DataFrame:
    """(id, holder, tenant, at_ms, action) of events in any letter case: a start acquires, every end of a run releases."""
    kind = F.lower("kind")
    action = F.when(kind == "run.started", "acquire").when(kind.isin(*EVENT_KINDS.values()), "release")
    chosen = events.select(F.col("seq").alias("id"), F.col("run_id").alias("holder"), "tenant", F.col("created_at_ms").alias("at_ms"), action.alias("action"))
    return chosen.where(F.col("action").isNotNull())


def simulate_attempts(runs: DataFrame, handler_fails: Callable[[str], bool]) -> DataFrame:
    """(id, outcome, failed_tasks, action, release_after_ms, error_task, error_message) of one attempt of each run (id, document,
    states, task_attempts, attempts, overdue).

    One pass over the ready tasks until none is left, then what can no longer run is skipped. A task skipped before
    stays skipped, and a failed one without attempts left is not run again. The run goes back into the queue if it and each
    failed task have attempts left, a task by its own retry or else the definition's or the default. It is released after the
    delay of the definition's policy before jitter; a run that fails for good has the message of its first failing task,
    from task_errors (JSON) if it was not run again. Without task_attempts (JSON), tasks have had none.
    """
    import json

    from weftline.functions.scalars import MOST_BACKOFF_MS
    from weftline.operators.structural import read_document
    from weftline.operators.graph import RETRY_DEFAULTS, graph_error, ready_tasks, skip_closure, tasks_of, timeout_ms

    def budget(holder):
        retry = holder.get("retry") if isinstance(holder.get("retry"), dict) else {}
        return next((retry[k] for k in ("max_attempts", "maxAttempts", "tries") if isinstance(retry.get(k), int)), None)

    def delay(retry, index):
        retry = retry if isinstance(retry, dict) else {}
        first = lambda *names: next((retry[k] for k in names if retry.get(k) is not None), None)
        span = lambda default, *names: default if (x := first(*names)) is None else timeout_ms(x)
        base = span(RETRY_DEFAULTS["base_delay_ms"], "base_delay_ms", "initial_delay_ms", "baseDelayMs")
        most = min(span(RETRY_DEFAULTS["max_delay_ms"], "max_delay_ms", "maxDelayMs"), MOST_BACKOFF_MS)
        grows = first("multiplier")
        grows = grows if isinstance(grows, (int, float)) else RETRY_DEFAULTS["multiplier"]
        kind = first("backoff") or "exponential"
        grown = base + base * (grows - 1) * index // 1 if kind == "linear" and grows > 1 else base * grows**index if kind == "exponential" and grows > 1 else base
        return max(int(min(grown, most)), base)

    def one(document, states, tried, attempts, overdue, errors):
        value = read_document(document)
        if not isinstance(value, dict):
            return "definition_lost", "", "ack", None, None, None
        if overdue:
            return "timedout", "", "ack", None, None, None
        records, graph = tasks_of(value)
        if graph_error(graph):
            return "invalid_definition", "", "ack", None, None, None
        now = {t: "pending" for t in graph} | (json.loads(states) if states else {})
        handlers = {str(t.get("name")): str(t.get("handler") or t.get("handler_id") or t.get("uses")) for t in records}
        had = json.loads(tried) if tried else {}
        most = budget(value)
        most = RETRY_DEFAULTS["max_attempts"] if most is None else most
        own = {}
        for t in records:
            own.setdefault(str(t.get("name")), budget(t))

        def left(t):
            return (had.get(t) or 0) < (most if own.get(t) is None else own[t])

        ran: set[str] = set()
        while ready := [t for t in ready_tasks(graph, now) if t not in ran and (now[t] != "failed" or left(t))]:
            for t in ready:
                ran.add(t)
                had[t] = (had.get(t) or 0) + 1
                now[t] = "failed" if handler_fails(handlers[t]) else "succeeded"
        now = skip_closure(graph, now)
        failed = sorted(t for t, s in now.items() if s == "failed")
        if not failed:
            return "succeeded", "", "ack", None, None, None
        if attempts + 1 < most and all(map(left, failed)):
            return "queued", ",".join(failed), "release", delay(value.get("retry"), int(attempts)), None, None
        message = f"{handlers[failed[0]]} failed" if failed[0] in ran else (json.loads(errors) if errors else {}).get(failed[0])
        return "failed", ",".join(failed), "ack", None, failed[0], message or "task failed"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *one(*r)) for i, *r in zip(*(b[c] for c in ("id", "document", "states", "task_attempts", "attempts", "overdue", "task_errors")))]
            names = ["id", "outcome", "failed_tasks", "action", "release_after_ms", "error_task", "error_message"]
            yield pd.DataFrame(rows, columns=names).astype({"release_after_ms": "Int64"})

    given = lambda c: F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c)
    chosen = runs.select("id", "document", "states", given("task_attempts"), "attempts", "overdue", given("task_errors"))
    return chosen.mapInPandas(run, "id STRING, outcome STRING, failed_tasks STRING, action STRING, release_after_ms BIGINT, error_task STRING, error_message STRING")
