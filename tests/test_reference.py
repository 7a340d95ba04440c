import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.operators import graph, lifecycle, relational
from weftline.operators.filters import AuditFilter, RunFilter, outbox_ready, queue_ready
from weftline.plans import reference
from weftline.sources import files
from weftline.streaming import pipelines

RUNS = "id STRING, tenant STRING, def_name STRING, status STRING, created_at_ms BIGINT, started_at_ms BIGINT, finished_at_ms BIGINT, tags MAP<STRING,STRING>"


def runs(spark):
    return spark.createDataFrame([
        ("a", "acme", "nightly", "queued", 100, None, None, {"env": "test"}), ("b", "acme", "nightly", "running", 200, 150, None, {"env": "prod", "team": None}),
        ("c", "beta", "nightly_x", "failed", 300, 150, 450, None), ("d", None, None, None, 300, -(2**62), 2**62, {}),
    ], RUNS)


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    "own, want",
    [
        (RunFilter(), "abcd"), (RunFilter(status="failed"), "c"), (RunFilter(status_in=("failed", "queued")), "ac"), (RunFilter(tenant="acme"), "ab"),
        (RunFilter(name_prefix="nightly_"), "c"), (RunFilter(name="nightly"), "ab"), (RunFilter(tags={"env": "prod"}), "b"), (RunFilter(tags={"none": "x"}), ""),
        (RunFilter(has_tag_keys=("env", "team")), "b"), (RunFilter(from_ms=200, to_ms=300), "b"), (RunFilter(finished_from_ms=400, finished_to_ms=450), "c"),
        (RunFilter(min_duration_ms=250), "cd"), (RunFilter(min_duration_ms=350), "d"),
    ],
)
def test_run_filter(spark, own, want):
    assert sorted(ids(own.apply(runs(spark)))) == list(want)


def test_page_is_newest_first(spark):
    assert ids(RunFilter(limit=2).page(runs(spark))) == ["c", "d"]
    assert ids(RunFilter(limit=2, offset=1).page(runs(spark))) == ["d", "b"]


def test_request_parameters():
    own = RunFilter.from_query({"statusIn": " failed, ,queued ", "limit": "500", "fromMs": "1"})
    assert own.status_in == ("failed", "queued") and own.limit == 500 and own.from_ms == 1
    for bad in ({"status": "odd"}, {"limit": "0"}, {"limit": "501"}, {"fromMs": "2", "toMs": "1"}, {"minDurationMs": "-1"}, {"nope": "1"}, {"offset": "-1"}):
        with pytest.raises(ValueError):
            RunFilter.from_query(bad)


def test_audit_queue_outbox(spark):
    audit = spark.createDataFrame([(i, 10 * i, "t1", "user") for i in range(1, 6)], "seq BIGINT, timestamp_ms BIGINT, tenant STRING, actor_kind STRING")
    assert [r.timestamp_ms for r in AuditFilter(limit=2, offset=1).page(audit).collect()] == [40, 30]
    assert [r.seq for r in AuditFilter(since_ms=20, until_ms=40, limit=0).page(audit).collect()] == [4]
    queue = spark.createDataFrame([("a", 50, None), ("b", 50, 160), ("c", 70, None), ("d", 50, 60)], "run_id STRING, due_at_ms BIGINT, lease_until_ms BIGINT")
    assert sorted(r.run_id for r in queue_ready(queue, 60).collect()) == ["a", "d"]
    items = spark.createDataFrame([("a", "pending", 5, 1), ("b", "pending", 5, 0), ("c", "delivered", 1, 0), ("d", "pending", 99, 0)], "id STRING, status STRING, next_attempt_at_ms BIGINT, attempts INT")
    assert ids(outbox_ready(items, 10)) == ["b", "a"]


def test_histogram_bar_numbers_fair_share(spark):
    values = spark.createDataFrame([(0.04,), (0.5,), (2.0,), (float("nan"),), (-1.0,), (None,)], "v DOUBLE")
    got = {r.le: r.n for r in relational.cumulative_histogram(values, F.col("v")).collect()}
    assert got["0.05"] == 1 and got["+Inf"] == 3 and got["0.025"] == 0 and got["1.0"] == 2
    numbered = spark.createDataFrame([("x", "nightly", 1), ("y", "nightly", 2), ("z", "other", 1)], "id STRING, def_name STRING, created_at_ms BIGINT")
    assert {r.id: r.number for r in relational.run_numbers(numbered).collect()} == {"x": 1, "y": 2, "z": 1}
    items = spark.createDataFrame([("a1", "a", 1), ("a2", "a", 2), ("a3", "a", 3), ("b1", "b", 4), ("c1", "c", 5)], "id STRING, tenant STRING, seq INT")
    assert ids(relational.fair_share_order(items).orderBy("turn", "tenant_first")) == ["a1", "b1", "c1", "a2", "a3"]


def test_summary_keeps_definitions_without_runs(spark):
    defs = spark.createDataFrame([("acme", "nightly", 1), ("acme", "idle", 3)], "tenant STRING, name STRING, version INT")
    got = {r.name: (r.run_count, r.latest_run) for r in relational.workflow_summary(defs, runs(spark)).collect()}
    assert got == {"nightly": (2, "b"), "idle": (0, None)}


def test_hooks(spark):
    hooks = spark.createDataFrame([("on_failure", "run.failed", "u"), ("on_failure", "failed", "u"), ("on_failure", "run.succeeded", "u"), ("on_failure", None, None), ("on_start", None, "u")], "list_name STRING, event_filter STRING, webhook_url STRING")
    got = sorted(r.outcome for r in relational.matched_hooks(hooks, F.lit("run.failed")).collect())
    assert got == ["filtered", "matched", "matched", "no_url"]


def test_hooks_of_all_lists(spark, rows):
    lists = {"on_start": [{"url": "s"}], "onSuccess": {"webhook_url": "o", "event_filter": "succeeded"}, "on_failure": [{"url": "t", "event_filter": "timed_out"}, {"url": "f"}], "on_cancel": [{"url": "c", "event_filter": "run.failed"}, {}]}
    docs = spark.createDataFrame([("t", "w", 1, json.dumps({"tasks": [], "hooks": lists}))], "tenant STRING, name STRING, version INT, document STRING")
    hooks = reference._all_hooks(docs)
    assert rows(relational.hooks_by_kind(hooks).select("kind", "i", "outcome")) == [
        ("run.cancelled", 0, "filtered"), ("run.cancelled", 1, "no_url"), ("run.failed", 0, "filtered"), ("run.failed", 1, "matched"), ("run.started", 0, "matched"),
        ("run.succeeded", 0, "matched"), ("run.timed_out", 0, "matched"), ("run.timed_out", 1, "matched"),
    ]
    states = ["running", "succeeded", "failed", "timedout", "cancelled", "queued"]
    schema = "id STRING, tenant STRING, name STRING, version INT, status STRING, def_name STRING, def_version INT, started_at_ms BIGINT, finished_at_ms BIGINT, attempts INT, error STRUCT<message: STRING>"
    runs = spark.createDataFrame([(s, "t", "w", 1, s, "w", 1, 5, None, 2, None) for s in states], schema)
    got = relational.run_deliveries(runs, hooks, ["tenant", "name", "version"])
    assert json.loads(got.where("run_id = 'failed'").first().body) == {
        "kind": "run.failed", "run_id": "failed", "tenant": "t", "def_name": "w", "def_version": 1, "status": "failed", "started_at_ms": 5, "finished_at_ms": None, "attempts": 2, "error": None,
    }
    assert rows(got.select("run_id", "url")) == [("failed", "f"), ("running", "s"), ("succeeded", "o"), ("timedout", "f"), ("timedout", "t")]


def test_compatibility(spark):
    schema = "name STRING, task STRING, handler STRING, deps ARRAY<STRING>"
    old = spark.createDataFrame([("w", "step1", "h1", []), ("w", "step2", "h", [])], schema)
    new = spark.createDataFrame([("w", "step1", "h2", ["x", "a"])], schema)
    got = {(r.task, r.severity, r.detail) for r in relational.compatibility_report(old, new, ["name"]).collect()}
    assert got == {("step2", "breaking", None), ("step1", "breaking", "h1 -> h2"), ("step1", "warning", "a,x")}


def test_shorter_timeout_is_a_warning(spark):
    doc = lambda x: json.dumps({"tasks": [{"name": "a", "handler": "h"}], "timeout_ms": x})
    schema = "name STRING, document STRING"
    old = spark.createDataFrame([("w", doc(90_000)), ("x", doc({"value": 2, "unit": "m"})), ("y", doc(10)), ("z", doc("5"))], schema)
    new = spark.createDataFrame([("w", doc(None)), ("x", doc("30000")), ("y", doc(10)), ("z", doc(6))], schema)
    got = relational.timeout_warnings(*[graph.definition_timeouts(df, ["name"]) for df in (old, new)], ["name"])
    assert sorted(tuple(r) for r in got.collect()) == [("w", None, "warning", "timeout", "90000 -> 60000"), ("x", None, "warning", "timeout", "120000 -> 30000")]


def test_limits_of_run_inputs(spark):
    deep = lambda n: json.loads("[" * n + "]" * n)
    inputs = [deep(64), deep(65), "x" * ((1 << 20) - 2), "x" * ((1 << 20) - 1), None]
    texts = [*[json.dumps({"input": x}) for x in inputs], json.dumps(json.dumps({"input": deep(65)})), "{", None, '{"input":' + "[" * 100_000 + "]" * 100_000 + "}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, document STRING").coalesce(1)
    got = [r.e for r in df.select("id", scalars.input_errors()("document").alias("e")).orderBy("id").collect()]
    assert got == [None, "too_deep", None, "too_large", None, "too_deep", None, None, "too_deep"]


def test_consistency(spark, rows):
    r = spark.createDataFrame([(x, s) for x, s in zip("abcdef", ["failed", "succeeded", "running", "running", "failed", "succeeded"])], "id STRING, status STRING")
    t = spark.createDataFrame([("a", "t", "running"), ("b", "t", "pending"), ("d", "t", "succeeded"), ("e", "t", "skipped"), ("f", "t", "skipped")], "run_id STRING, task_name STRING, status STRING")
    assert rows(relational.consistency_errors(r, t)) == [("a", "terminal_with_running_task:t"), ("b", "succeeded_with_open_task:t"), ("c", "active_with_no_tasks"), ("d", "run_blocked"), ("e", "skipped_without_failure:t")]


# ------------------------------------------------------------------------------------------------------------- graphs


def test_graph_golden_cases():
    assert graph.topological_order({"b": [], "a": [], "c": []}) == ["a", "b", "c"]
    diamond = {"root": [], "l": ["root"], "r": ["root"], "leaf": ["l", "r"]}
    assert graph.topological_order(diamond)[0] == "root" and graph.waves(diamond) == {"root": 0, "l": 1, "r": 1, "leaf": 2}
    assert graph.critical_path(diamond) == ["root", "l", "leaf"]
    assert graph.graph_error({"a": ["ghost"], "b": ["b"]}) == "unknown:ghost" and graph.graph_error({"a": ["b"], "b": ["a"]}) == "cycle"
    chain = {"a": [], "b": ["a"], "c": ["b"]}
    assert graph.skip_closure(chain, {"a": "failed"}) == {"a": "failed", "b": "skipped", "c": "skipped"}
    assert graph.ready_tasks(chain, {"a": "succeeded"}) == ["b"] and graph.ready_tasks(chain, {"a": "failed"}) == ["a"]
    records = [{"name": "a", "input": "${tasks.a.output}"}, {"name": "b", "input": {"x": ["${ tasks.c.output.v } ${}"]}}]
    assert graph.reference_warnings(records, {"a": [], "b": ["a"]}) == [("a", "tasks.a.output", "self"), ("b", "tasks.c.output.v", "unreachable")]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 12), st.sets(st.integers(0, 12)), max_size=12))
def test_order_respects_dependencies(raw):
    g = {str(k): [str(x) for x in v if x in raw and x < k] for k, v in raw.items()}
    order = graph.topological_order(g)
    assert sorted(order) == sorted(g) and all(order.index(d) < order.index(t) for t in g for d in g[t])
    path, stage = graph.critical_path(g), graph.waves(g)
    assert len(path) == max(stage.values(), default=-1) + 1 and all(a in g[b] for a, b in zip(path, path[1:]))


def test_reports_and_errors(spark):
    def doc(**k):
        return json.dumps({"name": "ok", "tasks": [{"name": "a"}, {"name": "b", "needs": "a"}], "timeout_ms": 1, **k})

    docs = [("1", doc()), ("2", doc(name="Bad")), ("3", doc(tasks=[])), ("4", doc(tasks=[{"name": "a"}] * 2)), ("5", doc(timeout_ms=0)), ("6", doc(tasks=[{"name": "a", "needs": ["x"]}])), ("7", doc(tasks=[{"name": "a", "needs": ["a"]}])), ("8", None), ("9", "{"), ("10", doc(description="é" * 513))]
    df = spark.createDataFrame(docs, "id STRING, document STRING")
    assert {r.id: r.error for r in graph.definition_errors(df, ["id"]).collect()} == {"2": "invalid_name", "3": "empty_tasks", "4": "duplicate_task_name", "5": "zero_timeout", "6": "unknown", "7": "cycle", "10": "description_too_long"}
    reports = {r.id: r for r in graph.dry_runs(df, ["id"]).collect()}
    assert reports["1"].topo_order == "a,b" and reports["1"].n_stages == 2 and reports["6"].error == "unknown:x" and reports["3"].max_parallelism == 0


# ----------------------------------------------------------------------------------------------------- queues and folds

QUEUE = "run_id STRING, token STRING, due_at_ms BIGINT, lease_until_ms BIGINT, claimed_by STRING"


def test_queue_life(spark, rows):
    q = spark.createDataFrame([("a", "", 50, None, None), ("b", "tk", 50, 160, "dispatcher"), ("c", "", 50, None, None)], QUEUE)
    commands = spark.createDataFrame([("a", "t1"), ("a", "t0"), ("b", "t1")], "run_id STRING, command_token STRING")
    claimed = lifecycle.claim(q, commands, 60, 100)
    assert rows(claimed.select("run_id", "token", "lease_until_ms", "outcome")) == [("a", "t0", 160, "claimed"), ("b", "tk", 160, "lost"), ("c", "", None, "untouched")]
    assert rows(lifecycle.claim(q, commands, 200, 100, steal_expired=True).select("run_id", "outcome"))[1] == ("b", "claimed")
    held = claimed.drop("outcome")
    mine = spark.createDataFrame([("a", "t0"), ("b", "zz")], "run_id STRING, command_token STRING")
    assert rows(lifecycle.release(held, mine, 200).select("run_id", "token", "due_at_ms", "outcome")) == [("a", "", 200, "done"), ("b", "tk", 50, "lost"), ("c", "", 50, "untouched")]
    assert rows(lifecycle.fail_claim(held, mine).select("run_id", "due_at_ms", "lease_until_ms"))[0] == ("a", 50, None)
    assert rows(lifecycle.renew_lease(held, mine, 100, 30).select("run_id", "lease_until_ms", "outcome"))[0] == ("a", 130, "done")
    assert rows(lifecycle.renew_lease(held, mine, 160, 30).select("run_id", "outcome"))[0] == ("a", "lost")
    assert sorted(r.run_id for r in lifecycle.ack(held, mine).collect()) == ["b", "c"]
    assert rows(lifecycle.recover_expired(held, 160).select("run_id", "recovered")) == [("a", True), ("b", True), ("c", False)]
    new = spark.createDataFrame([("c", "", 9, None, None), ("d", "", 9, None, None), ("d", "", 8, None, None)], QUEUE)
    assert rows(lifecycle.enqueue(q, new).select("run_id", "outcome")) == [("a", "kept"), ("b", "kept"), ("c", "conflict"), ("c", "kept"), ("d", "conflict"), ("d", "inserted")]


def test_outbox_life(spark, rows):
    schema = "id STRING, attempts INT, max_attempts INT, next_attempt_at_ms BIGINT, status STRING"
    items = spark.createDataFrame([("a", 0, 2, 0, "pending"), ("b", 1, 2, 0, "pending"), ("c", 0, 2, 0, "pending"), ("d", 0, 2, 0, "delivered")], schema)
    results = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "id STRING, ok BOOLEAN")
    assert rows(lifecycle.outbox_after(items, results, 10_000, 500).select("id", "attempts", "next_attempt_at_ms", "status")) == [("a", 1, 10_500, "pending"), ("b", 2, 0, "dead_letter"), ("c", 0, 0, "delivered"), ("d", 0, 0, "delivered")]


def test_cancel_and_compare_and_set(spark, rows):
    r = spark.createDataFrame([("a", "running", None), ("b", "failed", 5)], "id STRING, status STRING, finished_at_ms BIGINT")
    assert rows(lifecycle.cancel_runs(r, r, 9)) == [("a", "cancelled", 9, True), ("b", "failed", 5, False)]
    now = spark.createDataFrame([("w", 1), ("x", 2), ("y", 3)], "name STRING, version INT")
    todo = spark.createDataFrame([("w", 1), ("x", 1), ("z", 1)], "name STRING, expected INT")
    assert rows(lifecycle.compare_and_set(now, todo, ["name"])) == [("w", 2, "updated"), ("x", 2, "conflict"), ("y", 3, "untouched"), ("z", None, "missing")]


def test_leaky_bucket_and_permits(spark):
    requests = spark.createDataFrame([("1", "k", 1000, 1.0), ("2", "k", 1000, 1.0), ("3", "k", 1000, 1.0), ("4", "k", 2000, 1.0), ("5", None, 0, 9.0)], "id STRING, key STRING, at_ms BIGINT, cost DOUBLE")
    got = {r.id: (r.accepted, r.wait_ms) for r in lifecycle.leaky_bucket(requests, "key", 2.0, 1.0).collect()}
    assert got == {"1": (True, 0), "2": (True, 0), "3": (False, 1000), "4": (True, 0), "5": (False, 7000)}
    events = spark.createDataFrame([(1, "a", "k", 1, "acquire"), (2, "b", "k", 2, "acquire"), (3, "b", "k", 3, "release"), (4, "a", "k", 4, "release"), (5, "b", "k", 5, "acquire")], "id INT, holder STRING, key STRING, at_ms BIGINT, action STRING")
    assert [r.granted for r in lifecycle.concurrency_limit(events, "key", 1).orderBy("id").collect()] == [True, False, False, True, True]


def test_hot_keys_leak_as_one_bucket(spark):
    """Ranges of a key, with pauses and without any, give what one walk over it gives."""
    pick = random.Random(4)
    data, want = [], {}
    for name, longest in (("dense", 2), ("paused", 40_000), ("one", 9_000), (None, 3)):
        at, level, last = 0, 0.0, None
        for i in range(700 if name != "one" else 1):
            at += pick.choice([0, 1, longest])
            cost = pick.choice([1.0, 1.0, 2.5, 9.0])
            level = max(0.0, level - (at - last if last is not None else 0) / 1000.0)
            accepted = level + cost <= 5.0
            want[f"{name}{i:04}"] = (accepted, 0 if accepted else max(1, math.ceil((level + cost - 5.0) * 1000.0)))
            level, last = level + cost * accepted, at
            data.append((f"{name}{i:04}", name, at, cost))
    data += [("late", "dense", None, 1.0), ("free", "dense", 5, None)]
    df = spark.createDataFrame(data, "id STRING, k STRING, at_ms BIGINT, cost DOUBLE")
    got = {r.id: (r.accepted, r.wait_ms) for r in lifecycle.leaky_bucket(df, "k", 5.0, 1.0).collect()}
    assert got == want | {"late": (None, None), "free": (None, None)}
    assert lifecycle.leaky_bucket(df.limit(0), "k", 5.0, 1.0).count() == 0


def test_every_end_of_a_run_releases_its_permit(spark):
    kinds = ["run.started", "run.timed_out", "RUN.STARTED", "run.cancelled", "Run.Started", "RUN.FAILED", "run.started", "run.paused", None]
    events = spark.createDataFrame([(i, f"r{i // 2}", "t", i, k) for i, k in enumerate(kinds)], "seq BIGINT, run_id STRING, tenant STRING, created_at_ms BIGINT, kind STRING")
    got = lifecycle.concurrency_limit(lifecycle.permit_events(events), "tenant", 1).orderBy("id").collect()
    assert [(r.action, r.granted) for r in got] == [("acquire", True), ("release", True)] * 3 + [("acquire", True)]


def test_attempts(spark):
    doc = json.dumps({"tasks": [{"name": "a", "handler": "x.ok"}, {"name": "b", "handler": "x.bad", "depends_on": ["a"]}, {"name": "c", "handler": "x.ok", "depends_on": ["b"]}], "retry": {"max_attempts": 2}})
    df = spark.createDataFrame([("1", doc, None, 0, False), ("2", doc, None, 1, False), ("3", doc, '{"b": "succeeded"}', 0, False), ("4", doc, None, 0, True), ("5", None, None, 0, False)], "id STRING, document STRING, states STRING, attempts INT, overdue BOOLEAN")
    got = {r.id: tuple(r)[1:4] for r in lifecycle.simulate_attempts(df, lambda h: h.endswith("bad")).collect()}
    assert got == {"1": ("queued", "b", "release"), "2": ("failed", "b", "ack"), "3": ("succeeded", "", "ack"), "4": ("timedout", "", "ack"), "5": ("definition_lost", "", "ack")}


def test_attempts_of_tasks(spark):
    # b may be tried 5 times in all, of its own; c has the definition's 3.
    doc = json.dumps({"tasks": [{"name": "b", "handler": "x.bad", "retry": {"tries": 5}}, {"name": "c", "handler": "x.ok"}], "retry": {"max_attempts": 3}})
    once = json.dumps({"tasks": [{"name": "b", "handler": "x.bad", "retry": {"max_attempts": 1}}], "retry": {"max_attempts": 3}})
    runs = spark.createDataFrame([("1", doc, 0), ("2", doc, 0), ("3", doc, 0), ("4", once, 0), ("5", doc, 2)], "id STRING, document STRING, attempts INT").withColumn("overdue", F.lit(False))
    tasks = spark.createDataFrame([("1", "b", "failed", 3), ("2", "b", "failed", 4), ("3", "c", "failed", 3), ("5", "c", "failed", 2), ("5", "b", "succeeded", 1)], "run_id STRING, task_name STRING, status STRING, attempts INT")
    done = lifecycle.simulate_attempts(graph.run_states(runs, tasks.withColumn("last_error", F.concat(F.lit("no "), "task_name"))), lambda h: h.endswith("bad")).collect()
    got = {r.id: tuple(r)[1:4] for r in done}
    # 2 and 4 failed now, c of 3 before; 1 waits for the first delay of the default policy.
    assert {r.id: tuple(r)[4:] for r in done} == {
        "1": (1000, None, None), "2": (None, "b", "x.bad failed"), "3": (None, "b", "x.bad failed"), "4": (None, "b", "x.bad failed"), "5": (None, None, None)
    }
    # 2 uses up b's last one, c of 3 is not run again, 4 has one try by its own retry, and c of 5 runs once more and succeeds.
    assert got == {"1": ("queued", "b", "release"), "2": ("failed", "b", "ack"), "3": ("failed", "b,c", "ack"), "4": ("failed", "b", "ack"), "5": ("succeeded", "", "ack")}


# ----------------------------------------------------------------------------------------------------- files and streams


def test_audit_log_survives_bad_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_audit_log(spark.createDataFrame([(1, "x")], "seq BIGINT, id STRING"), path)
    files.append_audit_log(spark.createDataFrame([(2, "y")], "seq BIGINT, id STRING"), path)
    (tmp_path / "log" / "more.json").write_text('\n{"seq": 3, "id": "z"}\n{broken\n')
    assert [r.id for r in files.read_audit_log(spark, path).orderBy(F.desc("seq")).collect()] == ["z", "y", "x"]


def test_specs_and_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tenant": "t", "name": "n",\n "timeoutMs": 5, "tasks": [{"name": "x"}]}')
    spec = files.read_workflow_specs(spark, str(tmp_path / "a.json")).first()
    assert (spec.version, spec.timeout_ms, spec.default_priority) == (1, 5, "normal")
    blobs = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content BINARY")
    files.write_artifacts(blobs, str(tmp_path / "blobs"))
    assert files.read_artifacts(spark, str(tmp_path / "blobs")).count() == 2
    text = files.metrics_text(spark.createDataFrame([("n", "gauge", "h", None, "1")], "name STRING, kind STRING, help STRING, label STRING, value STRING"), "p")
    assert [r.line for r in text.orderBy("line_no").collect()] == ["# HELP p_n h", "# TYPE p_n gauge", "p_n 1"]


def test_streams(spark, tmp_path, rows):
    path = str(tmp_path / "runs")
    data = [("a", "done", "succeeded", 1000, 1100, "t", "d"), ("b", "x", "failed", 1000, 1200, "t", "d"), ("c", "x", "running", 1500, None, "t", "d"), ("d", "x", "running", 900, None, "t", "d")]
    spark.createDataFrame(data, "id STRING, x STRING, status STRING, started_at_ms BIGINT, finished_at_ms BIGINT, tenant STRING, def_name STRING").write.parquet(path)
    changed = pipelines.drain(pipelines.change_events(pipelines.read_stream(spark, path), 1000, 1000), "changes")
    assert [(r.run_id, r.kind) for r in changed.orderBy("phase", "at_ms", "run_id").collect()] == [("c", "run.started"), ("a", "run.succeeded"), ("b", "run.failed")]
    requests = pipelines.read_stream(spark, path).select("id", F.col("tenant").alias("key"), F.col("started_at_ms").alias("at_ms"), F.lit(1.0).alias("cost"))
    assert {r.id: r.accepted for r in pipelines.drain(pipelines.limited_stream(requests, 2.0, 0.001), "limited").collect()} == {"d": True, "a": True, "b": False, "c": False}
    sent = []
    pipelines.deliver(pipelines.read_stream(spark, path), lambda df: (sent.extend(ids(df)), df)[1], str(tmp_path / "sent")).awaitTermination()
    assert sorted(sent) == list("abcd")


def test_first_error_of_a_definition():
    """In the order of the checks: a broken rule hides those that are looked at behind it."""
    first = lambda **more: graph.definition_error({"name": "ok", "tasks": [{"name": "a"}], **more})
    cycle = [{"name": "a", "depends_on": ["b"]}, {"name": "b", "depends_on": ["a"]}]
    bad_hook = {"on_cancel": [{"webhook_url": "ftp://a.example"}]}
    assert first() is None and first(name="Bad") == "invalid_name" and first(tasks=[]) == "empty_tasks"
    assert first(tasks=cycle, timeout_ms=0) == "cycle"
    assert first(timeout_ms=0, hooks=bad_hook) == "zero_timeout" and first(hooks=bad_hook) == "invalid_hook_url"
    assert first(tasks=[{"name": "a" * 65, "retry": {"max_attempts": 0}}]) == "task_name_too_long"
    assert first(tasks=[{"name": "a", "retry": {"max_attempts": 101}}, {"name": "b", "timeout_ms": 0}]) == "invalid_policy"
    assert first(tasks=[{"name": "a", "timeout_ms": 0, "depends_on": ["no"]}]) == "zero_timeout"
    assert first(tasks=[{"name": "a", "retry": {"max_delay_ms": 86_400_001}}]) == "invalid_policy"
    assert first(hooks={"on_start": [{"webhook_url": "https://u@a.example:1/x"}, {}]}) is None


def test_a_command_is_matched_by_its_token(spark):
    entries = spark.createDataFrame([("r", "m", 1, 99, "x"), ("free", "", 1, None, None), ("other", "k", 1, 99, "x")], "run_id STRING, token STRING, due_at_ms BIGINT, lease_until_ms BIGINT, claimed_by STRING")
    commands = spark.createDataFrame([("r", "a"), ("r", "m"), ("free", "c"), ("free", "b"), ("other", "a"), ("other", None)], "run_id STRING, command_token STRING")
    of = lambda df: {r.run_id: (r.outcome, r.token) for r in df.collect()}
    assert of(lifecycle.release(entries, commands, 50)) == {"r": ("done", ""), "free": ("lost", ""), "other": ("lost", "k")}
    assert of(lifecycle.claim(entries, commands, 5, 10)) == {"r": ("claimed", "m"), "free": ("claimed", "b"), "other": ("lost", "k")}


def test_polls_of_the_watcher(spark):
    rows_ = [("a", "running", 10, None, "w"), ("b", "failed", 5, 20, "w"), ("c", "succeeded", 15, 20, "gone"), ("d", "running", 30, None, "w"), ("e", "queued", None, None, "w")]
    runs_ = spark.createDataFrame([(*r, "t") for r in rows_], "id STRING, status STRING, started_at_ms BIGINT, finished_at_ms BIGINT, def_name STRING, tenant STRING")
    defs = spark.createDataFrame([("t", "w", 1), ("t", "w", 2)], "tenant STRING, name STRING, version INT")
    polled = relational.watch_poll(runs_, defs, 9, 0)
    assert [(r.run_id, r.dispatched) for r in polled.orderBy("turn").collect()] == [("a", True), ("d", True), ("b", True), ("c", False)]
    now = relational.watch_cursors(polled, 9, 0).first()
    assert tuple(now) == (30, 20, 2, 2, 3, 1)
    # The next poll begins where this one ended, and one without changes leaves the cursors.
    again = relational.watch_poll(runs_, defs, now.started_ms, now.finished_ms)
    assert again.count() == 0 and tuple(relational.watch_cursors(again, 30, 20).first())[:2] == (30, 20)


def test_enqueue_keeps_what_is_there(spark, rows):
    items = spark.createDataFrame([("a", "dead_letter")], "id STRING, status STRING")
    new = spark.createDataFrame([("a", 1), ("b", 5), ("b", 3), (None, 4)], "id STRING, seq BIGINT")
    assert rows(lifecycle.outbox_enqueue(items, new, 0, 7)) == [("b", 3, 0, 1, 7, "pending")]


def test_late_events(spark):
    at = lambda h: f"2027-01-01 {h:02}:00:00"
    data = [(i, at(h), "K") for i, h in enumerate([1, 5, 2, 6, 5, 9, 1, 9])]
    df = spark.createDataFrame(data, "seq BIGINT, t STRING, kind STRING").selectExpr("seq", "kind", "CAST(t AS TIMESTAMP_NTZ) AS received_at")
    assert pipelines.too_late(df, 2 * 3600).first().n == 2 and pipelines.too_late(df.limit(0), 1).first().n == 0
