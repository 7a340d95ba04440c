"""Queries over runs, tasks, definitions, audit records, queues and artifacts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import cron, scalars
from weftline.functions.expressions import Context, Literal, Op, Variable, compile_expression, render_template
from weftline.functions.handlers import http_outcome, webhook_outcome, with_builtins
from weftline.operators import filters, graph, lifecycle, relational, structural
from weftline.operators.filters import AuditFilter, RunFilter
from weftline.plans import catalogue as c
from weftline.plans.catalogue import NOW_MS, Catalogue
from weftline.session import shared_folder, stored, table
from weftline.sources import files
from weftline.streaming import pipelines

own = Catalogue()
QUERIES, SQL = own.queries, own.sql
DEF_KEY = ["tenant", "name", "version"]

# ------------------------------------------------------------------------------------------------------ run filters

_FILTERS = {
    "name": (RunFilter(name="ledger-compact"), "def_name = 'ledger-compact'"),
    "prefix": (RunFilter(name_prefix="nightly"), "starts_with(def_name, 'nightly')"),
    "status": (RunFilter(status="failed"), "status = 'failed'"),
    "status_in": (RunFilter(status_in=("failed", "timedout")), "status IN ('failed', 'timedout')"),
    "tenant": (RunFilter(tenant="harbor-grid"), "tenant = 'harbor-grid'"),
    "tags": (RunFilter(tags={"team": "kelp"}), "tags['team'] = 'kelp'"),
    "has_tag_keys": (RunFilter(has_tag_keys=("env", "team")), "map_contains(tags, 'env') AND map_contains(tags, 'team')"),
    "created_range": (RunFilter(from_ms=1_806_000_000_000, to_ms=1_808_000_000_000), "created_at_ms >= 1806000000000 AND created_at_ms < 1808000000000"),
    "finished_range": (RunFilter(finished_from_ms=1_806_000_000_000, finished_to_ms=1_808_000_000_000), "finished_at_ms BETWEEN 1806000000000 AND 1808000000000"),
    "min_duration": (RunFilter(min_duration_ms=60_000), "finished_at_ms - started_at_ms >= 60000"),
    "combined": (
        RunFilter(tenant="harbor-grid", status_in=("failed", "succeeded"), name_prefix="ledger", from_ms=1_805_000_000_000, min_duration_ms=1000),
        "tenant = 'harbor-grid' AND status IN ('failed', 'succeeded') AND starts_with(def_name, 'ledger') AND created_at_ms >= 1805000000000 AND finished_at_ms - started_at_ms >= 1000",
    ),
}
for _name, (_filter, _where) in _FILTERS.items():
    own.add(f"run_filter_{_name}", f"SELECT DISTINCT id, created_at_ms FROM runs WHERE {_where}")(
        lambda s, d, f=_filter: f.apply(table(s, d, "runs")).select("id", "created_at_ms").distinct()
    )


@own.add("runs_page", "SELECT id, created_at_ms, status FROM cur_runs WHERE status IN ('failed', 'timedout') ORDER BY created_at_ms DESC, id LIMIT 100 OFFSET 50")
def runs_page(s, d):
    return RunFilter(status_in=("failed", "timedout"), limit=100, offset=50).page(c.current_runs(s, d, "created_at_ms", "status"))


@own.add("runs_count", "SELECT count(*) AS n FROM cur_runs WHERE status = 'succeeded'")
def runs_count(s, d):
    return RunFilter(status="succeeded").apply(c.current_runs(s, d, "status")).agg(F.count("*").alias("n"))


@own.add("run_lookup", "SELECT id, tenant, status FROM cur_runs WHERE id = (SELECT min(id) FROM runs WHERE deleted_at IS NULL)")
def run_lookup(s, d):
    least = table(s, d, "runs").where("deleted_at IS NULL").agg(F.min("id").alias("id"))
    return c.current_runs(s, d, "tenant", "status").join(F.broadcast(least), "id")  # one row


@own.add("workflows_list", "SELECT tenant, name, version FROM cur_defs ORDER BY tenant, name")
def workflows_list(s, d):
    return c.current_definitions(s, d).orderBy("tenant", "name")


@own.add("workflow_lookup", "SELECT tenant, name, version FROM cur_defs WHERE tenant = 'harbor-grid' AND name = (SELECT min(name) FROM cur_defs WHERE tenant = 'harbor-grid')")
def workflow_lookup(s, d):
    own_ = c.current_definitions(s, d).where(F.col("tenant") == "harbor-grid")
    return own_.join(F.broadcast(own_.agg(F.min("name").alias("name"))), "name").select("tenant", "name", "version")  # one row


@own.add("task_runs_of_run", "SELECT task_name, status, attempts FROM cur_tasks WHERE run_id = (SELECT min(run_id) FROM task_runs WHERE starts_with(run_id, 'rn_')) ORDER BY task_name")
def task_runs_of_run(s, d):
    run = table(s, d, "task_runs").where("startswith(run_id, 'rn_')").agg(F.min("run_id").alias("run_id"))
    rows = c.current_tasks(s, d, "run_id", "task_name", "status", "attempts").join(F.broadcast(run), "run_id")  # one row
    return rows.orderBy("task_name").select("task_name", "status", "attempts")


@own.add("workflows_by_tenant", "SELECT tenant, name, version FROM cur_defs WHERE tenant = 'harbor-grid'")
def workflows_by_tenant(s, d):
    return c.current_definitions(s, d).where(F.col("tenant") == "harbor-grid")


@own.add("task_runs_of_failed", "SELECT t.run_id, t.task_name, t.status FROM cur_tasks t JOIN cur_runs r ON t.run_id = r.id WHERE r.status = 'failed'")
def task_runs_of_failed(s, d):
    runs = c.current_runs(s, d, "status").where("status = 'failed'").select(F.col("id").alias("run_id"))
    return c.current_tasks(s, d, "run_id", "task_name", "status").join(runs, "run_id").select("run_id", "task_name", "status")


@own.add("audit_page", "SELECT seq, timestamp_ms, action_name FROM audit_log WHERE tenant = 't1' AND actor_kind = 'user' ORDER BY seq DESC LIMIT 50 OFFSET 10")
def audit_page(s, d):
    return AuditFilter(tenant="t1", actor_kind="user", offset=10).page(c.audit_log(s, d)).select("seq", "timestamp_ms", "action_name")


@own.add("audit_count", "SELECT count(*) AS n FROM audit_log WHERE action_name = 'error' AND status = 'denied' AND resource_type = 'run' AND timestamp_ms BETWEEN 1704400000000 AND 1706000000000")
def audit_count(s, d):
    f = AuditFilter(action_name="error", status="denied", resource_type="run", since_ms=1_704_400_000_000, until_ms=1_706_000_000_000)
    return c.audit_log(s, d).where(f.condition()).agg(F.count("*").alias("n"))


@own.add("audit_by_resource", "SELECT seq FROM audit_log WHERE resource_id = '42'")
def audit_by_resource(s, d):
    return c.audit_log(s, d).where(AuditFilter(resource_id="42").condition()).select("seq")


@own.add("ring_tail", "SELECT seq FROM audit_log ORDER BY seq DESC LIMIT 1000")
def ring_tail(s, d):
    return filters.ring_tail(c.audit_log(s, d).select("seq"), 1000)


@own.add("queue_ready", f"SELECT run_id, due_at_ms FROM queue_entries WHERE due_at_ms <= {NOW_MS} AND (lease_until_ms IS NULL OR lease_until_ms <= {NOW_MS})")
def queue_ready(s, d):
    return filters.queue_ready(c.queue_entries(s, d), NOW_MS).select("run_id", "due_at_ms")


@own.add("queue_scan", f"SELECT run_id, due_at_ms FROM queue_entries WHERE due_at_ms <= {NOW_MS} AND (lease_until_ms IS NULL OR lease_until_ms <= {NOW_MS}) ORDER BY due_at_ms, run_id LIMIT 128")
def queue_scan(s, d):
    return filters.scan_ready(c.queue_entries(s, d), NOW_MS, 128).select("run_id", "due_at_ms")


@own.add("queue_expired", f"SELECT run_id FROM queue_entries WHERE lease_until_ms <= {NOW_MS}")
def queue_expired(s, d):
    return filters.expired_leases(c.queue_entries(s, d), NOW_MS).select("run_id")


@own.add("outbox_ready", f"SELECT id, next_attempt_at_ms FROM outbox WHERE status = 'pending' AND next_attempt_at_ms <= {NOW_MS}")
def outbox_ready(s, d):
    return filters.outbox_ready(c.outbox(s, d), NOW_MS).select("id", "next_attempt_at_ms")


@own.add("outbox_dead", "SELECT id, attempts FROM outbox WHERE status = 'dead_letter'")
def outbox_dead(s, d):
    return c.outbox(s, d).where("status = 'dead_letter'").select("id", "attempts")


@own.add("overdue_runs", f"SELECT id FROM cur_runs WHERE status IN ('queued', 'running') AND deadline_at_ms < {NOW_MS}")
def overdue_runs(s, d):
    runs = c.current_runs(s, d, "status", "deadline_at_ms")
    return runs.where(F.col("status").isin("queued", "running") & (F.col("deadline_at_ms") < NOW_MS)).select("id")


# --------------------------------------------------------------------------------- joins, aggregates, windows, sets


@own.add(
    "workflow_summary",
    """SELECT w.tenant, w.name, w.version, count(r.id) AS run_count, arg_max(r.id, (r.created_at_ms, r.id)) AS latest_run,
       arg_max(r.status, (r.created_at_ms, r.id)) AS latest_status, max(r.created_at_ms) AS latest_created_ms
       FROM cur_defs w LEFT JOIN cur_runs r ON w.tenant = r.tenant AND w.name = r.def_name GROUP BY 1, 2, 3""",
)
def workflow_summary(s, d):
    return relational.workflow_summary(c.current_definitions(s, d), c.current_runs(s, d, "tenant", "def_name", "created_at_ms", "status"))


@own.add(
    "latest_run",
    "SELECT tenant, def_name, id, status FROM (SELECT *, row_number() OVER (PARTITION BY tenant, def_name ORDER BY created_at_ms DESC, id DESC) AS r FROM cur_runs) WHERE r = 1",
)
def latest_run(s, d):
    runs = c.current_runs(s, d, "tenant", "def_name", "created_at_ms", "status")
    newest = F.max(F.struct("created_at_ms", "id", "status")).alias("n")
    return runs.groupBy("tenant", "def_name").agg(newest).select("tenant", "def_name", "n.id", "n.status")


_BUCKET = "CASE WHEN status IN ('succeeded', 'running', 'queued') THEN status ELSE 'failed' END"


@own.add("status_distribution", f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM cur_runs GROUP BY 1")
def status_distribution(s, d):
    return relational.status_distribution(c.current_runs(s, d, "status"))


@own.add(
    "status_bar",
    f"""SELECT bucket, n, round(pct, 4) AS pct, bar, coalesce(sum(bar) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM (
        SELECT bucket, n, n * 100.0::DOUBLE / sum(n) OVER () AS pct, round(n * 100.0::DOUBLE / sum(n) OVER () * 8)::BIGINT AS bar,
               CASE bucket WHEN 'succeeded' THEN 0 WHEN 'running' THEN 1 WHEN 'queued' THEN 2 ELSE 3 END AS place
        FROM (SELECT {_BUCKET} AS bucket, count(*) AS n FROM cur_runs GROUP BY 1))""",
)
def status_bar(s, d):
    return relational.status_bar(c.current_runs(s, d, "status"))


@own.add("gauges", "SELECT (SELECT count(*) FROM cur_runs) AS runs, (SELECT count(*) FROM cur_defs) AS workflows, (SELECT count(*) FROM queue_entries) AS queue_depth, 86400::BIGINT AS uptime_seconds")
def gauges(s, d):
    return relational.gauges(c.current_runs(s, d), c.current_definitions(s, d), c.queue_entries(s, d), NOW_MS - 86_400_000, NOW_MS)


@own.add("outbox_stats", "SELECT count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'delivered')::BIGINT AS delivered, count_if(status = 'dead_letter')::BIGINT AS dead_letter FROM outbox")
def outbox_stats(s, d):
    return c.outbox(s, d).agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("pending", "delivered", "dead_letter")])


_BOUNDS = "[0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]"


@own.add(
    "duration_histogram",
    f"""SELECT b::DOUBLE::VARCHAR AS le, (SELECT count(*) FROM cur_runs WHERE finished_at_ms >= started_at_ms AND (finished_at_ms - started_at_ms) / 1000.0::DOUBLE <= b) AS n
        FROM (SELECT unnest({_BOUNDS}) AS b) UNION ALL SELECT '+Inf', count(*) FROM cur_runs WHERE finished_at_ms >= started_at_ms""",
)
def duration_histogram(s, d):
    runs = c.current_runs(s, d, "started_at_ms", "finished_at_ms")
    return relational.cumulative_histogram(runs, (F.col("finished_at_ms") - F.col("started_at_ms")) / 1000)


@own.add("run_counters", "SELECT count(*) AS submitted, count_if(status = 'cancelled')::BIGINT AS cancelled, count_if(status IN ('succeeded', 'failed', 'cancelled', 'timedout'))::BIGINT AS terminals, sum(attempts)::BIGINT AS attempts FROM cur_runs")
def run_counters(s, d):
    return c.current_runs(s, d, "status", "attempts").agg(
        F.count("*").alias("submitted"), F.count_if(F.col("status") == "cancelled").alias("cancelled"),
        F.count_if(F.col("status").isin(*filters.TERMINAL_RUN)).alias("terminals"), F.sum("attempts").alias("attempts"),
    )


@own.add("run_numbers", "SELECT id, def_name, row_number() OVER (PARTITION BY def_name ORDER BY created_at_ms, id) AS number FROM cur_runs")
def run_numbers(s, d):
    return relational.run_numbers(c.current_runs(s, d, "def_name", "created_at_ms"))


@own.add(
    "fair_share_order",
    """SELECT run_id, tenant, row_number() OVER (PARTITION BY tenant ORDER BY seq) AS turn, min(seq) OVER (PARTITION BY tenant) AS tenant_first
       FROM (SELECT q.run_id, r.tenant, r.created_at_ms || q.run_id AS seq FROM queue_entries q JOIN cur_runs r ON q.run_id = r.id)""",
)
def fair_share_order(s, d):
    items = c.queue_entries(s, d).join(c.current_runs(s, d, "tenant", "created_at_ms"), F.col("run_id") == F.col("id"))
    seq = F.concat(F.col("created_at_ms").cast("string"), "run_id").alias("seq")
    return relational.fair_share_order(items.select("run_id", "tenant", seq)).drop("seq")


_KIND = "CASE status WHEN 'succeeded' THEN 'run.succeeded' WHEN 'failed' THEN 'run.failed' WHEN 'timedout' THEN 'run.timed_out' WHEN 'cancelled' THEN 'run.cancelled' END"


@own.add("event_docs", f"""SELECT {_KIND} AS kind, id AS run_id, tenant, def_name, def_version, run_number, status, started_at_ms, finished_at_ms, attempts, error.message AS error,
       CASE WHEN status = 'succeeded' AND json_valid(doc_text) THEN json_exists(doc_text::JSON, '$.output') AND json_type(doc_text::JSON, '$.output') <> 'NULL' ELSE false END AS has_output, {NOW_MS}::BIGINT AS created_at_ms
       FROM run_docs WHERE status IN ('succeeded', 'failed', 'timedout', 'cancelled')""")
def event_docs(s, d):
    """Events of all runs that are over; whether they have an output stands for it, as its text is written in many ways."""
    columns = "tenant def_name def_version run_number status started_at_ms finished_at_ms attempts error".split()
    docs = relational.event_documents(c.run_documents(s, d, *columns), NOW_MS)
    return docs.withColumn("has_output", F.col("output").isNotNull()).drop("output")


@own.add("delivery_ids", f"SELECT id, sha256(tenant || '/' || def_name || '/' || id || '/' || {_KIND}) AS delivery_id FROM cur_runs WHERE status IN ('succeeded', 'failed', 'timedout', 'cancelled')")
def delivery_ids(s, d):
    runs = c.current_runs(s, d, "tenant", "def_name", "status").where(F.col("status").isin(*relational.EVENT_KINDS))
    kinds = F.create_map(*[F.lit(x) for p in relational.EVENT_KINDS.items() for x in p])
    return runs.select("id", relational.delivery_id(F.col("tenant"), F.col("def_name"), F.col("id"), kinds[F.col("status")]).alias("delivery_id"))


@own.add("terminal_kinds", f"SELECT {_KIND} AS kind, count(*) AS n FROM cur_runs WHERE status IN ('succeeded', 'failed', 'timedout', 'cancelled') GROUP BY 1")
def terminal_kinds(s, d):
    runs = c.current_runs(s, d, "status").where(F.col("status").isin(*relational.EVENT_KINDS))
    kinds = F.create_map(*[F.lit(x) for p in relational.EVENT_KINDS.items() for x in p])
    return runs.groupBy(kinds[F.col("status")].alias("kind")).agg(F.count("*").alias("n"))


def _all_hooks(documents):
    """(tenant, name, version, list_name, i, event_filter, webhook_url, headers) of the hooks of each definition, all four
    lists one behind the other; headers are the names of its headers."""

    def rows(_, __, value):
        for list_name, i, h in graph.hooks_of(value):
            headers = h.get("headers")
            yield list_name, i, h.get("event_filter"), graph.hook_url(h), ",".join(sorted(headers)) if isinstance(headers, dict) else ""

    return graph.per_definition(documents, DEF_KEY, rows, "list_name STRING, i INT, event_filter STRING, webhook_url STRING, headers STRING").distinct()


def _hook_list(name: str) -> str:
    names = ", ".join(f"nullif(h->'$.{k}', 'null')" for k in graph.HOOK_NAMES[name])
    return f"""SELECT '{name}' AS list_name, tenant, name, version, key::INT AS i, value->>'$.event_filter' AS event_filter,
  coalesce(value->>'$.webhook_url', value->>'$.url', value->>'$.endpoint') AS webhook_url,
  coalesce(array_to_string(list_sort(json_keys(CASE json_type(value->'$.headers') WHEN 'OBJECT' THEN value->'$.headers' END)), ','), '') AS headers
  FROM (SELECT tenant, name, version, CASE json_type(f) WHEN 'OBJECT' THEN json_array(f) ELSE f END AS f FROM (
    SELECT tenant, name, version, coalesce({names}) AS f
    FROM (SELECT *, coalesce(nullif(doc::JSON->'$.hooks', 'null'), doc::JSON->'$.notifications') AS h FROM defs_read WHERE json_valid(doc))) WHERE json_type(f) IN ('OBJECT', 'ARRAY')), json_each(f)"""


_HOOKS = " UNION ALL ".join(_hook_list(n) for n in graph.HOOK_NAMES)
_LIST_KINDS = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}')" for k, n in relational.HOOK_LISTS.items()) + ") AS k(list_name, kind)"
_STARTED = f"CASE status WHEN 'running' THEN 'run.started' ELSE {_KIND} END"


@own.add(
    "hook_matches",
    f"""SELECT DISTINCT tenant, name, version, list_name, kind, i, CASE WHEN event_filter IS NOT NULL AND event_filter NOT IN (kind, substr(kind, 5)) THEN 'filtered'
        WHEN webhook_url IS NULL THEN 'no_url' ELSE 'matched' END AS outcome FROM ({_HOOKS}) JOIN ({_LIST_KINDS}) USING (list_name)""",
)
def hook_matches(s, d):
    """Every hook of all four lists for every kind of event its list serves."""
    return relational.hooks_by_kind(_all_hooks(table(s, d, "workflows"))).select(*DEF_KEY, "list_name", "kind", "i", "outcome")


@own.add("hook_list", f"SELECT DISTINCT tenant, name, version, list_name, i, webhook_url FROM ({_HOOKS})")
def hook_list(s, d):
    """All hooks of each definition, whatever starts them."""
    return _all_hooks(table(s, d, "workflows")).select(*DEF_KEY, "list_name", "i", "webhook_url").distinct()


@own.add(
    "match_counters",
    f"""SELECT kind, count_if(outcome = 'matched')::BIGINT AS matched, count_if(outcome = 'filtered')::BIGINT AS filtered, count_if(outcome = 'no_url')::BIGINT AS no_url FROM (
        SELECT kind, CASE WHEN event_filter IS NOT NULL AND event_filter NOT IN (kind, substr(kind, 5)) THEN 'filtered' WHEN webhook_url IS NULL THEN 'no_url' ELSE 'matched' END AS outcome
        FROM (SELECT DISTINCT * FROM ({_HOOKS})) JOIN ({_LIST_KINDS}) USING (list_name)) GROUP BY 1""",
)
def match_counters(s, d):
    matched = relational.hooks_by_kind(_all_hooks(table(s, d, "workflows")))
    return matched.groupBy("kind").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("matched", "filtered", "no_url")])


_TOLD = "tenant def_name def_version status started_at_ms finished_at_ms attempts error".split()


@own.add(
    "deliveries",
    f"""SELECT r.id AS run_id, r.kind, sha256(r.tenant || '/' || r.def_name || '/' || r.id || '/' || r.kind) AS id, h.webhook_url AS url, h.headers,
          to_json({{'kind': r.kind, 'run_id': r.id, 'tenant': r.tenant, 'def_name': r.def_name, 'def_version': r.def_version, 'status': r.status,
            'started_at_ms': r.started_at_ms, 'finished_at_ms': r.finished_at_ms, 'attempts': r.attempts, 'error': r.error.message}})::VARCHAR AS body
        FROM (SELECT *, {_STARTED} AS kind FROM cur_runs) r JOIN (SELECT DISTINCT * FROM ({_HOOKS}) JOIN ({_LIST_KINDS}) USING (list_name)) h
        ON r.tenant = h.tenant AND r.def_name = h.name AND r.def_version = h.version AND r.kind = h.kind
        WHERE h.webhook_url IS NOT NULL AND (h.event_filter IS NULL OR h.event_filter IN (r.kind, substr(r.kind, 5)))""",
)
def deliveries(s, d):
    runs = c.current_runs(s, d, *_TOLD).withColumns({"name": F.col("def_name"), "version": F.col("def_version")})
    return relational.run_deliveries(runs, _all_hooks(table(s, d, "workflows")), DEF_KEY)


@own.add(
    "watch_poll",
    f"""SELECT row_number() OVER (ORDER BY phase, at_ms, run_id) AS turn, * FROM (
        SELECT CASE WHEN r.status = 'running' THEN 0 ELSE 1 END AS phase, CASE WHEN r.status = 'running' THEN started_at_ms ELSE finished_at_ms END AS at_ms, r.id AS run_id,
          {_STARTED.replace("status", "r.status")} AS kind, w.name IS NOT NULL AS dispatched
        FROM cur_runs r LEFT JOIN cur_defs w ON w.tenant = r.tenant AND w.name = r.def_name
        WHERE (r.status = 'running' AND started_at_ms > 1808000000000) OR (r.status IN ('succeeded', 'failed', 'timedout', 'cancelled') AND finished_at_ms > 1809000000000))""",
)
def watch_poll(s, d):
    """One poll: starts before ends, each in order; runs whose definition is gone are dropped, with a count (watch_cursors)."""
    runs = c.current_runs(s, d, "tenant", "def_name", "status", "started_at_ms", "finished_at_ms")
    return relational.watch_poll(runs, c.current_definitions(s, d), 1_808_000_000_000, 1_809_000_000_000)


@own.add(
    "watch_cursors",
    """SELECT max(CASE WHEN phase = 0 THEN at_ms END) AS started_ms, max(CASE WHEN phase = 1 THEN at_ms END) AS finished_ms, count_if(phase = 0)::BIGINT AS started, count_if(phase = 1)::BIGINT AS finished,
         count_if(hit)::BIGINT AS dispatched, count_if(NOT hit)::BIGINT AS dropped FROM (
        SELECT CASE WHEN r.status = 'running' THEN 0 ELSE 1 END AS phase, CASE WHEN r.status = 'running' THEN started_at_ms ELSE finished_at_ms END AS at_ms, w.name IS NOT NULL AS hit
        FROM cur_runs r LEFT JOIN cur_defs w ON w.tenant = r.tenant AND w.name = r.def_name
        WHERE (r.status = 'running' AND started_at_ms > 1808000000000) OR (r.status IN ('succeeded', 'failed', 'timedout', 'cancelled') AND finished_at_ms > 1809000000000))""",
)
def watch_cursors(s, d):
    return relational.watch_cursors(watch_poll(s, d), 1_808_000_000_000, 1_809_000_000_000)


@own.add(
    "snapshot_tasks",
    """SELECT r.id, r.status, string_agg(t.task_name || ':' || t.status || ':' || t.attempts || ':' || coalesce(t.last_error, ''), ',' ORDER BY t.task_name, t.id) AS tasks
       FROM cur_runs r LEFT JOIN cur_tasks t ON t.run_id = r.id GROUP BY 1, 2""",
)
def snapshot_tasks(s, d):
    """Runs with the list of their tasks, written in one text."""
    taken = relational.snapshot_tasks(c.current_runs(s, d, "status"), c.current_tasks(s, d, "run_id", "task_name", "status", "attempts", "last_error"))
    line = lambda t: F.concat_ws(":", t["task_name"], t["task_status"], t["attempts"].cast("string"), F.coalesce(t["last_error"], F.lit("")))
    return taken.select("id", "status", F.array_join(F.transform("tasks", line), ",").alias("tasks"))


@own.add(
    "snapshots",
    """SELECT r.id, r.status, count(t.id) AS tasks, count(*) FILTER (t.attempts > 0) AS attempted, count(*) FILTER (t.status = 'succeeded') AS succeeded,
       count(*) FILTER (t.status = 'failed') AS failed, min(CASE WHEN t.status = 'failed' THEN t.task_name END) AS first_failed
       FROM cur_runs r LEFT JOIN cur_tasks t ON t.run_id = r.id GROUP BY 1, 2""",
)
def snapshots(s, d):
    return relational.run_snapshots(c.current_runs(s, d, "status"), c.current_tasks(s, d, "run_id", "task_name", "status", "attempts"))


@own.add(
    "consistency_errors",
    """SELECT id, error FROM (SELECT r.id, CASE
         WHEN r.status IN ('failed', 'timedout') AND running IS NOT NULL THEN 'terminal_with_running_task:' || running
         WHEN r.status = 'succeeded' AND open IS NOT NULL THEN 'succeeded_with_open_task:' || open
         WHEN r.status = 'running' AND n IS NULL THEN 'active_with_no_tasks'
         WHEN r.status = 'running' AND open IS NULL THEN 'run_blocked'
         WHEN r.status IN ('failed', 'timedout') AND skipped IS NOT NULL AND n_failed = 0 THEN 'skipped_without_failure:' || skipped END AS error
       FROM cur_runs r LEFT JOIN (SELECT run_id, count(*) AS n, min(task_name) FILTER (status = 'running') AS running,
         min(task_name) FILTER (status NOT IN ('succeeded', 'failed', 'skipped')) AS open, min(task_name) FILTER (status = 'skipped') AS skipped,
         count(*) FILTER (status = 'failed') AS n_failed FROM cur_tasks GROUP BY 1) t ON t.run_id = r.id) WHERE error IS NOT NULL""",
)
def consistency_errors(s, d):
    return relational.consistency_errors(c.current_runs(s, d, "status"), c.current_tasks(s, d, "run_id", "task_name", "status"))


@own.add(
    "retention_keep",
    "SELECT id FROM cur_runs WHERE finished_at_ms IS NULL OR finished_at_ms > 1808000000000",
)
def retention_keep(s, d):
    runs = c.current_runs(s, d, "finished_at_ms")
    return runs.join(filters.retention_candidates(runs, 1_808_000_000_000).select("id"), "id", "left_anti").select("id")


@own.add("cascade_delete", "SELECT id FROM cur_tasks t WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.id = t.run_id AND r.deleted_at IS NOT NULL)")
def cascade_delete(s, d):
    gone = table(s, d, "runs").where("deleted_at IS NOT NULL")
    return lifecycle.cascade_delete(c.current_tasks(s, d, "run_id"), gone).select("id")


@own.add(
    "artifact_dedup",
    "SELECT id, arg_max(name, (created_at_ms, name)) AS name, max(size_bytes)::BIGINT AS size_bytes, max(created_at_ms) AS created_at_ms FROM doc_blobs GROUP BY id",
)
def artifact_dedup(s, d):
    return c.document_blobs(s, d).select("id", "name", "size_bytes", "created_at_ms")


@own.add(
    "artifact_gc",
    """SELECT count(*) AS scanned, sum(size_bytes)::BIGINT AS scanned_bytes, count_if(gone)::BIGINT AS reclaimed, coalesce(sum(CASE WHEN gone THEN size_bytes END), 0)::BIGINT AS reclaimed_bytes
       FROM (SELECT b.id, b.size_bytes, a.id IS NULL AND greatest(1815000000000 - b.created_at_ms, 0) >= 1000000000 AS gone
             FROM (SELECT id, max(size_bytes) AS size_bytes, max(created_at_ms) AS created_at_ms FROM doc_blobs GROUP BY id) b
             LEFT JOIN (SELECT DISTINCT id FROM doc_blobs WHERE tenant = 'queue-room') a ON a.id = b.id)""",
)
def artifact_gc(s, d):
    active = table(s, d, "documents").where("source = 'queue-room' AND text IS NOT NULL").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("id"))
    swept = relational.artifact_sweep(c.document_blobs(s, d), active, 1_000_000_000, NOW_MS)
    return swept.agg(
        F.count("*").alias("scanned"), F.sum("size_bytes").alias("scanned_bytes"), F.count_if("reclaimed").alias("reclaimed"),
        F.coalesce(F.sum(F.when(F.col("reclaimed"), F.col("size_bytes"))), F.lit(0)).alias("reclaimed_bytes"),
    )


_SWEPT = """SELECT b.id, a.id IS NULL AND greatest(1815000000000 - b.created_at_ms, 0) >= 1000000000 AS gone
  FROM (SELECT id, max(size_bytes) AS size_bytes, max(created_at_ms) AS created_at_ms FROM (
    SELECT * FROM (SELECT id, arg_max(coalesce(tenant, ''), (created_at_ms, name)) AS tenant, arg_max(size_bytes, (created_at_ms, name)) AS size_bytes, max(created_at_ms) AS created_at_ms FROM doc_blobs GROUP BY id)
    WHERE tenant IN ('dag-clinic', 'cron-corner')) GROUP BY id) b LEFT JOIN (SELECT DISTINCT id FROM doc_blobs WHERE tenant = 'queue-room') a ON a.id = b.id"""


def _swept(s, d):
    active = table(s, d, "documents").where("source = 'queue-room' AND text IS NOT NULL").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("id"))
    return relational.artifact_sweep(c.document_blobs(s, d), active, 1_000_000_000, NOW_MS, ["dag-clinic", "cron-corner"])


@own.add("artifact_describe", "SELECT id, arg_max(size_bytes, (created_at_ms, name)) AS size_bytes, max(created_at_ms) AS created_at_ms FROM doc_blobs WHERE id = (SELECT min(id) FROM doc_blobs) GROUP BY 1")
def artifact_describe(s, d):
    blobs = c.document_blobs(s, d)
    return blobs.join(F.broadcast(blobs.agg(F.min("id").alias("id"))), "id").select("id", "size_bytes", "created_at_ms")  # one row


@own.add("artifact_purged", f"SELECT id FROM ({_SWEPT}) WHERE gone")
def artifact_purged(s, d):
    """Ids a sweep over two tenants would purge; nothing is deleted."""
    return _swept(s, d).where("reclaimed").select("id")


@own.add("artifacts_left", f"SELECT DISTINCT id FROM doc_blobs WHERE id NOT IN (SELECT id FROM ({_SWEPT}) WHERE gone)")
def artifacts_left(s, d):
    """Ids that are left behind the sweep's deletion."""
    return relational.artifacts_after(c.document_blobs(s, d), _swept(s, d)).select("id")


def _planned(s, d):
    """Tasks and timeouts of each definition's newest readable version, and those of a planned change: tasks whose names have
    a length of 0 by 7 go, those with 1 get another handler, those with 2 one more dependency; every third definition by
    the length of its name waits a second less."""
    documents = table(s, d, "workflows")
    newest = lambda rows: rows.join(rows.groupBy("tenant", "name").agg(F.max("version").alias("version")), DEF_KEY).drop("version")
    old, waits = newest(graph.definition_tasks(documents, DEF_KEY)), newest(graph.definition_timeouts(documents, DEF_KEY))
    turn = F.length("task") % 7
    new = old.where(turn != 0).select(
        "tenant", "name", "task", F.when(turn == 1, F.concat("handler", F.lit(".v2"))).otherwise(F.col("handler")).alias("handler"),
        F.when(turn == 2, F.array_append("deps", F.lit("extra"))).otherwise(F.col("deps")).alias("deps"),
    )
    shorter = waits.withColumn("timeout_ms", F.col("timeout_ms") - F.when(F.length("name") % 3 == 0, 1000).otherwise(0))
    return old, new, waits, shorter


_COMPAT = """ver AS (SELECT tenant, name, max(version) AS version FROM def_task GROUP BY 1, 2),
  old_t AS (SELECT tenant, name, task, handler, list_distinct(deps) AS deps FROM def_task JOIN ver USING (tenant, name, version)),
  waits AS (SELECT tenant, name, max(CASE json_type(t) WHEN 'OBJECT' THEN (t->>'$.value')::BIGINT * CASE t->>'$.unit' WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 ELSE 1 END
    ELSE coalesce(try_cast(t->>'$' AS BIGINT), 60000) END) AS timeout_ms FROM (SELECT *, doc::JSON->'$.timeout_ms' AS t FROM defs_read WHERE json_valid(doc)) JOIN ver USING (tenant, name, version) GROUP BY 1, 2),
  issues AS (
    SELECT tenant, name, task, 'breaking' AS severity, 'removed' AS issue, NULL::VARCHAR AS detail FROM old_t WHERE length(task) % 7 = 0
    UNION ALL SELECT tenant, name, task, 'breaking', 'handler', handler || ' -> ' || handler || '.v2' FROM old_t WHERE length(task) % 7 = 1 AND handler IS NOT NULL
    UNION ALL SELECT tenant, name, task, 'warning', 'dependencies', 'extra' FROM old_t WHERE length(task) % 7 = 2 AND NOT list_contains(deps, 'extra')
    UNION ALL SELECT tenant, name, NULL, 'warning', 'timeout', timeout_ms || ' -> ' || (timeout_ms - 1000) FROM waits WHERE length(name) % 3 = 0)"""


@own.add("compat_report", f"SELECT * FROM (WITH {_COMPAT} SELECT * FROM issues)")
def compat_report(s, d):
    old, new, waits, shorter = _planned(s, d)
    key = ["tenant", "name"]
    return relational.compatibility_report(old, new, key).union(relational.timeout_warnings(waits, shorter, key))


@own.add(
    "compat_summary",
    f"""SELECT * FROM (WITH {_COMPAT} SELECT v.tenant, v.name, count_if(severity = 'breaking')::BIGINT AS breaking, count_if(severity = 'warning')::BIGINT AS warnings, count_if(severity = 'breaking') = 0 AS compatible
        FROM ver v LEFT JOIN issues i ON i.tenant = v.tenant AND i.name = v.name GROUP BY 1, 2)""",
)
def compat_summary(s, d):
    """Of each definition the numbers of issues and whether the change is compatible: nothing breaks."""
    old = _planned(s, d)[0].select("tenant", "name").distinct()
    counted = compat_report(s, d).groupBy("tenant", "name").agg(*[F.count_if(F.col("severity") == x).alias(n) for x, n in (("breaking", "breaking"), ("warning", "warnings"))])
    both = old.join(counted, ["tenant", "name"], "left").select("tenant", "name", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("breaking", "warnings")])
    return both.withColumn("compatible", F.col("breaking") == 0)


# ------------------------------------------------------------------------------------------------------------ graphs


@own.add(
    "dangling_deps",
    """SELECT e.tenant, e.name, e.version, e.task, e.dep FROM (SELECT * FROM def_edge UNION SELECT tenant, name, version, task, 'ghost-' || task FROM def_task WHERE length(task) % 5 = 0) e
       ANTI JOIN def_task t ON e.tenant = t.tenant AND e.name = t.name AND e.version = t.version AND e.dep = t.task""",
)
def dangling_deps(s, d):
    """Dependencies on tasks that do not exist; the tables have none, so a fifth of the tasks get one."""
    tasks = graph.definition_tasks(table(s, d, "workflows"), DEF_KEY)
    ghost = F.when(F.length("task") % 5 == 0, F.array_append("deps", F.concat(F.lit("ghost-"), "task"))).otherwise(F.col("deps"))
    return graph.dangling(tasks.withColumn("deps", ghost), DEF_KEY).distinct()


_LEVELS = """lev AS (
    SELECT tenant, name, version, task, 0 AS stage FROM def_task WHERE len(deps) = 0
    UNION SELECT e.tenant, e.name, e.version, e.task, l.stage + 1 FROM lev l JOIN def_edge e ON e.tenant = l.tenant AND e.name = l.name AND e.version = l.version AND e.dep = l.task
  ), stages AS (SELECT tenant, name, version, task, max(stage)::INT AS stage FROM lev GROUP BY 1, 2, 3, 4)"""


@own.add("task_waves", f"SELECT * FROM (WITH RECURSIVE {_LEVELS} SELECT tenant, name, version, task, stage FROM stages)", recursive=True)
def task_waves(s, d):
    return graph.task_waves(table(s, d, "workflows"), DEF_KEY).distinct()


@own.add(
    "max_parallelism",
    f"SELECT * FROM (WITH RECURSIVE {_LEVELS} SELECT tenant, name, version, max(n) AS widest, count(*) AS n_stages FROM (SELECT tenant, name, version, stage, count(*) AS n FROM stages GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)",
    recursive=True,
)
def max_parallelism(s, d):
    waves = graph.task_waves(table(s, d, "workflows"), DEF_KEY).distinct()
    sizes = waves.groupBy(*DEF_KEY, "stage").agg(F.count("*").alias("n"))
    return sizes.groupBy(*DEF_KEY).agg(F.max("n").alias("widest"), F.count("*").alias("n_stages"))


@own.add(
    "transitive_deps",
    """SELECT * FROM (WITH RECURSIVE up AS (SELECT tenant, name, version, task, dep AS above FROM def_edge
       UNION SELECT u.tenant, u.name, u.version, u.task, e.dep FROM up u JOIN def_edge e ON e.tenant = u.tenant AND e.name = u.name AND e.version = u.version AND e.task = u.above) SELECT * FROM up)""",
    recursive=True,
)
def transitive_deps(s, d):
    return graph.transitive_dependencies(table(s, d, "workflows"), DEF_KEY).distinct()


def _with_references(s, d):
    """Definitions whose tasks refer, in their inputs, to the output of their smallest dependency, of themselves, and of a task
    that does not exist; the tables have no references."""

    def rows(records, tasks, value):
        named = [{"name": t, "depends_on": deps, "input": {"a": [f"${{tasks.{x}.output}}" for x in (sorted(deps)[:1] + [t, "ghost"])]}} for t, deps in tasks.items()]
        yield (structural.written({"name": "x", "tasks": named}),)

    return graph.per_definition(table(s, d, "workflows"), DEF_KEY, rows, "document STRING").distinct()


@own.add(
    "reference_warnings",
    """SELECT tenant, name, version, task, 'tasks.' || task || '.output' AS reference, 'self' AS kind FROM def_task
       UNION ALL SELECT tenant, name, version, task, 'tasks.ghost.output', 'unreachable' FROM def_task""",
)
def reference_warnings(s, d):
    """References that a task cannot follow: its own output, and that of a task it does not depend on."""
    return graph.definition_warnings(_with_references(s, d), DEF_KEY).distinct()


@own.add(
    "variable_references",
    """SELECT tenant, name, version, array_to_string(list_sort(list_distinct(flatten(list([ 'tasks.' || task || '.output', 'tasks.ghost.output' ] ||
       CASE WHEN len(deps) > 0 THEN ['tasks.' || list_min(deps) || '.output'] ELSE [] END)))), ',') AS refs FROM def_task GROUP BY 1, 2, 3""",
)
def variable_references(s, d):
    reports = graph.dry_runs(_with_references(s, d), DEF_KEY).where("total_tasks > 0")
    return reports.select(*DEF_KEY, F.col("variable_references").alias("refs")).distinct()


_ORDERS = """whole AS (SELECT tenant, name, version, count(*) AS n FROM def_task GROUP BY 1, 2, 3), placed AS (
    SELECT tenant, name, version, []::VARCHAR[] AS done FROM whole
    UNION ALL SELECT p.tenant, p.name, p.version, list_append(any_value(p.done), min(t.task)) FROM placed p JOIN def_task t ON t.tenant = p.tenant AND t.name = p.name AND t.version = p.version
    WHERE NOT list_contains(p.done, t.task) AND list_has_all(p.done, t.deps) GROUP BY 1, 2, 3)"""


@own.add(
    "dry_run_report",
    f"""SELECT * FROM (WITH RECURSIVE {_LEVELS}, {_ORDERS},
        widths AS (SELECT tenant, name, version, count(*)::INT AS n_stages, max(n)::INT AS widest FROM (SELECT tenant, name, version, stage, count(*) AS n FROM stages GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
        back AS (SELECT s.tenant, s.name, s.version, s.stage, min(s.task) AS task FROM stages s JOIN widths w USING (tenant, name, version) WHERE s.stage = w.n_stages - 1 GROUP BY 1, 2, 3, 4
          UNION ALL SELECT b.tenant, b.name, b.version, b.stage - 1, min(e.dep) FROM back b JOIN def_edge e ON e.tenant = b.tenant AND e.name = b.name AND e.version = b.version AND e.task = b.task
          JOIN stages s ON s.tenant = e.tenant AND s.name = e.name AND s.version = e.version AND s.task = e.dep AND s.stage = b.stage - 1 GROUP BY 1, 2, 3, 4),
        paths AS (SELECT tenant, name, version, string_agg(task, ',' ORDER BY stage) AS critical_path FROM back GROUP BY 1, 2, 3)
        SELECT w.tenant, w.name, w.version, w.n::INT AS total_tasks, NULL::VARCHAR AS error, array_to_string(p.done, ',') AS topo_order, d.n_stages, d.widest AS max_parallelism, c.critical_path,
          '' AS variable_references, '' AS warnings
        FROM whole w JOIN placed p ON p.tenant = w.tenant AND p.name = w.name AND p.version = w.version AND len(p.done) = w.n
        JOIN widths d ON d.tenant = w.tenant AND d.name = w.name AND d.version = w.version JOIN paths c ON c.tenant = w.tenant AND c.name = w.name AND c.version = w.version)""",
    recursive=True,
)
def dry_run_report(s, d):
    return graph.dry_runs(table(s, d, "workflows"), DEF_KEY).where("total_tasks > 0").distinct()


@own.add(
    "critical_path_length",
    f"SELECT * FROM (WITH RECURSIVE {_LEVELS} SELECT tenant, name, version, max(stage) + 1 AS length FROM stages GROUP BY 1, 2, 3)",
    recursive=True,
)
def critical_path_length(s, d):
    reports = graph.dry_runs(table(s, d, "workflows"), DEF_KEY).where("error IS NULL AND total_tasks > 0")
    return reports.select(*DEF_KEY, F.size(F.split("critical_path", ",")).alias("length")).distinct()


def _tasks(*records: str) -> str:
    return ', "tasks": [' + ", ".join(records) + "]}"


#: Ends of documents that break a rule, or two of them, with the error that comes first (from the reference's order of checks).
_BROKEN = [
    ("}", None),
    (', "name": "Bad Name", "tasks": []}', "invalid_name"),
    (f', "description": "{"x" * 513}", "tasks": []}}', "description_too_long"),
    (', "timeout_ms": 0, "tasks": []}', "empty_tasks"),
    (_tasks(*['{"name": "a"}'] * 257), "too_many_tasks"),
    (_tasks('{"name": "a", "timeout_ms": 0}', '{"name": "a"}'), "duplicate_task_name"),
    (_tasks('{"name": "a", "timeout_ms": 0, "retry": {"max_attempts": 0}}', '{"name": "b", "depends_on": ["no"]}'), "zero_timeout"),
    (_tasks(f'{{"name": "{"t" * 65}", "retry": {{"max_attempts": 0}}}}', '{"name": "b", "timeout_ms": 0}'), "task_name_too_long"),
    (_tasks('{"name": "a", "retry": {"max_attempts": 0}}', '{"name": "b", "timeout_ms": 0}'), "invalid_policy"),
    (_tasks('{"name": "a", "retry": {"base_delay_ms": 9000, "max_delay_ms": 8000}}'), "invalid_policy"),
    (_tasks('{"name": "a", "retry": {"multiplier": 0.5}}'), "invalid_policy"),
    (', "timeout_ms": 0' + _tasks('{"name": "a", "depends_on": ["b", "no"]}', '{"name": "b", "depends_on": ["a"]}'), "unknown"),
    (', "timeout_ms": 0' + _tasks('{"name": "a", "depends_on": ["b"]}', '{"name": "b", "depends_on": ["a"]}'), "cycle"),
    (', "timeout_ms": 0, "hooks": {"on_start": [{"webhook_url": "nowhere"}]}' + _tasks('{"name": "a"}'), "zero_timeout"),
    (', "timeout_ms": 5, "hooks": {"on_cancel": [{"webhook_url": "https://a.example/x"}, {"webhook_url": "ftp://a.example"}]}' + _tasks('{"name": "a"}'), "invalid_hook_url"),
    (', "timeout_ms": 5, "hooks": {"on_start": [{"webhook_url": "http:///x"}]}' + _tasks('{"name": "a"}'), "invalid_hook_url"),
    (', "timeout_ms": 5, "hooks": {"on_start": [{"webhook_url": "HTTPS://u@a.example:8080"}, {"event_filter": "failed"}]}' + _tasks('{"name": "a"}'), None),
]


@own.add(
    "definition_errors",
    f"""SELECT * FROM (SELECT DISTINCT tenant, name, version, ([{", ".join(f"'{e}'" if e else "NULL" for _, e in _BROKEN)}])[(length(name) + version) % {len(_BROKEN)} + 1] AS error
        FROM defs_read WHERE json_valid(doc) AND json_type(doc::JSON) = 'OBJECT') WHERE error IS NOT NULL""",
)
def definition_errors(s, d):
    """The first error of each definition. Those of the tables are sound, so each is given an end that breaks rules."""
    ends = F.element_at(F.array(*[F.lit(end) for end, _ in _BROKEN]), ((F.length("name") + F.col("version")) % len(_BROKEN) + 1).cast("int"))
    read = graph.per_definition(table(s, d, "workflows"), DEF_KEY, lambda r, g, value: [(structural.written(value),)], "document STRING")
    changed = read.withColumn("document", F.concat(F.regexp_replace("document", r"\}$", ""), ends))
    return graph.definition_errors(changed, DEF_KEY).distinct()


def _run_states(s, d, *also):
    runs = c.current_runs(s, d, "tenant", "def_name", "def_version", "attempts", "status", "deadline_at_ms").where("status = 'running'")
    docs = table(s, d, "workflows").groupBy("tenant", F.col("name").alias("def_name"), F.col("version").alias("def_version")).agg(F.max(F.struct("loaded_at", "document")).alias("d"))
    with_doc = runs.join(docs.withColumn("document", F.col("d.document")).drop("d"), ["tenant", "def_name", "def_version"])
    return graph.run_states(with_doc, c.current_tasks(s, d, "run_id", "task_name", "status", *also))


_STATES = """st AS (SELECT r.id, t.task, coalesce(k.status, 'pending') AS status, t.deps, t.tenant, t.name, t.version FROM cur_runs r
    JOIN def_task t ON t.tenant = r.tenant AND t.name = r.def_name AND t.version = r.def_version
    LEFT JOIN (SELECT run_id, task_name, max(status) AS status FROM cur_tasks GROUP BY 1, 2) k ON k.run_id = r.id AND k.task_name = t.task WHERE r.status = 'running')"""


@own.add(
    "ready_tasks",
    f"""SELECT * FROM (WITH {_STATES} SELECT id, task, status FROM st s WHERE status = 'failed' OR (status = 'pending' AND NOT EXISTS (
        SELECT 1 FROM (SELECT unnest(s.deps) AS dep) x WHERE NOT EXISTS (SELECT 1 FROM st y WHERE y.id = s.id AND y.task = x.dep AND y.status = 'succeeded'))))""",
)
def ready_tasks(s, d):
    return graph.next_states(_run_states(s, d)).where("ready").select("id", "task", "status")


@own.add("skip_closure", f"""SELECT * FROM (WITH RECURSIVE {_STATES}, blocked AS (
    SELECT s.id, s.task FROM st s WHERE status = 'pending' AND EXISTS (SELECT 1 FROM (SELECT unnest(s.deps) AS dep) x
      WHERE NOT EXISTS (SELECT 1 FROM st y WHERE y.id = s.id AND y.task = x.dep AND y.status = 'succeeded')))
    SELECT s.id, s.task, CASE WHEN b.task IS NOT NULL THEN 'skipped' ELSE s.status END AS after FROM st s LEFT JOIN blocked b ON b.id = s.id AND b.task = s.task)""", recursive=True)  # fmt: skip
def skip_closure(s, d):
    return graph.next_states(_run_states(s, d)).select("id", "task", "after")


_TRIES = ", ".join(f"try_cast({{0}}->>'$.retry.{k}' AS INT)" for k in ("max_attempts", "maxAttempts", "tries"))
_FAILS = "(ends_with(handler, '.fail') OR ends_with(handler, '.fit'))"


@own.add(
    "attempt_outcomes",
    f"""SELECT * FROM (WITH RECURSIVE {_LEVELS},
        budget AS (SELECT tenant, name, version, value->>'$.name' AS task, max(coalesce({_TRIES.format("value")}, {_TRIES.format("doc")}, 3)) AS most_task, max(coalesce({_TRIES.format("doc")}, 3)) AS most
          FROM (SELECT tenant, name, version, doc::JSON AS doc FROM defs_read WHERE json_valid(doc)), json_each(doc, '$.tasks') WHERE type = 'OBJECT' GROUP BY 1, 2, 3, 4),
        base AS (SELECT r.id, r.attempts AS tried, coalesce(r.deadline_at_ms < {NOW_MS}, false) AS overdue, t.task, t.handler, t.deps, g.stage, coalesce(k.status, 'pending') AS status,
            coalesce(k.attempts, 0) < b.most_task AS has_left, coalesce(k.attempts, 0) + 1 < b.most_task AS keeps_left, b.most
          FROM cur_runs r JOIN def_task t ON t.tenant = r.tenant AND t.name = r.def_name AND t.version = r.def_version
          JOIN stages g ON g.tenant = t.tenant AND g.name = t.name AND g.version = t.version AND g.task = t.task
          JOIN budget b ON b.tenant = t.tenant AND b.name = t.name AND b.version = t.version AND b.task = t.task
          LEFT JOIN (SELECT run_id, task_name, max(status) AS status, max(attempts) AS attempts FROM cur_tasks GROUP BY 1, 2) k ON k.run_id = r.id AND k.task_name = t.task WHERE r.status = 'running'),
        walk AS (SELECT DISTINCT id, 0 AS stage, []::VARCHAR[] AS ok FROM base
          UNION ALL SELECT w.id, w.stage + 1, any_value(w.ok) || coalesce(list(b.task) FILTER (b.status = 'succeeded' OR (NOT {_FAILS} AND ((b.status = 'failed' AND b.has_left) OR (b.status = 'pending' AND list_has_all(w.ok, b.deps))))), [])
          FROM walk w JOIN base b ON b.id = w.id AND b.stage = w.stage GROUP BY w.id, w.stage),
        done AS (SELECT id, arg_max(ok, stage) AS ok FROM walk GROUP BY 1),
        ended AS (SELECT b.*, CASE WHEN status = 'failed' AND NOT has_left THEN 'stays' WHEN {_FAILS} AND (status = 'failed' OR (status = 'pending' AND list_has_all(d.ok, b.deps))) THEN 'fails' END AS how
          FROM base b JOIN done d USING (id))
        SELECT id, CASE WHEN overdue THEN 'timedout' WHEN failed IS NULL THEN 'succeeded' WHEN again THEN 'queued' ELSE 'failed' END AS outcome, CASE WHEN overdue THEN '' ELSE coalesce(failed, '') END AS failed_tasks,
          CASE WHEN again AND NOT overdue AND failed IS NOT NULL THEN 'release' ELSE 'ack' END AS action,
          CASE WHEN NOT again AND NOT overdue THEN split_part(failed, ',', 1) END AS error_task
        FROM (SELECT id, any_value(overdue) AS overdue, string_agg(task, ',' ORDER BY task) FILTER (how IS NOT NULL) AS failed,
            any_value(tried) + 1 < any_value(most) AND coalesce(bool_and(how = 'fails' AND keeps_left) FILTER (how IS NOT NULL), true) AS again FROM ended GROUP BY 1)
        UNION ALL SELECT id, 'definition_lost', '', 'ack', NULL FROM cur_runs r WHERE status = 'running' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.id = r.id)
          AND EXISTS (SELECT 1 FROM workflows w WHERE w.tenant = r.tenant AND w.name = r.def_name AND w.version = r.def_version))""",
    recursive=True,
)
def attempt_outcomes(s, d):
    """One attempt of every running run, where handlers of certain names fail."""
    states = _run_states(s, d, "attempts").withColumn("overdue", F.coalesce(F.col("deadline_at_ms") < NOW_MS, F.lit(False)))
    done = lifecycle.simulate_attempts(states, lambda handler: handler.endswith((".fail", ".fit")))
    return done.select("id", "outcome", "failed_tasks", "action", "error_task")


#: Legal transitions (fixed values).
RUN_EDGES = [("queued", "running"), ("queued", "cancelled"), ("running", "succeeded"), ("running", "failed"), ("running", "cancelled"), ("running", "timedout"), ("failed", "queued"), ("failed", "cancelled")]
TASK_EDGES = [("pending", "running"), ("pending", "failed"), ("pending", "skipped"), ("running", "succeeded"), ("running", "failed"), ("failed", "running")]
TASK_STATUSES = ["pending", "running", "succeeded", "failed", "skipped"]


def _pairs(edges):
    return ", ".join(f"('{a}', '{b}')" for a, b in edges)


@own.add("run_fsm_illegal", f"SELECT a.s AS from_state, b.s AS to_state FROM (SELECT unnest({list(filters.RUN_STATUSES)}) AS s) a, (SELECT unnest({list(filters.RUN_STATUSES)}) AS s) b WHERE (a.s, b.s) NOT IN ({_pairs(RUN_EDGES)})")
def run_fsm_illegal(s, d):
    return relational.illegal_edges(list(filters.RUN_STATUSES), RUN_EDGES, s)


@own.add("task_fsm_illegal", f"SELECT a.s AS from_state, b.s AS to_state FROM (SELECT unnest({TASK_STATUSES}) AS s) a, (SELECT unnest({TASK_STATUSES}) AS s) b WHERE (a.s, b.s) NOT IN ({_pairs(TASK_EDGES)})")
def task_fsm_illegal(s, d):
    return relational.illegal_edges(TASK_STATUSES, TASK_EDGES, s)


# ------------------------------------------------------------------------------------------- queues, changes, stores


@own.add(
    "queue_enqueue",
    """SELECT run_id, 'kept' AS outcome FROM queue_entries UNION ALL
       SELECT id, CASE WHEN q.run_id IS NULL THEN 'inserted' ELSE 'conflict' END FROM (SELECT id FROM cur_runs WHERE status IN ('queued', 'failed')) r LEFT JOIN queue_entries q ON q.run_id = r.id""",
)
def queue_enqueue(s, d):
    entries = c.queue_entries(s, d)
    new = c.current_runs(s, d, "status", "created_at_ms").where(F.col("status").isin("queued", "failed")).select(
        F.col("id").alias("run_id"), F.lit("").alias("token"), F.col("created_at_ms").alias("due_at_ms"), F.lit(None).cast("bigint").alias("lease_until_ms"), F.lit(None).cast("string").alias("claimed_by")
    )
    return lifecycle.enqueue(entries, new).select("run_id", "outcome")


_WITH = "queue_entries q LEFT JOIN claims k ON k.run_id = q.run_id"


@own.add(
    "queue_claim",
    f"""SELECT q.run_id, CASE WHEN k.run_id IS NULL THEN 'untouched' WHEN q.token IN ('', k.command_token) THEN 'claimed' ELSE 'lost' END AS outcome,
        CASE WHEN k.run_id IS NOT NULL AND q.token IN ('', k.command_token) THEN {NOW_MS + 60000} ELSE q.lease_until_ms END AS lease_until_ms FROM {_WITH}""",
)
def queue_claim(s, d):
    return lifecycle.claim(c.queue_entries(s, d), c.claims(s, d), NOW_MS, 60_000).select("run_id", "outcome", "lease_until_ms")


@own.add("queue_ack", f"SELECT q.run_id FROM {_WITH} WHERE k.run_id IS NULL OR k.command_token <> q.token")
def queue_ack(s, d):
    return lifecycle.ack(c.queue_entries(s, d), c.claims(s, d)).select("run_id")


_OUT = "CASE WHEN k.run_id IS NULL THEN 'untouched' WHEN {mine} THEN 'done' ELSE 'lost' END AS outcome"
_MINE = "k.command_token = q.token"


@own.add("queue_release", f"SELECT q.run_id, {_OUT.format(mine=_MINE)}, CASE WHEN {_MINE} THEN {NOW_MS + 5000} ELSE due_at_ms END AS due_at_ms, CASE WHEN {_MINE} THEN '' ELSE token END AS token FROM {_WITH}")
def queue_release(s, d):
    return lifecycle.release(c.queue_entries(s, d), c.claims(s, d), NOW_MS + 5000).select("run_id", "outcome", "due_at_ms", "token")


@own.add("queue_failclaim", f"SELECT q.run_id, {_OUT.format(mine=_MINE)}, due_at_ms, CASE WHEN {_MINE} THEN NULL ELSE lease_until_ms END AS lease_until_ms FROM {_WITH}")
def queue_failclaim(s, d):
    return lifecycle.fail_claim(c.queue_entries(s, d), c.claims(s, d)).select("run_id", "outcome", "due_at_ms", "lease_until_ms")


_LIVE = f"({_MINE} AND q.lease_until_ms > {NOW_MS})"


@own.add("queue_renew", f"SELECT q.run_id, {_OUT.format(mine=_LIVE)}, CASE WHEN {_LIVE} THEN {NOW_MS + 30000} ELSE lease_until_ms END AS lease_until_ms FROM {_WITH}")
def queue_renew(s, d):
    return lifecycle.renew_lease(c.queue_entries(s, d), c.claims(s, d), NOW_MS, 30_000).select("run_id", "outcome", "lease_until_ms")


@own.add("queue_recover", f"SELECT run_id, coalesce(lease_until_ms <= {NOW_MS}, false) AS recovered, CASE WHEN lease_until_ms <= {NOW_MS} THEN '' ELSE token END AS token FROM queue_entries")
def queue_recover(s, d):
    return lifecycle.recover_expired(c.queue_entries(s, d), NOW_MS).select("run_id", "recovered", "token")


@own.add("cancel_runs", f"SELECT id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status, CASE WHEN hit THEN {NOW_MS} ELSE finished_at_ms END AS finished_at_ms, hit AS changed FROM (SELECT *, tenant = 'lumen-works' AND status IN ('queued', 'running') AS hit FROM cur_runs)")
def cancel_runs(s, d):
    runs = c.current_runs(s, d, "tenant", "status", "finished_at_ms")
    return lifecycle.cancel_runs(runs, runs.where("tenant = 'lumen-works'"), NOW_MS)


@own.add("cancel_dequeue", "SELECT q.run_id FROM queue_entries q JOIN cur_runs r ON r.id = q.run_id WHERE NOT (r.tenant = 'lumen-works' AND r.status IN ('queued', 'running'))")
def cancel_dequeue(s, d):
    """Queue entries that are left when a tenant's runs are cancelled."""
    return lifecycle.entries_after_cancel(c.queue_entries(s, d), cancel_runs(s, d)).select("run_id")


@own.add(
    "outbox_enqueue",
    f"""SELECT id, min(seq) AS seq, 0 AS attempts, 5 AS max_attempts, {NOW_MS}::BIGINT AS next_attempt_at_ms, 'pending' AS status FROM run_events
        WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM outbox WHERE ascii(substr(id, 1, 1)) % 2 = 0) GROUP BY 1""",
)
def outbox_enqueue(s, d):
    """All deliveries enqueued into an outbox that has about half of their items."""
    there = c.outbox(s, d).where(F.ascii(F.substring("id", 1, 1)) % 2 == 0)
    return lifecycle.outbox_enqueue(there, table(s, d, "run_events").select("id", "seq"), 5, NOW_MS)


@own.add(
    "version_cas",
    """SELECT tenant, name, CASE WHEN length(name) % 3 > 0 AND version % 2 = 0 THEN version + 1 ELSE version END AS version,
         CASE WHEN length(name) % 3 = 0 THEN 'untouched' WHEN version % 2 = 0 THEN 'updated' ELSE 'conflict' END AS outcome FROM cur_defs
       UNION ALL SELECT tenant, 'no-' || name, NULL, 'missing' FROM cur_defs WHERE length(name) % 3 > 0""",
)
def version_cas(s, d):
    """Versions raised where they are even; a third of the definitions is left alone, and as many updates have no target."""
    current = c.current_definitions(s, d)
    updates = current.where(F.length("name") % 3 > 0).select("tenant", "name", (F.floor(F.col("version") / 2) * 2).cast("int").alias("expected"))
    lost = updates.withColumn("name", F.concat(F.lit("no-"), "name"))
    return lifecycle.compare_and_set(current, updates.unionByName(lost), ["tenant", "name"])


@own.add("latest_upsert", "SELECT id, status, run_id, task_name FROM cur_tasks")
def latest_upsert(s, d):
    return c.current_tasks(s, d, "status", "run_id", "task_name").select("id", "status", "run_id", "task_name")


@own.add(
    "outbox_drain",
    f"""SELECT id, CASE WHEN due AND NOT ok THEN attempts + 1 ELSE attempts END AS attempts,
        CASE WHEN due AND ok THEN 'delivered' WHEN due AND attempts + 1 >= max_attempts THEN 'dead_letter' ELSE status END AS status,
        CASE WHEN due AND NOT ok AND attempts + 1 < max_attempts THEN {NOW_MS} + CAST(500 * pow(2, least(attempts, 10)) AS BIGINT) ELSE next_attempt_at_ms END AS next_attempt_at_ms
        FROM (SELECT *, status = 'pending' AND next_attempt_at_ms <= {NOW_MS} AS due, ascii(substr(id, 1, 1)) % 2 = 0 AS ok FROM outbox)""",
)
def outbox_drain(s, d):
    items = c.outbox(s, d)
    results = items.where((F.col("status") == "pending") & (F.col("next_attempt_at_ms") <= NOW_MS)).select("id", (F.ascii(F.substring("id", 1, 1)) % 2 == 0).alias("ok"))
    return lifecycle.outbox_after(items, results, NOW_MS, 500).select("id", "attempts", "status", "next_attempt_at_ms")


def _requests(s, d):
    return table(s, d, "runs").select("id", "tenant", F.col("created_at_ms").alias("at_ms"), F.lit(1.0).alias("cost")).distinct()


_BUCKET_FOLD = """fold AS (
    SELECT key, rn, id, at_ms, true AS accepted, 0::BIGINT AS wait_ms, 1.0::DOUBLE AS level FROM req WHERE rn = 1
    UNION ALL
    SELECT key, rn, id, at_ms, leaked + 1.0 <= 5.0, CASE WHEN leaked + 1.0 <= 5.0 THEN 0 ELSE greatest(1, ceil((leaked + 1.0 - 5.0) / 0.001 * 1000.0)::BIGINT) END,
           CASE WHEN leaked + 1.0 <= 5.0 THEN leaked + 1.0 ELSE leaked END
    FROM (SELECT r.*, greatest(0.0::DOUBLE, f.level - greatest(r.at_ms - f.at_ms, 0)::DOUBLE / 1000.0::DOUBLE * 0.001::DOUBLE) AS leaked
          FROM fold f JOIN req r ON r.key = f.key AND r.rn = f.rn + 1))"""


@own.add(
    "leaky_bucket",
    f"""SELECT * FROM (WITH RECURSIVE req AS (SELECT id, tenant AS key, created_at_ms AS at_ms, row_number() OVER (PARTITION BY tenant ORDER BY created_at_ms, id) AS rn
        FROM (SELECT DISTINCT id, tenant, created_at_ms FROM runs)), {_BUCKET_FOLD} SELECT id, key AS tenant, at_ms, accepted, wait_ms FROM fold)""",
)
def leaky_bucket(s, d):
    return lifecycle.leaky_bucket(_requests(s, d), "tenant", 5.0, 0.001)


_ENDS = "('run.succeeded', 'run.failed', 'run.timed_out', 'run.cancelled')"


@own.add(
    "concurrency_limit",
    f"""SELECT * FROM (WITH RECURSIVE req AS (SELECT seq AS id, run_id AS holder, tenant, CASE WHEN lower(kind) = 'run.started' THEN 'acquire' ELSE 'release' END AS action,
          row_number() OVER (PARTITION BY tenant ORDER BY created_at_ms, seq) AS rn FROM run_events WHERE lower(kind) = 'run.started' OR lower(kind) IN {_ENDS}),
        fold AS (
          SELECT tenant, rn, id, action, action = 'acquire' AS granted, CASE WHEN action = 'acquire' THEN [holder] ELSE [] END AS held FROM req WHERE rn = 1
          UNION ALL
          SELECT r.tenant, r.rn, r.id, r.action, CASE WHEN r.action = 'acquire' THEN NOT list_contains(f.held, r.holder) AND len(f.held) < 8 ELSE list_contains(f.held, r.holder) END,
            CASE WHEN r.action = 'release' THEN list_filter(f.held, lambda x: x <> r.holder) WHEN NOT list_contains(f.held, r.holder) AND len(f.held) < 8 THEN list_append(f.held, r.holder) ELSE f.held END
          FROM fold f JOIN req r ON r.tenant = f.tenant AND r.rn = f.rn + 1)
        SELECT id, tenant, action, granted, len(held)::INT AS active FROM fold)""",
)
def concurrency_limit(s, d):
    return lifecycle.concurrency_limit(lifecycle.permit_events(table(s, d, "run_events")), "tenant", 8)


# ---------------------------------------------------------------------------------------------------- scalar functions


def _policies(s, d):
    """Retry policies made from part: every kind and jitter, indexes 0 to 9."""
    part = table(s, d, "part")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    return part.select(
        "p_partkey", pick(["fixed", "linear", "exponential"], F.col("p_partkey")).alias("kind"), pick(["none", "full", "equal"], F.col("p_size")).alias("jitter"),
        (F.col("p_size") * 100).cast("bigint").alias("base"), (F.col("p_size") * 4000).cast("bigint").alias("most"),
        (1 + F.col("p_partkey") % 3 * 0.5).cast("double").alias("multiplier"), (F.col("p_partkey") % 10).cast("int").alias("i"),
    )


_POLICIES = """SELECT p_partkey, ['fixed', 'linear', 'exponential'][p_partkey % 3 + 1] AS kind, ['none', 'full', 'equal'][p_size % 3 + 1] AS jitter,
   (p_size * 100)::BIGINT AS base, (p_size * 4000)::BIGINT AS most, (1 + p_partkey % 3 * 0.5)::DOUBLE AS multiplier, (p_partkey % 10)::INT AS i FROM part"""
_RAW = """greatest(floor(least(CASE WHEN kind = 'linear' AND multiplier > 1 THEN base + floor(base * (multiplier - 1) * i) WHEN kind = 'exponential' AND multiplier > 1 THEN base * pow(multiplier, i) ELSE base END, least(most, 86400000)))::BIGINT, base)"""


@own.add("backoff_curve", f"SELECT p_partkey, {_RAW} AS delay_ms FROM ({_POLICIES})")
def backoff_curve(s, d):
    p = _policies(s, d)
    return p.select("p_partkey", scalars.raw_delay(F.col("kind"), F.col("base"), F.col("most"), F.col("multiplier"), F.col("i")).alias("delay_ms"))


@own.add(
    "jitter_bounds",
    f"""SELECT p_partkey, CASE jitter WHEN 'none' THEN raw WHEN 'equal' THEN raw // 2 ELSE 0 END AS low, CASE jitter WHEN 'none' THEN raw WHEN 'equal' THEN raw // 2 + greatest(raw // 2, 1) ELSE greatest(raw, 1) END AS high
        FROM (SELECT p_partkey, jitter, {_RAW} AS raw FROM ({_POLICIES}))""",
)
def jitter_bounds(s, d):
    p = _policies(s, d)
    raw = scalars.raw_delay(F.col("kind"), F.col("base"), F.col("most"), F.col("multiplier"), F.col("i"))
    low, high = scalars.jitter_bounds(F.col("raw"), F.col("jitter"))
    return p.withColumn("raw", raw).select("p_partkey", low.alias("low"), high.alias("high"))


@own.add("policy_errors", f"SELECT p_partkey, CASE WHEN i < 1 OR i > 100 THEN 'attempts' WHEN base < 1 THEN 'base_delay' WHEN most < base THEN 'max_below_base' WHEN most > 86400000 THEN 'over_ceiling' WHEN multiplier < 1 THEN 'multiplier' END AS error FROM ({_POLICIES})")
def policy_errors(s, d):
    return _policies(s, d).select("p_partkey", scalars.policy_error(F.col("i"), F.col("base"), F.col("most"), F.col("multiplier")).alias("error"))


@own.add(
    "retry_plan",
    f"""SELECT p_partkey, CASE WHEN i >= 5 OR (p_partkey % 2 = 0 AND jitter = 'full') THEN 'give_up' ELSE 'retry_at' END AS plan,
        CASE WHEN i >= 5 OR (p_partkey % 2 = 0 AND jitter = 'full') THEN NULL ELSE {NOW_MS} + {_RAW} END AS at_ms FROM ({_POLICIES})""",
)
def retry_plan(s, d):
    p = _policies(s, d)
    may = filters.may_retry(F.col("i"), F.lit(5), F.col("p_partkey") % 2 == 0, F.col("jitter") != "full")
    at = F.lit(NOW_MS) + scalars.raw_delay(F.col("kind"), F.col("base"), F.col("most"), F.col("multiplier"), F.col("i"))
    return p.select("p_partkey", F.when(~may, "give_up").when(at <= NOW_MS, "retry_now").otherwise("retry_at").alias("plan"), F.when(may, at).alias("at_ms"))


@own.add("outbox_backoff", "SELECT id, CAST(500 * pow(2, least(attempts, 10)) AS BIGINT) AS delay_ms FROM outbox")
def outbox_backoff(s, d):
    return c.outbox(s, d).select("id", scalars.outbox_backoff(500, F.col("attempts")).alias("delay_ms"))


@own.add(
    "canary_bucket",
    """SELECT id, (list_reduce(list_transform(range(1, strlen(id) + 1), lambda i: ascii(substr(id, i::BIGINT, 1))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) % 100)::INT AS bucket FROM cur_runs""",
)
def canary_bucket(s, d):
    return c.current_runs(s, d).select("id", scalars.fnv1a_bucket(F.col("id")).alias("bucket"))


@own.add(
    "canary_version",
    """SELECT id, CASE WHEN w <= 0 THEN 1 WHEN w >= 100 THEN 2 WHEN bucket < w THEN 2 ELSE 1 END AS version FROM (SELECT id, length(tenant) % 3 * 50 AS w,
       (list_reduce(list_transform(range(1, strlen(id) + 1), lambda i: ascii(substr(id, i::BIGINT, 1))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) % 100)::INT AS bucket FROM cur_runs)""",
)
def canary_version(s, d):
    """Which of two versions each run gets, at weights of 0, 50 and 100 for the second."""
    weight = F.length("tenant") % 3 * 50
    return c.current_runs(s, d, "tenant").select("id", scalars.canary_version(F.col("id"), F.lit(1), F.lit(2), weight).alias("version"))


@own.add("base32_decode", "SELECT id, run_id || '::' || task_name AS text FROM cur_tasks WHERE run_id IS NOT NULL")
def base32_decode(s, d):
    """Ids made of run and task, read again."""
    rows = c.current_tasks(s, d, "run_id", "task_name").where("run_id IS NOT NULL")
    made = scalars.task_run_id(F.col("run_id"), F.col("task_name"))
    return rows.select("id", scalars.unbase32hex(F.substring(made, 4, 1 << 30)).alias("text"))


@own.add("id_validation", r"SELECT DISTINCT run_id, coalesce(starts_with(run_id, 'rn_') AND length(run_id) <= 96 AND regexp_full_match(substr(run_id, 4), '[0-9a-v]+') AND floor(length(substr(run_id, 4)) * 5 / 8.0) <= 24, false) AS valid FROM task_runs WHERE run_id IS NOT NULL")
def id_validation(s, d):
    rows = table(s, d, "task_runs").where("run_id IS NOT NULL").select("run_id").distinct()
    return rows.select("run_id", scalars.valid_id(F.col("run_id"), "rn_").alias("valid"))


@own.add("name_validation", "SELECT DISTINCT tenant, name, regexp_full_match(tenant, '[a-z][a-z0-9-]{0,47}') AS tenant_ok, regexp_full_match(name, '[a-z][a-z0-9-]{0,63}') AS name_ok FROM workflows")
def name_validation(s, d):
    rows = table(s, d, "workflows").select("tenant", "name").distinct()
    return rows.select("tenant", "name", scalars.valid_tenant(F.col("tenant")).alias("tenant_ok"), scalars.valid_name(F.col("name")).alias("name_ok"))


@own.add("handler_validation", r"SELECT DISTINCT handler, length(handler) <= 80 AND regexp_full_match(handler, '[a-z][a-z0-9-]*(\.[a-z0-9-]+)*') AS ok FROM ml_training")
def handler_validation(s, d):
    return table(s, d, "ml_training").select("handler").distinct().select("handler", scalars.valid_handler(F.col("handler")).alias("ok"))


@own.add("url_check", r"SELECT DISTINCT url, regexp_matches(url, '^(?i:https?)://[^/?#]+') AS ok FROM run_events WHERE url IS NOT NULL")
def url_check(s, d):
    rows = table(s, d, "run_events").where("url IS NOT NULL").select("url").distinct()
    return rows.select("url", scalars.valid_webhook_url(F.col("url")).alias("ok"))


_PICK = " + ".join(f"substr(bits, 5 * j::BIGINT + {k + 1}, 1)::INT * {16 >> k}" for k in range(5))


@own.add(
    "base32_ids",
    f"""SELECT id, 'tr_' || array_to_string(list_transform(range(0, strlen(bits) // 5), lambda j: substr('{scalars.BASE32_DIGITS}', 1 + {_PICK}, 1)), '') AS made
        FROM (SELECT id, rpad(b, ((strlen(b) + 4) // 5 * 5)::INT, '0') AS bits FROM (
          SELECT id, array_to_string(list_transform(range(1, strlen(t) + 1), lambda i: lpad(bin(ascii(substr(t, i::BIGINT, 1))), 8, '0')), '') AS b
          FROM (SELECT id, run_id || '::' || task_name AS t FROM cur_tasks WHERE run_id IS NOT NULL)))""",
)
def base32_ids(s, d):
    rows = c.current_tasks(s, d, "run_id", "task_name").where("run_id IS NOT NULL")
    return rows.select("id", scalars.task_run_id(F.col("run_id"), F.col("task_name")).alias("made"))


def _measures(root: str, where: str, text: str) -> str:
    """SQL of depth and size of the JSON at root in each run's document."""
    return f"""WITH RECURSIVE node AS (
        SELECT r.id AS run_id, t.id AS n, t.parent, t.key, t.type, t.atom FROM (SELECT id, {text}::JSON AS doc FROM run_docs WHERE {where}) r, json_tree(r.doc, '{root}') t),
      deep AS (SELECT run_id, n, 0 AS level FROM node WHERE n = (SELECT min(m.n) FROM node m WHERE m.run_id = node.run_id)
        UNION ALL SELECT k.run_id, k.n, d.level + 1 FROM deep d JOIN node k ON k.run_id = d.run_id AND k.parent = d.n)
      SELECT run_id, max(level + CASE WHEN type IN ('OBJECT', 'ARRAY') THEN 1 ELSE 0 END)::INT AS depth,
        sum(CASE WHEN level > 0 AND key IS NOT NULL AND parent_type = 'OBJECT' THEN strlen(key) ELSE 0 END + CASE type WHEN 'NULL' THEN 4 WHEN 'BOOLEAN' THEN 4 WHEN 'VARCHAR' THEN strlen(atom->>'$') + 2
          WHEN 'OBJECT' THEN 0 WHEN 'ARRAY' THEN 0 ELSE strlen(atom::VARCHAR) END)::BIGINT AS size
      FROM (SELECT d.run_id, d.level, k.type, k.atom, k.key, p.type AS parent_type FROM deep d JOIN node k ON k.run_id = d.run_id AND k.n = d.n LEFT JOIN node p ON p.run_id = k.run_id AND p.n = k.parent) GROUP BY 1"""


def _input_errors_sql(bytes_: int, depth: int) -> str:
    return f"""SELECT r.id, CASE WHEN m.size > {bytes_} THEN 'too_large' WHEN m.depth > {depth} THEN 'too_deep' END AS error
        FROM cur_runs r LEFT JOIN ({_measures("$.input", "json_valid(doc_text) AND json_type(doc_text) = 'OBJECT' AND json_exists(doc_text, '$.input')", "doc_text")}) m ON m.run_id = r.id"""


@own.add("run_input_errors", _input_errors_sql(60, 1))
def run_input_errors(s, d):
    """Inputs that break limits so small that those of the tables do."""
    return c.current_runs(s, d, "document").select("id", scalars.input_errors(60, 1)(F.col("document")).alias("error"))


@own.add("run_submission", f"SELECT id, coalesce(error, 'accepted') AS outcome FROM ({_input_errors_sql(1 << 20, 64)})")
def run_submission(s, d):
    """Every run submitted again: its input is tested by the limits of submissions before it is accepted."""
    return c.current_runs(s, d, "document").select("id", F.coalesce(scalars.input_errors()(F.col("document")), F.lit("accepted")).alias("outcome"))


@own.add("json_measures", f"SELECT r.id, m.depth, m.size FROM cur_runs r LEFT JOIN ({_measures('$', 'json_valid(document)', 'document')}) m ON m.run_id = r.id")
def json_measures(s, d):
    return c.current_runs(s, d, "document").select("id", scalars.json_measures(F.col("document")).alias("m")).select("id", "m.depth", "m.size")


@own.add(
    "error_log_lines",
    "SELECT id, '[' || CASE error.kind WHEN 'transient_failure' THEN 'transient' ELSE error.kind END || '] ' || coalesce(error.task || ': ', '') || error.message || ' (attempt ' || error.attempts || ')' AS line FROM cur_runs WHERE error IS NOT NULL",
)
def error_log_lines(s, d):
    e = F.col("error")
    return c.current_runs(s, d, "error").where(e.isNotNull()).select("id", scalars.log_line(e["kind"], e["task"], e["message"], e["attempts"]).alias("line"))


@own.add("csv_split", "SELECT p_partkey, list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> '')[2] AS second FROM part")
def csv_split(s, d):
    parts = scalars.split_list(F.concat("p_name", F.lit(", ,"), "p_type"))
    return table(s, d, "part").select("p_partkey", F.get(parts, F.lit(1)).alias("second"))


CRON = "*/15 6-18 1,15 * 1-5"


@own.add("cron_matches", "SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 6 AND 18 AND day(ts) IN (1, 15) AND dayofweek(ts) BETWEEN 1 AND 5")
def cron_matches(s, d):
    schedule = cron.Schedule.parse(CRON)
    return table(s, d, "events").where(schedule.matches(F.col("ts").cast("timestamp"))).select("event_id")


@own.add(
    "cron_next",
    "SELECT event_id, ((epoch_us(ts) // 60000000 // 15 + 1) * 15 * 60000)::BIGINT AS next_ms FROM events",
)
def cron_next(s, d):
    after = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(s, d, "events").select("event_id", cron.next_tick(F.lit("*/15 * * * *"), after).alias("next_ms"))


@own.add(
    "triggers_due",
    """SELECT tenant, name, ['*/15 * * * *', '*/15 6-18 1,15 * 1-5', '30 8 15 * 1'][k + 1] AS cron_expr, last_ms, min(epoch_us(day) // 1000 + m * 60000)::BIGINT AS next_ms
       FROM (SELECT b.*, unnest(generate_series(date_trunc('day', make_timestamp(last_ms * 1000)), date_trunc('day', make_timestamp(last_ms * 1000)) + [INTERVAL 2 DAY, INTERVAL 200 DAY, INTERVAL 1825 DAY][k + 1], INTERVAL 1 DAY)) AS day
             FROM (SELECT tenant, name, max(updated_at_ms) AS last_ms, length(name) % 3 AS k FROM workflows GROUP BY 1, 2) b)
       JOIN (SELECT 0 AS ks, unnest(range(0, 1440, 15)) AS m UNION ALL SELECT 1, unnest(range(360, 1140, 15)) UNION ALL SELECT 2, 510) ON ks = k
       WHERE epoch_us(day) // 1000 + m * 60000 > last_ms AND (k = 0 OR (k = 1 AND day(day) IN (1, 15) AND dayofweek(day) BETWEEN 1 AND 5) OR (k = 2 AND day(day) = 15 AND dayofweek(day) = 1))
       GROUP BY 1, 2, 3, 4""",
)
def triggers_due(s, d):
    """Every definition as a trigger on one of three schedules: when it fires next after its last version was stored."""
    crons = F.element_at(F.array(*map(F.lit, ["*/15 * * * *", CRON, "30 8 15 * 1"])), (F.length("name") % 3 + 1).cast("int"))
    last = table(s, d, "workflows").groupBy("tenant", "name").agg(F.max("updated_at_ms").alias("last_ms"))
    return last.withColumn("cron_expr", crons).select("tenant", "name", "cron_expr", "last_ms", cron.next_tick(F.col("cron_expr"), F.col("last_ms")).alias("next_ms"))


def _context():
    outputs = F.when(F.get_json_object("document", "$.output").isNotNull(), F.create_map(F.lit("self"), F.get_json_object("document", "$.output"))).otherwise(F.create_map(F.lit("self"), F.lit("null")))
    return Context(F.get_json_object("document", "$.input"), outputs, F.create_map(F.lit("tenant"), F.col("tenant")))


@own.add(
    "expr_eval",
    """SELECT id, coalesce((doc->'$.input.probe')::VARCHAR = 'true', false) AND (doc->>'$.input.window.days')::DOUBLE > 4 AND tenant <> 'harbor-grid' AS result FROM (
       SELECT id, tenant, doc_text::JSON AS doc FROM run_docs WHERE json_valid(doc_text) AND json_type(doc_text) = 'OBJECT')""",
)
def expr_eval(s, d):
    rows = c.run_documents(s, d, "tenant").where(F.get_json_object("document", "$.input.window.days").isNotNull())
    tree = Op("and", (Op("eq", (Variable("run.input.probe"), Literal(True))), Op("and", (Op("gt", (Variable("run.input.window.days"), Literal(4))), Op("ne", (Variable("meta.tenant"), Literal("harbor-grid")))))))
    value = compile_expression(tree, _context())
    return rows.select("id", (value["text"] == "true").alias("result"))


@own.add(
    "expr_errors",
    """SELECT id, CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN ((doc->>'$.output.n')::DOUBLE < 5)::VARCHAR END AS result,
       CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN NULL ELSE 'type mismatch: < requires comparable operands' END AS error
       FROM (SELECT id, doc, json_type(doc, '$.output.n') AS t FROM (SELECT id, CASE WHEN json_valid(doc_text) THEN doc_text::JSON END AS doc FROM run_docs WHERE document IS NOT NULL))""",
)
def expr_errors(s, d):
    rows = c.run_documents(s, d, "tenant").where("document IS NOT NULL")
    tree = Op("lt", (Variable("tasks.self.output.n"), Literal(5)))
    value = compile_expression(tree, _context())
    return rows.select("id", value["text"].alias("result"), value["error"].alias("error"))


@own.add(
    "expr_not",
    """SELECT id, CASE WHEN t = 'BOOLEAN' THEN (NOT (doc->>'$.input.probe')::BOOLEAN)::VARCHAR END AS result, CASE WHEN t = 'BOOLEAN' THEN NULL ELSE 'type mismatch: ! requires boolean operand' END AS error
       FROM (SELECT id, doc, json_type(doc, '$.input.probe') AS t FROM (SELECT id, doc_text::JSON AS doc FROM run_docs WHERE json_valid(doc_text) AND json_type(doc_text) = 'OBJECT'))""",
)
def expr_not(s, d):
    rows = c.run_documents(s, d, "tenant").where(F.get_json_object("document", "$.id").isNotNull())
    value = compile_expression(Op("not", (Variable("run.input.probe"),)), _context())
    return rows.select("id", value["text"].alias("result"), value["error"].alias("error"))


@own.add(
    "template_render",
    """SELECT id, '{"days": ' || (doc->>'$.input.window.days')::DOUBLE::VARCHAR || ', "list": [' || coalesce(doc->>'$.input.probe', 'null') || '], "text": "from ' || (doc->>'$.input.window.from') || ' by ' || tenant || '"}' AS result,
       NULL::VARCHAR AS error FROM (SELECT id, tenant, doc_text::JSON AS doc FROM run_docs WHERE json_valid(doc_text) AND json_type(doc_text) = 'OBJECT')""",
)
def template_render(s, d):
    rows = c.run_documents(s, d, "tenant").where(F.get_json_object("document", "$.input").isNotNull())
    template = F.lit('{"days": "${run.input.window.days}", "text": "from ${ run.input.window.from } by ${meta.tenant}", "list": ["${run.input.probe}"]}')
    filled = render_template(template, F.get_json_object("document", "$.input"), F.lit("{}"), F.to_json(F.create_map(F.lit("tenant"), F.col("tenant"))))
    return rows.select("id", filled.alias("r")).select("id", "r.result", "r.error")


@own.add(
    "handler_outcomes",
    """SELECT tenant, def_name, name, CASE split_part(handler, '.', 2) WHEN 'noop' THEN '{"ok":true}' WHEN 'delay' THEN '{"slept_ms":50}' WHEN 'echo' THEN '{"echo": null, "task": "' || name || '"}' END AS output,
       CASE WHEN split_part(handler, '.', 2) IN ('noop', 'delay', 'echo') THEN NULL ELSE 'permanent' END AS kind FROM ml_training""",
)
def handler_outcomes(s, d):
    rows = table(s, d, "ml_training").withColumn("h", F.split_part("handler", F.lit("."), F.lit(2)))
    outcome = with_builtins().column(F.col("h"), F.lit(None).cast("string"), F.col("name"), F.lit(1))
    return rows.select("tenant", "def_name", "name", outcome.alias("o")).select("tenant", "def_name", "name", "o.output", "o.kind")


@own.add(
    "handler_calls",
    """SELECT tenant, def_name, name, ['noop', 'echo', 'fail', 'delay', 'nobody'][length(name) % 5 + 1] AS handler,
         [NULL, NULL, 'rejected', NULL, 'permanent'][length(name) % 5 + 1] AS kind FROM ml_training""",
)
def handler_calls(s, d):
    """Every built-in handler, and one that nobody registered."""
    rows = table(s, d, "ml_training").withColumn("handler", F.element_at(F.array(*map(F.lit, ["noop", "echo", "fail", "delay", "nobody"])), F.length("name") % 5 + 1))
    outcome = with_builtins().column(F.col("handler"), F.lit('{"a": 1}'), F.col("name"), F.lit(1))
    return rows.select("tenant", "def_name", "name", "handler", outcome.alias("o")).select("tenant", "def_name", "name", "handler", "o.kind")


@own.add("http_classify", "SELECT o_orderkey, CASE WHEN o_orderkey % 600 >= 500 THEN 'transient_failure' WHEN o_orderkey % 600 >= 400 THEN 'permanent' ELSE 'ok' END AS outcome FROM orders")
def http_classify(s, d):
    return table(s, d, "orders").select("o_orderkey", http_outcome(F.col("o_orderkey") % 600).alias("outcome"))


# -------------------------------------------------------------------------------------------------- files and streams


@own.add("jsonl_roundtrip", "SELECT seq, timestamp_ms, tenant, action_name FROM audit_log")
def jsonl_roundtrip(s, d):
    path = shared_folder(s, "audit")
    files.append_audit_log(c.audit_log(s, d).withColumn("id", F.concat(F.lit("au_"), F.col("seq").cast("string"))), path)
    return files.read_audit_log(s, path).select("seq", "timestamp_ms", "tenant", "action_name")


@own.add("artifact_roundtrip", "SELECT DISTINCT id, size_bytes FROM doc_blobs")
def artifact_roundtrip(s, d):
    path = shared_folder(s, "artifacts")
    files.write_artifacts(table(s, d, "documents").where("text IS NOT NULL").select(F.encode("text", "UTF-8").alias("content")), path)
    return files.read_artifacts(s, path).select("id", F.octet_length("content").cast("bigint").alias("size_bytes"))


@own.add(
    "prometheus_text",
    f"""WITH h AS (SELECT b::DOUBLE::VARCHAR AS le, (SELECT count(*) FROM cur_runs WHERE finished_at_ms >= started_at_ms AND (finished_at_ms - started_at_ms) / 1000.0::DOUBLE <= b) AS n
        FROM (SELECT unnest({_BOUNDS}) AS b) UNION ALL SELECT '+Inf', count(*) FROM cur_runs WHERE finished_at_ms >= started_at_ms)
        SELECT 'run_duration_seconds_bucket' AS name, le AS label, i AS line_no, CASE i WHEN 0 THEN '# HELP weftline_run_duration_seconds_bucket How long runs took, in seconds'
          WHEN 1 THEN '# TYPE weftline_run_duration_seconds_bucket histogram' ELSE 'weftline_run_duration_seconds_bucket{{le="' || le || '"}} ' || n END AS line FROM h, (SELECT unnest([0, 1, 2]) AS i)""",
)
def prometheus_text(s, d):
    runs = c.current_runs(s, d, "status", "started_at_ms", "finished_at_ms")
    histogram = relational.cumulative_histogram(runs, (F.col("finished_at_ms") - F.col("started_at_ms")) / 1000)
    metrics = histogram.select(
        F.lit("run_duration_seconds_bucket").alias("name"), F.lit("histogram").alias("kind"), F.lit("How long runs took, in seconds").alias("help"),
        F.col("le").alias("label"), F.col("n").cast("string").alias("value"),
    )
    return files.metrics_text(metrics, "weftline")


#: Counters and gauges: name, kind, help, and its number in SQL.
_METRICS = [
    ("workflow_creations_total", "counter", "Definitions that were stored", "(SELECT count(*) FROM (SELECT DISTINCT tenant, name, version FROM workflows))"),
    ("run_submissions_total", "counter", "Runs that were accepted", "(SELECT count(DISTINCT id) FROM runs)"),
    ("run_cancellations_total", "counter", "Runs that were cancelled", "(SELECT count(*) FROM cur_runs WHERE status = 'cancelled')"),
    ("dispatches_total", "counter", "Attempts that were dispatched", "(SELECT coalesce(sum(attempts), 0)::BIGINT FROM cur_runs)"),
    ("watch_terminals_total", "counter", "Ends of runs the watcher saw", "(SELECT count(*) FROM cur_runs WHERE status IN ('succeeded', 'failed', 'timedout', 'cancelled') AND finished_at_ms IS NOT NULL)"),
    ("event_deliveries_total", "counter", "Deliveries that were tried", "(SELECT coalesce(sum(attempts), 0)::BIGINT FROM outbox)"),
    ("event_deliveries_ok_total", "counter", "Deliveries that went through", "(SELECT count(*) FROM outbox WHERE status = 'delivered')"),
    ("reaped_runs_total", "counter", "Old runs that were deleted", "(SELECT count(DISTINCT id) FROM runs WHERE deleted_at IS NOT NULL)"),
    ("lease_renewals_total", "counter", "Leases that are live", f"(SELECT count(*) FROM queue_entries WHERE lease_until_ms > {NOW_MS})"),
    ("queue_depth", "gauge", "Entries in the queue", "(SELECT count(*) FROM queue_entries)"),
    ("workflows", "gauge", "Definitions that stand", "(SELECT count(*) FROM cur_defs)"),
    ("runs", "gauge", "Runs that are stored", "(SELECT count(*) FROM cur_runs)"),
    ("uptime_seconds", "gauge", "Seconds since the start", "86400::BIGINT"),
]


@own.add(
    "prometheus_counters",
    "SELECT name, i AS line_no, CASE i WHEN 0 THEN '# HELP weftline_' || name || ' ' || help WHEN 1 THEN '# TYPE weftline_' || name || ' ' || kind ELSE 'weftline_' || name || ' ' || n END AS line FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS name, '{kind}' AS kind, '{about}' AS help, {sql} AS n" for name, kind, about, sql in _METRICS)
    + "), (SELECT unnest([0, 1, 2]) AS i)",
)
def prometheus_counters(s, d):
    """All counters and gauges as text; each comes from one aggregate of its table."""
    runs, stored = c.current_runs(s, d, "status", "attempts", "finished_at_ms"), table(s, d, "runs")
    status = F.col("status")
    per_table = [
        table(s, d, "workflows").select(*DEF_KEY).distinct().agg(F.count("*").alias("workflow_creations_total")),
        stored.agg(F.count_distinct("id").alias("run_submissions_total"), F.count_distinct(F.when(F.col("deleted_at").isNotNull(), F.col("id"))).alias("reaped_runs_total")),
        runs.agg(
            F.count_if(status == "cancelled").alias("run_cancellations_total"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("dispatches_total"),
            F.count_if(status.isin(*filters.TERMINAL_RUN) & F.col("finished_at_ms").isNotNull()).alias("watch_terminals_total"), F.count("*").alias("runs"),
        ),
        c.outbox(s, d).agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("event_deliveries_total"), F.count_if(status == "delivered").alias("event_deliveries_ok_total")),
        c.queue_entries(s, d).agg(F.count("*").alias("queue_depth"), F.count_if(F.col("lease_until_ms") > NOW_MS).alias("lease_renewals_total")),
        c.current_definitions(s, d).agg(F.count("*").alias("workflows")),
        s.range(1).select(F.lit(86_400).cast("bigint").alias("uptime_seconds")),
    ]
    kinds = F.create_map(*[F.lit(x) for name, kind, _, _ in _METRICS for x in (name, kind)])
    helps = F.create_map(*[F.lit(x) for name, _, about, _ in _METRICS for x in (name, about)])
    rows = None
    for one in per_table:
        long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").cast("string").alias("value")) for n in one.columns])).alias("m")).select("m.name", "m.value")
        rows = long if rows is None else rows.unionByName(long)
    metrics = rows.select("name", kinds[F.col("name")].alias("kind"), helps[F.col("name")].alias("help"), F.lit(None).cast("string").alias("label"), "value")
    return files.metrics_text(metrics, "weftline").select("name", "line_no", "line")


@own.add(
    "webhook_deliveries",
    r"""SELECT seq, CASE WHEN url IS NULL OR NOT regexp_matches(url, '^(?i:https?)://[^/?#]+') THEN 'invalid_url' WHEN seq % 4 < 2 THEN 'sent' ELSE 'refused' END AS outcome FROM run_events""",
)
def webhook_deliveries(s, d):
    """All messages delivered from a stream to a sink that answers 200, 302, 404 and 503 in turn, and what was recorded."""
    status = F.element_at(F.array(*map(F.lit, [200, 302, 404, 503])), (F.col("seq") % 4 + 1).cast("int"))
    send = lambda batch: batch.select("seq", webhook_outcome(F.col("url"), status).alias("outcome"))
    return pipelines.recorded(pipelines.read_stream(s, f"{d}/run_events.parquet"), send, "deliveries").select("seq", "outcome")


@own.add(
    "spec_files",
    """SELECT doc->>'$.name' AS name, coalesce(try_cast(doc->>'$.version' AS INT), 1) AS version, coalesce(doc->>'$.description', '') AS description,
         coalesce(try_cast(coalesce(doc->>'$.timeout_ms', doc->>'$.timeoutMs') AS BIGINT), 60000) AS timeout_ms, coalesce(doc->>'$.default_priority', doc->>'$.defaultPriority', 'normal') AS default_priority
       FROM (SELECT DISTINCT tenant, name, version, doc::JSON AS doc FROM defs_read WHERE json_valid(doc) AND json_type(doc) = 'OBJECT')""",
)
def spec_files(s, d):
    """Definitions written as files of specifications, a line each, and read from them."""
    path = shared_folder(s, "specs")
    read = graph.per_definition(table(s, d, "workflows"), DEF_KEY, lambda r, g, value: [(structural.written(value),)], "document STRING")
    read.distinct().select("document").write.text(path)
    return files.read_workflow_specs(s, path, lines=True).select("name", "version", "description", "timeout_ms", "default_priority")


@own.add("stored_runs", "SELECT tenant, count(*) AS n FROM cur_runs GROUP BY 1")
def stored_runs(s, d):
    """Runs stored as a table of the catalogue and read from it."""
    return stored(c.current_runs(s, d, "tenant"), "weftline_stored_runs").groupBy("tenant").agg(F.count("*").alias("n"))


@own.add(
    "watcher_events",
    f"""SELECT DISTINCT CASE WHEN status = 'running' THEN 0 ELSE 1 END AS phase, CASE WHEN status = 'running' THEN started_at_ms ELSE finished_at_ms END AS at_ms, id AS run_id,
        CASE WHEN status = 'running' THEN 'run.started' ELSE {_KIND} END AS kind FROM runs
        WHERE (status = 'running' AND started_at_ms > 1808000000000) OR (status IN ('succeeded', 'failed', 'timedout', 'cancelled') AND finished_at_ms > 1809000000000)""",
)
def watcher_events(s, d):
    changed = pipelines.change_events(pipelines.read_stream(s, f"{d}/runs.parquet"), 1_808_000_000_000, 1_809_000_000_000)
    return pipelines.drain(changed, "watcher").select("phase", "at_ms", "run_id", "kind").distinct()


@own.add("stream_dedup", "SELECT DISTINCT run_id, lower(kind) AS kind FROM run_events")
def stream_dedup(s, d):
    first = pipelines.first_deliveries(pipelines.read_stream(s, f"{d}/run_events.parquet"))
    return pipelines.drain(first.select("run_id", "kind", "event_time"), "dedup").select("run_id", "kind")


@own.add(
    "late_events",
    "SELECT count(*) AS n FROM (SELECT received_at, max(received_at) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM run_events) WHERE epoch_us(received_at) < epoch_us(before) - 86400000000",
)
def late_events(s, d):
    """How many events a watermark of a day may drop."""
    return pipelines.too_late(table(s, d, "run_events"), 86_400)


@own.add("batch_windows", "SELECT lower(kind) AS kind, (epoch_us(date_trunc('hour', received_at)) // 1000)::BIGINT AS hour_ms, count(*) AS n FROM run_events GROUP BY 1, 2")
def batch_windows(s, d):
    counted = pipelines.hourly_counts(table(s, d, "run_events"))
    return counted.select("kind", F.unix_millis("w.start").alias("hour_ms"), "n")


@own.add(
    "stream_leaky_bucket",
    f"""SELECT * FROM (WITH RECURSIVE req AS (SELECT id, tenant AS key, created_at_ms AS at_ms, row_number() OVER (PARTITION BY tenant ORDER BY created_at_ms, id) AS rn FROM runs),
        {_BUCKET_FOLD} SELECT id, key, at_ms, accepted FROM fold)""",
)
def stream_leaky_bucket(s, d):
    requests = pipelines.read_stream(s, f"{d}/runs.parquet", bytes_per_trigger=256 << 20).select("id", F.col("tenant").alias("key"), F.col("created_at_ms").alias("at_ms"), F.lit(1.0).alias("cost"))
    return pipelines.drain(pipelines.limited_stream(requests, 5.0, 0.001), "limited")
