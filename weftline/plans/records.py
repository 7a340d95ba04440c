"""Further queries over single records: defaults, envelopes, labels, lookups, transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.handlers import with_builtins
from weftline.functions.scalars import parse_tags, unwrapped
from weftline.operators import filters, graph, lifecycle
from weftline.operators.relational import status_bucket
from weftline.plans import catalogue as c, reference
from weftline.plans.catalogue import NOW_MS, Catalogue
from weftline.plans.reference import DEF_KEY, RUN_EDGES
from weftline.plans.reference import SQL as REFERENCE_SQL
from weftline.session import table

own = Catalogue()
QUERIES, SQL = own.queries, own.sql

#: Failure kinds that may be retried, and the one whose code differs from its name (fixed values).
RETRYABLE = ("transient_failure", "timeout", "handler_crash")
#: Error categories with their status codes (fixed values).
ERROR_CATEGORIES = {"validation": 400, "config": 400, "not_found": 404, "conflict": 409, "state_machine": 409, "handler": 502, "storage": 500, "scheduler": 500, "server": 500, "internal": 500}
#: Status codes with the code of the other protocol; any other status is Internal (fixed values).
GRPC_CODES = {400: "InvalidArgument", 401: "Unauthenticated", 403: "PermissionDenied", 404: "NotFound", 409: "FailedPrecondition", 502: "Unavailable"}
DEFAULT_TIMEOUT_MS = 60_000


@own.add(
    "spec_defaults",
    """SELECT DISTINCT tenant, name, version, coalesce(doc->>'$.description', doc->>'$.summary', doc->>'$.desc', '') AS description,
       coalesce(try_cast(coalesce(doc->>'$.timeout_ms', doc->>'$.timeoutMs', doc->>'$.deadline_ms') AS BIGINT), 60000) AS timeout_ms,
       coalesce(doc->>'$.default_priority', doc->>'$.defaultPriority', doc->>'$.priority', 'normal') AS priority, coalesce(try_cast(doc->>'$.version' AS INT), 1) AS own_version,
       CASE json_type(doc, '$.meta') WHEN 'OBJECT' THEN len(json_keys(doc, '$.meta')) ELSE 0 END::INT AS n_meta,
       coalesce(len(list_filter(json_extract(doc, '$.tasks[*]'), lambda t: coalesce(json_type(t, '$.input'), 'NULL') = 'NULL')), 0)::INT AS default_inputs
       FROM (SELECT tenant, name, version, doc::JSON AS doc FROM defs_read WHERE json_valid(doc) AND json_type(doc) = 'OBJECT')""",
)
def spec_defaults(s, d):
    """Definitions with their defaults, whatever a file calls the fields: text, timeout, priority, version, an empty map of
    metadata, and an empty input for each task without one (default_inputs counts them)."""
    text = F.col("document")
    field = lambda *names: F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])
    rows = table(s, d, "workflows").withColumn("document", unwrapped(text)).where(F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("{")))
    tasks = F.from_json(F.get_json_object(text, "$.tasks"), "array<struct<input: string>>")
    return rows.select(
        *DEF_KEY, F.coalesce(field("description", "summary", "desc"), F.lit("")).alias("description"),
        F.coalesce(field("timeout_ms", "timeoutMs", "deadline_ms").try_cast("bigint"), F.lit(DEFAULT_TIMEOUT_MS)).alias("timeout_ms"),
        F.coalesce(field("default_priority", "defaultPriority", "priority"), F.lit("normal")).alias("priority"),
        F.coalesce(field("version").try_cast("int"), F.lit(1)).alias("own_version"),
        F.coalesce(F.size(F.json_object_keys(F.get_json_object(text, "$.meta"))), F.lit(0)).alias("n_meta"),
        F.coalesce(F.size(F.filter(tasks, lambda t: t["input"].isNull())), F.lit(0)).alias("default_inputs"),
    ).distinct()


@own.add(
    "effective_retries",
    f"""SELECT DISTINCT tenant, name, version, value->>'$.name' AS task,
          coalesce({", ".join(f"try_cast(value->>'$.retry.{k}' AS INT)" for k in ("max_attempts", "maxAttempts", "tries"))}, {", ".join(f"try_cast(doc->>'$.retry.{k}' AS INT)" for k in ("max_attempts", "maxAttempts", "tries"))}, 3) AS max_attempts
        FROM (SELECT tenant, name, version, doc::JSON AS doc FROM defs_read WHERE json_valid(doc)), json_each(doc, '$.tasks') WHERE type = 'OBJECT'""",
)
def effective_retries(s, d):
    """Of each task the attempts its own retry policy allows, else its definition's, else the default."""

    def attempts(holder):
        retry = holder.get("retry") if isinstance(holder.get("retry"), dict) else {}
        found = (retry.get(k) for k in ("max_attempts", "maxAttempts", "tries"))
        return next((int(x) for x in found if isinstance(x, (int, str)) and str(x).isdigit()), None)

    def rows(records, _, value):
        whole = attempts(value)
        for t in records:
            mine = attempts(t)
            yield str(t.get("name")), mine if mine is not None else whole if whole is not None else graph.RETRY_DEFAULTS["max_attempts"]

    return graph.per_definition(table(s, d, "workflows"), DEF_KEY, rows, "task STRING, max_attempts INT").distinct()


_WHOLE = "coalesce(" + ", ".join(f"try_cast(doc->>'$.{k}' AS BIGINT)" for k in ("timeout_ms", "timeoutMs", "deadline_ms")) + f", {DEFAULT_TIMEOUT_MS})"


@own.add(
    "effective_timeouts",
    f"""SELECT DISTINCT tenant, name, version, value->>'$.name' AS task, coalesce(try_cast(value->>'$.timeout_ms' AS BIGINT), {_WHOLE}) AS timeout_ms
        FROM (SELECT tenant, name, version, doc::JSON AS doc FROM defs_read WHERE json_valid(doc)), json_each(doc, '$.tasks') WHERE type = 'OBJECT'""",
)
def effective_timeouts(s, d):
    """Of each task its own timeout, else its definition's, else the default."""

    def number(value):
        if isinstance(value, str) and value.isdigit():
            return int(value)
        return value if isinstance(value, int) and not isinstance(value, bool) else None

    def rows(records, _, value):
        whole = next((n for k in ("timeout_ms", "timeoutMs", "deadline_ms") if (n := number(value.get(k))) is not None), DEFAULT_TIMEOUT_MS)
        for t in records:
            mine = number(t.get("timeout_ms"))
            yield str(t.get("name")), whole if mine is None else mine

    return graph.per_definition(table(s, d, "workflows"), DEF_KEY, rows, "task STRING, timeout_ms BIGINT").distinct()


@own.add("envelopes", """SELECT id, '{"specVersion":1,"data":{"id":"' || id || '","status":"' || status || '"}}' AS body FROM cur_runs""")
def envelopes(s, d):
    body = F.to_json(F.struct(F.lit(1).alias("specVersion"), F.struct("id", "status").alias("data")))
    return c.current_runs(s, d, "status").select("id", body.alias("body"))


@own.add("envelope_pretty", """SELECT id, '{\n  "specVersion" : 1,\n  "data" : {\n    "id" : "' || id || '",\n    "status" : "' || status || '"\n  }\n}' AS body FROM cur_runs""")
def envelope_pretty(s, d):
    """Envelopes as they are shown to people."""
    body = F.to_json(F.struct(F.lit(1).alias("specVersion"), F.struct("id", "status").alias("data")), {"pretty": "true"})
    return c.current_runs(s, d, "status").select("id", body.alias("body"))


@own.add("health_view", f"SELECT 'ok' AS status, {NOW_MS - 86_400_000}::BIGINT AS booted_at_ms, {NOW_MS}::BIGINT AS now_ms, count(*) AS queue_depth, 1 AS spec_version FROM queue_entries")
def health_view(s, d):
    return c.queue_entries(s, d).agg(F.count("*").alias("queue_depth")).select(
        F.lit("ok").alias("status"), F.lit(NOW_MS - 86_400_000).alias("booted_at_ms"), F.lit(NOW_MS).alias("now_ms"), "queue_depth", F.lit(1).alias("spec_version")
    )


@own.add(
    "error_kinds",
    "SELECT CASE error.kind WHEN 'transient_failure' THEN 'transient' ELSE error.kind END AS code, error.kind IN ('transient_failure', 'timeout', 'handler_crash') AS retryable, count(*) AS n FROM cur_runs WHERE error IS NOT NULL GROUP BY 1, 2",
)
def error_kinds(s, d):
    kind = F.col("error.kind")
    code = F.when(kind == "transient_failure", "transient").otherwise(kind)
    return c.current_runs(s, d, "error").where("error IS NOT NULL").groupBy(code.alias("code"), kind.isin(*RETRYABLE).alias("retryable")).agg(F.count("*").alias("n"))


@own.add("status_labels", "SELECT status, CASE WHEN status = 'timedout' THEN 'timed out' ELSE status END AS label, status IN ('succeeded', 'failed', 'cancelled', 'timedout') AS terminal, count(*) AS n FROM cur_runs GROUP BY 1")
def status_labels(s, d):
    status = F.col("status")
    counted = c.current_runs(s, d, "status").groupBy("status").agg(F.count("*").alias("n"))
    return counted.select("status", F.when(status == "timedout", "timed out").otherwise(status).alias("label"), status.isin(*filters.TERMINAL_RUN).alias("terminal"), "n")


@own.add("recent_runs", "SELECT id, coalesce(finished_at_ms, created_at_ms) AS finished_ms, CASE WHEN status IN ('succeeded', 'running', 'queued') THEN status ELSE 'failed' END AS badge FROM cur_runs ORDER BY created_at_ms DESC, id LIMIT 20")
def recent_runs(s, d):
    rows = filters.RunFilter(limit=20).page(c.current_runs(s, d, "created_at_ms", "finished_at_ms", "status"))
    return rows.select("id", F.coalesce("finished_at_ms", "created_at_ms").alias("finished_ms"), status_bucket(F.col("status")).alias("badge"))


@own.add("definitions_lost", "SELECT r.id FROM cur_runs r ANTI JOIN cur_defs w ON r.tenant = w.tenant AND r.def_name = w.name")
def definitions_lost(s, d):
    """Runs without a definition; the version a run was submitted with does not matter here."""
    return c.current_runs(s, d, "tenant", "def_name").withColumnRenamed("def_name", "name").join(c.current_definitions(s, d), ["tenant", "name"], "left_anti").select("id")


@own.add("queued_runs", "SELECT q.run_id, r.tenant, r.attempts, q.due_at_ms FROM queue_entries q JOIN cur_runs r ON q.run_id = r.id")
def queued_runs(s, d):
    return c.queue_entries(s, d).join(c.current_runs(s, d, "tenant", "attempts"), F.col("run_id") == F.col("id")).select("run_id", "tenant", "attempts", "due_at_ms")


@own.add("unknown_handlers", "SELECT split_part(handler, '.', 2) AS handler, count(*) AS n FROM ml_training WHERE split_part(handler, '.', 2) NOT IN ('noop', 'echo', 'fail', 'delay') GROUP BY 1")
def unknown_handlers(s, d):
    short = F.split_part("handler", F.lit("."), F.lit(2)).alias("handler")
    known = s.createDataFrame([(n,) for n in with_builtins().names()], "handler STRING")
    return table(s, d, "ml_training").groupBy(short).agg(F.count("*").alias("n")).join(F.broadcast(known), "handler", "left_anti")  # the registry


@own.add("alias_targets", "SELECT tenant, name, 'previous' AS alias, max(version) AS version FROM (SELECT DISTINCT w.tenant, w.name, w.version FROM workflows w JOIN cur_defs k ON w.tenant = k.tenant AND w.name = k.name AND w.version < k.version WHERE w.deleted_at IS NULL) GROUP BY 1, 2")
def alias_targets(s, d):
    """The alias of each definition's version before the current one."""
    now = c.current_definitions(s, d).withColumnRenamed("version", "current")
    older = table(s, d, "workflows").where("deleted_at IS NULL").join(now, ["tenant", "name"]).where("version < current")
    return older.groupBy("tenant", "name").agg(F.max("version").alias("version")).select("tenant", "name", F.lit("previous").alias("alias"), "version")


@own.add("failing_tasks", "SELECT run_id, min(task_name) AS first_failed, arg_min(coalesce(last_error, 'task failed'), (task_name, id)) AS message, string_agg(DISTINCT task_name, ',' ORDER BY task_name) AS failed FROM cur_tasks WHERE status = 'failed' AND run_id IS NOT NULL GROUP BY 1")
def failing_tasks(s, d):
    """Of each run its first failing task by name with that task's message, and all failing ones."""
    failed = c.current_tasks(s, d, "run_id", "task_name", "status", "last_error").where("status = 'failed' AND run_id IS NOT NULL")
    first = F.min(F.struct("task_name", "id", F.coalesce("last_error", F.lit("task failed")).alias("message"))).alias("f")
    by_run = failed.groupBy("run_id").agg(first, F.array_join(F.array_sort(F.collect_set("task_name")), ",").alias("failed"))
    return by_run.select("run_id", F.col("f.task_name").alias("first_failed"), F.col("f.message").alias("message"), "failed")


@own.add(
    "dispatch_step",
    f"SELECT run_id, due_at_ms, {NOW_MS + 60000}::BIGINT AS lease_until_ms FROM queue_entries WHERE due_at_ms <= {NOW_MS} AND (lease_until_ms IS NULL OR lease_until_ms <= {NOW_MS}) AND token = '' ORDER BY due_at_ms, run_id LIMIT 128",
)
def dispatch_step(s, d):
    """One step of the dispatcher: the ready entries, at most a batch of 128, claimed and leased."""
    ready = filters.scan_ready(c.queue_entries(s, d).where("token = ''"), NOW_MS, 128)
    commands = ready.select("run_id", F.concat(F.lit("ct_"), "run_id").alias("command_token"))
    return lifecycle.claim(ready, commands, NOW_MS, 60_000).where("outcome = 'claimed'").select("run_id", "due_at_ms", "lease_until_ms")


@own.add("artifact_list", "SELECT id, arg_max(name, (created_at_ms, name)) AS name FROM doc_blobs GROUP BY id HAVING arg_max(coalesce(tenant, ''), (created_at_ms, name)) = 'dag-clinic'")
def artifact_list(s, d):
    return c.document_blobs(s, d).where("tenant = 'dag-clinic'").select("id", "name")


@own.add("tag_text", "SELECT id, cardinality(tags) AS n, tags['team'] AS team FROM cur_runs WHERE cardinality(tags) > 0")
def tag_text(s, d):
    """Tags written as key=value and read again; a repeated key would be an error."""
    text = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    rows = c.current_runs(s, d, "tags").where(F.size("tags") > 0).select("id", F.str_to_map(text, F.lit(","), F.lit("=")).alias("t"))
    return rows.select("id", F.size("t").cast("bigint").alias("n"), F.try_element_at("t", F.lit("team")).alias("team"))


@own.add(
    "tag_errors",
    """SELECT id, CASE WHEN length(id) % 3 = 0 THEN 'no_value' WHEN length(tenant) % 2 = 0 AND map_contains(tags, 'team') THEN 'duplicate_key' END AS error,
         CASE WHEN length(id) % 3 = 0 OR (length(tenant) % 2 = 0 AND map_contains(tags, 'team')) THEN NULL ELSE cardinality(tags) + CASE WHEN length(tenant) % 2 = 0 THEN 1 ELSE 0 END END::BIGINT AS n
       FROM cur_runs WHERE cardinality(tags) > 0""",
)
def tag_errors(s, d):
    """Tags written as text and read again, some of them with a key that comes twice or a part that is no tag."""
    text = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), ", ")
    text = F.concat(text, F.when(F.length("tenant") % 2 == 0, ",team=more").otherwise(""), F.when(F.length("id") % 3 == 0, ",plain").otherwise(""))
    rows = c.current_runs(s, d, "tenant", "tags").where(F.size("tags") > 0)
    tags, error = parse_tags(text)
    return rows.select("id", error.alias("error"), F.size(tags).cast("bigint").alias("n")).select("id", "error", F.when(F.col("n") >= 0, F.col("n")).alias("n"))


@own.add("runs_view", "SELECT tenant, status, count(*) AS n FROM cur_runs GROUP BY 1, 2 HAVING count(*) > 1")
def runs_view(s, d):
    """Runs as a view in memory that is asked in SQL."""
    c.current_runs(s, d, "tenant", "status").createOrReplaceTempView("weftline_runs")
    return s.sql("SELECT tenant, status, count(*) AS n FROM weftline_runs GROUP BY tenant, status HAVING count(*) > 1")


@own.add(
    "event_transitions",
    "SELECT status, status IN ('succeeded', 'failed', 'cancelled', 'timedout') AS legal, count(*) AS n FROM run_events WHERE lower(kind) <> 'run.started' GROUP BY 1",
)
def event_transitions(s, d):
    """Whether the state each end event reports can be reached from running."""
    edges = s.createDataFrame([(b,) for a, b in RUN_EDGES if a == "running"], "status STRING").withColumn("legal", F.lit(True))
    counted = table(s, d, "run_events").where(F.lower("kind") != "run.started").groupBy("status").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(edges), "status", "left").select("status", F.coalesce("legal", F.lit(False)).alias("legal"), "n")  # the edge table


_REACHED = ", ".join(f"('{a}', '{b}')" for a, b in RUN_EDGES)


@own.add(
    "transition_apply",
    f"""SELECT id, from_state, to_state, CASE WHEN from_state = to_state THEN 'same' WHEN (from_state, to_state) IN ({_REACHED}) THEN 'applied' ELSE 'rejected' END AS outcome,
          CASE WHEN (from_state, to_state) IN ({_REACHED}) THEN to_state ELSE from_state END AS state
        FROM (SELECT r.id, r.status AS from_state, e.status AS to_state FROM cur_runs r JOIN (SELECT run_id, arg_max(status, seq) AS status FROM run_events GROUP BY 1) e ON e.run_id = r.id)""",
)
def transition_apply(s, d):
    """The state of each run after the state its last event reports was applied to it: illegal steps leave it as it is."""
    last = table(s, d, "run_events").groupBy("run_id").agg(F.max_by("status", "seq").alias("to_state"))
    runs = c.current_runs(s, d, "status").withColumnsRenamed({"id": "run_id", "status": "from_state"}).join(last, "run_id")
    edges = s.createDataFrame([(a, b, True) for a, b in RUN_EDGES], "from_state STRING, to_state STRING, legal BOOLEAN")
    both = runs.join(F.broadcast(edges), ["from_state", "to_state"], "left")  # the edge table
    outcome = F.when(F.col("from_state") == F.col("to_state"), "same").when(F.col("legal"), "applied").otherwise("rejected")
    return both.select(F.col("run_id").alias("id"), "from_state", "to_state", outcome.alias("outcome"), F.when(F.col("legal"), F.col("to_state")).otherwise(F.col("from_state")).alias("state"))


def _answers(errors):
    """errors (request, id, category) with the codes that answer them."""
    statuses = F.create_map(*[F.lit(x) for pair in ERROR_CATEGORIES.items() for x in pair])
    codes = F.create_map(*[F.lit(x) for pair in GRPC_CODES.items() for x in pair])
    answered = errors.withColumn("http_status", F.coalesce(statuses[F.col("category")], F.lit(500)))
    return answered.withColumn("grpc_code", F.coalesce(F.try_element_at(codes, F.col("http_status")), F.lit("Internal")))


@own.add(
    "error_responses",
    f"""SELECT 'define' AS request, tenant || '/' || name || '/' || version AS id, 'validation' AS category, 400 AS http_status, 'InvalidArgument' AS grpc_code FROM ({REFERENCE_SQL["definition_errors"]})
        UNION ALL SELECT 'move', id, 'state_machine', 409, 'FailedPrecondition' FROM ({SQL["transition_apply"]}) WHERE outcome = 'rejected'
        UNION ALL SELECT 'raise', tenant || '/' || name, CASE outcome WHEN 'missing' THEN 'not_found' ELSE 'conflict' END, CASE outcome WHEN 'missing' THEN 404 ELSE 409 END,
          CASE outcome WHEN 'missing' THEN 'NotFound' ELSE 'FailedPrecondition' END FROM ({REFERENCE_SQL["version_cas"]}) WHERE outcome IN ('missing', 'conflict')""",
)
def error_responses(s, d):
    """What answers every broken definition, illegal step of a run, and lost or conflicting update."""
    broken = reference.definition_errors(s, d).select(F.lit("define").alias("request"), F.concat_ws("/", *DEF_KEY).alias("id"), F.lit("validation").alias("category"))
    illegal = transition_apply(s, d).where("outcome = 'rejected'").select(F.lit("move"), "id", F.lit("state_machine"))
    updates = reference.version_cas(s, d).where("outcome IN ('missing', 'conflict')")
    lost = updates.select(F.lit("raise"), F.concat_ws("/", "tenant", "name"), F.when(F.col("outcome") == "missing", "not_found").otherwise("conflict"))
    return _answers(broken.union(illegal).union(lost))


@own.add(
    "placeholders",
    r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all('${run.input.' || p_brand || '} ${ meta.' || p_type || ' } ${} ${open', '\$\{([^}]*)\}', 1), lambda x: trim(x)), lambda x: x <> ''))), ',') AS refs FROM part",
)
def placeholders(s, d):
    text = F.concat(F.lit("${run.input."), "p_brand", F.lit("} ${ meta."), "p_type", F.lit(" } ${} ${open"))
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\$\{([^}]*)\}"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return table(s, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("refs"))


@own.add("run_document_codec", "SELECT id, doc->>'$.status' AS status, (doc->>'$.attempts')::INT AS attempts, (doc->>'$.created_at_ms')::BIGINT AS created_at_ms FROM (SELECT id, doc_text::JSON AS doc FROM run_docs WHERE json_valid(doc_text) AND json_type(doc_text) = 'OBJECT')")
def run_document_codec(s, d):
    """Run documents decoded into typed columns; what cannot be read gives no row."""
    rows = c.run_documents(s, d).where(F.try_parse_json("document").isNotNull())
    parsed = rows.select("id", F.from_json("document", "id STRING, status STRING, attempts INT, created_at_ms BIGINT").alias("r"))
    return parsed.where("r.id IS NOT NULL").select("id", "r.status", "r.attempts", "r.created_at_ms")


@own.add("workflow_upsert", "SELECT tenant, name, max(version) + 1 AS version FROM cur_defs GROUP BY 1, 2 UNION ALL SELECT tenant, 'fresh-' || name, 1 FROM cur_defs")
def workflow_upsert(s, d):
    """Definitions after new versions and new definitions were appended: the greatest version of each name stands."""
    now = c.current_definitions(s, d)
    added = now.select("tenant", "name", (F.col("version") + 1).alias("version")).unionByName(now.select("tenant", F.concat(F.lit("fresh-"), "name").alias("name"), F.lit(1).alias("version")))
    return now.unionByName(added).groupBy("tenant", "name").agg(F.max("version").alias("version"))
