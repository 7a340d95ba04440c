"""A catalogue of queries with their SQL, and the views both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.relational import latest_per_key
from weftline.session import table

#: The time at which time-dependent queries look at the tables.
NOW_MS = 1_815_000_000_000


class Catalogue:
    def __init__(self, views: str = ""):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}
        self.views = views

    def add(self, name: str, sql: str | None = None, recursive: bool = False):
        def keep(query):
            self.queries[name] = query
            if sql is not None:
                needed = self._needed(sql)
                start = "WITH RECURSIVE " if recursive else "WITH "
                if needed and sql.startswith("WITH "):
                    sql_text = start + needed + ",\n" + sql.removeprefix("WITH ")
                else:
                    sql_text = (start + needed + "\n" if needed else "") + sql
                self.sql[name] = sql_text
            return query

        return keep

    def _needed(self, sql: str) -> str:
        """The shared views a statement names, with those they name."""
        wanted, todo = [], [sql]
        while todo:
            text = todo.pop()
            for name in VIEWS:
                if name in text and name not in wanted:
                    wanted.append(name)
                    todo.append(VIEWS[name])
        return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted)


#: Views by name; a view may only name the ones before it.
VIEWS = {
    "cur_runs": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM runs) WHERE rn = 1 AND deleted_at IS NULL""",
    "cur_tasks": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM task_runs) WHERE rn = 1""",
    "cur_defs": """SELECT tenant, name, max(version) AS version FROM (SELECT tenant, name, version, max(deleted_at) AS gone FROM workflows GROUP BY 1, 2, 3) WHERE gone IS NULL GROUP BY 1, 2""",
    "audit_log": """SELECT event_id AS seq, epoch_us(ts) // 1000 AS timestamp_ms,
        CASE WHEN user_id % 11 <> 0 THEN 't' || (user_id % 5) END AS tenant,
        CASE user_id % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'user' WHEN 2 THEN 'token' ELSE 'anonymous' END AS actor_kind,
        event_type AS action_name, CASE WHEN event_id % 10 = 0 THEN 'failure' WHEN event_id % 10 = 1 THEN 'denied' ELSE 'success' END AS status,
        CASE WHEN value > 10 THEN 'run' ELSE 'workflow' END AS resource_type, user_id::VARCHAR AS resource_id FROM events""",
    "run_docs": """SELECT *, CASE WHEN json_valid(document) AND json_type(document) = 'VARCHAR' THEN json_extract_string(document, '$') ELSE document END AS doc_text FROM cur_runs""",
    "queue_entries": """SELECT id AS run_id, CASE WHEN status = 'running' THEN 'ct_' || substr(id, 4, 6) ELSE '' END AS token,
        coalesce(next_attempt_at_ms, created_at_ms) AS due_at_ms,
        CASE WHEN status = 'running' THEN started_at_ms + 2000000000 END AS lease_until_ms,
        CASE WHEN status = 'running' THEN 'dispatcher' END AS claimed_by FROM cur_runs WHERE status IN ('queued', 'running')""",
    "claims": """SELECT run_id, 'ct_' || substr(run_id, 4, 6) AS command_token FROM queue_entries WHERE ascii(substr(run_id, 5, 1)) % 2 = 0""",
    "outbox": """SELECT id, attempts, 3 AS max_attempts, created_at_ms + CAST(500 * pow(2, least(attempts, 10)) AS BIGINT) AS next_attempt_at_ms,
        CASE WHEN attempts >= 3 THEN 'dead_letter' WHEN lower(kind) = 'run.started' THEN 'delivered' ELSE 'pending' END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM run_events WHERE id <> '') WHERE rn = 1""",
    "doc_blobs": """SELECT sha256(text) AS id, source AS tenant, doc_id::VARCHAR AS name, octet_length(encode(text)) AS size_bytes,
        epoch_us(posted_at) // 1000 AS created_at_ms FROM documents WHERE text IS NOT NULL""",
    "defs_read": """SELECT DISTINCT tenant, name, version, CASE WHEN json_type(document) = 'VARCHAR' THEN json_extract_string(document, '$') ELSE document END AS doc
        FROM workflows WHERE json_valid(document)""",
    "def_task": """SELECT tenant, name, version, task, arg_min(handler, i) AS handler, arg_min(deps, i) AS deps FROM (
        SELECT tenant, name, version, key::INT AS i, value->>'$.name' AS task,
          coalesce(value->>'$.handler', value->>'$.handler_id', value->>'$.uses') AS handler,
          coalesce(CASE json_type(dep) WHEN 'ARRAY' THEN (dep->>'$[*]')
            WHEN 'VARCHAR' THEN list_filter(list_transform(string_split(dep->>'$', ','), lambda x: trim(x)), lambda x: x <> '') END, []) AS deps
        FROM (SELECT *, coalesce(nullif(value->'$.depends_on', 'null'), nullif(value->'$.dependsOn', 'null'), nullif(value->'$.needs', 'null')) AS dep
              FROM (SELECT tenant, name, version, doc::JSON AS doc FROM defs_read WHERE json_valid(doc)), json_each(doc, '$.tasks') WHERE type = 'OBJECT'))
        GROUP BY ALL""",
    "def_edge": """SELECT DISTINCT tenant, name, version, task, unnest(deps) AS dep FROM def_task""",
}


def current_runs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Runs as they stand: rows loaded again count once, deleted ones not."""
    return latest_per_key(table(spark, d, "runs"), ["id"], ["loaded_at"], ["id", "deleted_at", *columns]).where("deleted_at IS NULL").drop("deleted_at")


def run_documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Runs as they stand with their document, its outer encodings removed."""
    from weftline.functions.scalars import unwrapped

    return current_runs(spark, d, "document", *columns).withColumn("document", unwrapped(F.col("document")))


def current_tasks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_per_key(table(spark, d, "task_runs"), ["id"], ["loaded_at"], ["id", *columns])


def current_definitions(spark: SparkSession, d: str) -> DataFrame:
    """(tenant, name, version): the newest version that is not deleted."""
    versions = table(spark, d, "workflows").groupBy("tenant", "name", "version").agg(F.max("deleted_at").alias("gone"))
    return versions.where("gone IS NULL").groupBy("tenant", "name").agg(F.max("version").alias("version"))


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    who = F.col("user_id")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.when(who % 11 != 0, F.concat(F.lit("t"), (who % 5).cast("string"))).alias("tenant"),
        F.when(who % 4 == 0, "system").when(who % 4 == 1, "user").when(who % 4 == 2, "token").otherwise("anonymous").alias("actor_kind"),
        F.col("event_type").alias("action_name"),
        F.when(F.col("event_id") % 10 == 0, "failure").when(F.col("event_id") % 10 == 1, "denied").otherwise("success").alias("status"),
        F.when(F.col("value") > 10, "run").otherwise("workflow").alias("resource_type"), who.cast("string").alias("resource_id"),
    )


def queue_entries(spark: SparkSession, d: str) -> DataFrame:
    live = current_runs(spark, d, "status", "next_attempt_at_ms", "created_at_ms", "started_at_ms").where(F.col("status").isin("queued", "running"))
    running = F.col("status") == "running"
    return live.select(
        F.col("id").alias("run_id"), F.when(running, F.concat(F.lit("ct_"), F.substring("id", 4, 6))).otherwise("").alias("token"),
        F.coalesce("next_attempt_at_ms", "created_at_ms").alias("due_at_ms"),
        F.when(running, F.col("started_at_ms") + 2_000_000_000).alias("lease_until_ms"), F.when(running, "dispatcher").alias("claimed_by"),
    )


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Commands for about half of the entries, with the token a running one has."""
    chosen = queue_entries(spark, d).where(F.ascii(F.substring("run_id", 5, 1)) % 2 == 0)
    return chosen.select("run_id", F.concat(F.lit("ct_"), F.substring("run_id", 4, 6)).alias("command_token"))


def outbox(spark: SparkSession, d: str) -> DataFrame:
    from weftline.functions.scalars import outbox_backoff

    events = table(spark, d, "run_events").where(F.col("id") != "")
    first = events.groupBy("id").agg(F.min(F.struct("seq", "attempts", "kind", "created_at_ms")).alias("e"))
    return first.select(
        "id", "e.attempts", F.lit(3).alias("max_attempts"),
        (F.col("e.created_at_ms") + outbox_backoff(500, F.col("e.attempts"))).alias("next_attempt_at_ms"),
        F.when(F.col("e.attempts") >= 3, "dead_letter").when(F.lower("e.kind") == "run.started", "delivered").otherwise("pending").alias("status"),
    )


def document_blobs(spark: SparkSession, d: str) -> DataFrame:
    from weftline.sources.files import artifact_descriptors

    rows = table(spark, d, "documents").where(F.col("text").isNotNull())
    return artifact_descriptors(
        rows, F.col("source"), F.col("doc_id"), F.encode("text", "UTF-8"), F.unix_millis(F.col("posted_at").cast("timestamp"))
    )
