"""Files: audit logs as JSON lines, workflow specifications, content-addressed artifacts, metrics as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "seq BIGINT, id STRING, timestamp_ms BIGINT, tenant STRING, actor_kind STRING, action_name STRING, status STRING, "
    "resource_type STRING, resource_id STRING"
)


def append_audit_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Blank and malformed lines are dropped; seq restores the order of insertion."""
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path).where(F.col("id").isNotNull())


def _either(*names: str) -> Column:
    return F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])


def read_workflow_specs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Specifications, one JSON document a file or, with lines, a line, with fields in snake or camel case and their defaults
    filled in."""
    text = spark.read.text(path, wholetext=not lines)
    return text.select(
        _either("tenant").alias("tenant"), _either("name").alias("name"),
        F.coalesce(_either("version").try_cast("int"), F.lit(1)).alias("version"),
        F.coalesce(_either("description"), F.lit("")).alias("description"),
        F.coalesce(_either("timeout_ms", "timeoutMs").try_cast("bigint"), F.lit(60_000)).alias("timeout_ms"),
        F.coalesce(_either("default_priority", "defaultPriority"), F.lit("normal")).alias("default_priority"),
        F.coalesce(_either("tasks"), F.lit("[]")).alias("tasks"), F.col("value").alias("document"),
    )


def artifact_descriptors(blobs: DataFrame, tenant: Column, name: Column, content: Column, created_ms: Column) -> DataFrame:
    """Descriptors by content: equal bytes have one id, whose descriptor is the one stored last."""
    described = blobs.select(
        F.sha2(content, 256).alias("id"), tenant.alias("tenant"), name.cast("string").alias("name"),
        F.octet_length(content).cast("bigint").alias("size_bytes"), created_ms.alias("created_at_ms"),
    ).where(F.col("id").isNotNull())
    last = F.max(F.struct("created_at_ms", "name", "tenant", "size_bytes")).alias("s")
    return described.groupBy("id").agg(last).select("id", "s.tenant", "s.name", "s.size_bytes", "s.created_at_ms")


def write_artifacts(blobs: DataFrame, path: str) -> None:
    """Blobs (content BINARY) sharded by the first byte of their id and sorted by it; equal bytes are written once.

    A file holds many blobs, so one level of 256 shards is enough; the rest of the id is found by the files' statistics.
    """
    once = blobs.select(F.sha2("content", 256).alias("id"), "content").dropDuplicates(["id"])
    sharded = once.withColumn("shard", F.substring("id", 1, 2))
    sharded.repartition("shard").sortWithinPartitions("shard", "id").write.mode("append").partitionBy("shard").parquet(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Stored blobs whose bytes still give their id."""
    return spark.read.parquet(path).where(F.sha2("content", 256) == F.col("id")).select("id", "content")


def metrics_text(metrics: DataFrame, prefix: str) -> DataFrame:
    """Text exposition lines of metrics (name, kind, help, label, value), in order."""
    full = F.concat(F.lit(f"{prefix}_"), "name")
    lines = F.array(
        F.concat(F.lit("# HELP "), full, F.lit(" "), "help"),
        F.concat(F.lit("# TYPE "), full, F.lit(" "), "kind"),
        F.concat(full, F.coalesce(F.concat(F.lit('{le="'), "label", F.lit('"}')), F.lit("")), F.lit(" "), "value"),
    )
    return metrics.select("name", "label", F.posexplode(lines).alias("line_no", "line"))
