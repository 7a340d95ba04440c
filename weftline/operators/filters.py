"""Typed filters over runs, audit records, queue entries and deliveries.

Every filter becomes one conjunction of built-in column predicates, so equality, prefix and range tests reach the
Parquet scan. A condition that is not set matches all rows; one on a null column matches none.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed domains (fixed values).
RUN_STATUSES = ("queued", "running", "succeeded", "failed", "cancelled", "timedout")
TERMINAL_RUN = ("succeeded", "failed", "cancelled", "timedout")
TERMINAL_TASK = ("succeeded", "failed", "skipped")
MOST_LISTED = 500
MOST_AUDITED = 1000


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class RunFilter:
    name: str | None = None
    name_prefix: str | None = None
    status: str | None = None
    status_in: tuple[str, ...] = ()
    tenant: str | None = None
    tags: dict[str, str] = field(default_factory=dict)
    has_tag_keys: tuple[str, ...] = ()
    from_ms: int | None = None  # created at or after
    to_ms: int | None = None  # created before
    finished_from_ms: int | None = None
    finished_to_ms: int | None = None  # inclusive, unlike to_ms
    min_duration_ms: int | None = None
    limit: int | None = None
    offset: int = 0

    def condition(self) -> Column:
        c = []
        if self.tenant is not None:
            c.append(F.col("tenant") == self.tenant)
        if self.name is not None:
            c.append(F.col("def_name") == self.name)
        if self.name_prefix is not None:
            c.append(F.startswith(F.col("def_name"), F.lit(self.name_prefix)))
        if self.status is not None:
            c.append(F.col("status") == self.status)
        if self.status_in:
            c.append(F.col("status").isin(*self.status_in))
        for key, value in self.tags.items():
            c.append(F.coalesce(F.try_element_at("tags", F.lit(key)) == value, F.lit(False)))
        c += [F.coalesce(F.map_contains_key("tags", k), F.lit(False)) for k in self.has_tag_keys]
        for column, low, high in (
            ("created_at_ms", self.from_ms, None if self.to_ms is None else self.to_ms - 1),
            ("finished_at_ms", self.finished_from_ms, self.finished_to_ms),
        ):
            if low is not None:
                c.append(F.col(column) >= low)
            if high is not None:
                c.append(F.col(column) <= high)
        if self.min_duration_ms is not None:
            # Widened: a difference of two BIGINTs need not fit one.
            wide = F.col("finished_at_ms").cast("decimal(20,0)") - F.col("started_at_ms").cast("decimal(20,0)")
            c.append(wide >= self.min_duration_ms)
        return _all(c)

    def apply(self, runs: DataFrame) -> DataFrame:
        return runs.where(self.condition())

    def page(self, runs: DataFrame) -> DataFrame:
        """Newest first, ties by id; the count of matching runs ignores the page."""
        ordered = self.apply(runs).orderBy(F.desc("created_at_ms"), "id")
        if self.offset:
            ordered = ordered.offset(self.offset)
        return ordered if self.limit is None else ordered.limit(self.limit)

    @classmethod
    def from_query(cls, params: dict[str, str]) -> RunFilter:
        """From a request's text parameters; lists are split at commas, trimmed, and blanks dropped."""

        def listed(key: str) -> tuple[str, ...]:
            return tuple(p for x in params.get(key, "").split(",") if (p := x.strip()))

        def number(key: str) -> int | None:
            return int(params[key]) if key in params else None

        known = set(
            "name namePrefix status statusIn tenant hasTagKeys fromMs toMs finishedFromMs finishedToMs minDurationMs limit offset".split()
        )
        if unknown := set(params) - known:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        own = cls(
            params.get("name"), params.get("namePrefix"), params.get("status"), listed("statusIn"), params.get("tenant"), {},
            listed("hasTagKeys"), number("fromMs"), number("toMs"), number("finishedFromMs"), number("finishedToMs"),
            number("minDurationMs"), number("limit"), number("offset") or 0,
        )
        for status in (*own.status_in, *([own.status] if own.status else [])):
            if status not in RUN_STATUSES:
                raise ValueError(f"no such status: {status!r}")
        if own.limit is not None and not 1 <= own.limit <= MOST_LISTED:
            raise ValueError(f"limit must be within 1 and {MOST_LISTED}")
        if own.offset < 0 or (own.min_duration_ms or 0) < 0:
            raise ValueError("offset and duration cannot be negative")
        for low, high in ((own.from_ms, own.to_ms), (own.finished_from_ms, own.finished_to_ms)):
            if low is not None and high is not None and low > high:
                raise ValueError("a range ends before it starts")
        return own


@dataclass(frozen=True)
class AuditFilter:
    """Equality on discriminators; both ends of the time range are inclusive. Newest first by insertion."""

    tenant: str | None = None
    actor_kind: str | None = None
    action_name: str | None = None
    status: str | None = None
    resource_type: str | None = None
    resource_id: str | None = None
    since_ms: int | None = None
    until_ms: int | None = None
    limit: int = 50
    offset: int = 0

    def condition(self) -> Column:
        equal = ("tenant", "actor_kind", "action_name", "status", "resource_type", "resource_id")
        c = [F.col(k) == v for k in equal if (v := getattr(self, k)) is not None]
        if self.since_ms is not None:
            c.append(F.col("timestamp_ms") >= self.since_ms)
        if self.until_ms is not None:
            c.append(F.col("timestamp_ms") <= self.until_ms)
        return _all(c)

    def page(self, records: DataFrame, sequence: str = "seq") -> DataFrame:
        size = min(max(self.limit, 1), MOST_AUDITED)
        return records.where(self.condition()).orderBy(F.desc(sequence)).offset(self.offset).limit(size)


def ring_tail(records: DataFrame, capacity: int, sequence: str = "seq") -> DataFrame:
    """What a ring buffer of that capacity still holds."""
    return records.orderBy(F.desc(sequence)).limit(capacity)


def queue_ready(entries: DataFrame, now_ms: int) -> DataFrame:
    free = F.coalesce(F.col("lease_until_ms") <= now_ms, F.lit(True))
    return entries.where((F.col("due_at_ms") <= now_ms) & free)


def scan_ready(entries: DataFrame, now_ms: int, limit: int) -> DataFrame:
    return queue_ready(entries, now_ms).orderBy("due_at_ms", "run_id").limit(limit)


def expired_leases(entries: DataFrame, now_ms: int) -> DataFrame:
    return entries.where(F.col("lease_until_ms") <= now_ms)


def retention_candidates(runs: DataFrame, cutoff_ms: int) -> DataFrame:
    return runs.where(F.col("finished_at_ms") <= cutoff_ms)


def outbox_ready(items: DataFrame, now_ms: int) -> DataFrame:
    return items.where((F.col("status") == "pending") & (F.col("next_attempt_at_ms") <= now_ms)).orderBy(
        "next_attempt_at_ms", "attempts", "id"
    )


def may_retry(attempts: Column, max_attempts: Column, retryable_only: Column, retryable: Column) -> Column:
    return (attempts < max_attempts) & (~retryable_only | retryable)
