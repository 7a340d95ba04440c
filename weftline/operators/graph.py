"""Dependency graphs of definitions: order, waves, critical path, reachability, ready and skipped tasks.

A definition's graph lies in one row (its document), so every analysis is local to the row: no shuffle, one pass in
Arrow batches. A definition has at most a few hundred tasks; where a graph is spread over rows instead, the recursive
plans of the query catalogue or the hierarchy operator apply.

Defined results: null and unreadable documents give no rows. Repeated dependencies collapse. A dependency that is no
task makes the graph invalid (unknown:<dependency>), the smallest such name first, before cycles are looked for.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import MOST_BACKOFF_MS
from weftline.operators.nested import DEPENDENCIES, TASKS
from weftline.operators.structural import read_document

Tasks = dict[str, list[str]]
_PLACEHOLDER = re.compile(r"\$\{([^}]*)\}")


def _first(record: dict, names: list[str]):
    return next((record[n] for n in names if n in record and record[n] is not None), None)


def tasks_of(value) -> tuple[list[dict], Tasks]:
    """Task records of a definition and its dependencies by task; a text of dependencies is split at commas."""
    listed = _first(value, TASKS) if isinstance(value, dict) else None
    records = [t for t in listed if isinstance(t, dict)] if isinstance(listed, list) else []
    graph: Tasks = {}
    for t in records:
        deps = _first(t, DEPENDENCIES)
        if isinstance(deps, str):
            deps = [d.strip() for d in deps.split(",")]
        clean = [d for d in deps if isinstance(d, str) and d] if isinstance(deps, list) else []
        graph.setdefault(str(t.get("name")), list(dict.fromkeys(clean)))
    return records, graph


def graph_error(graph: Tasks) -> str | None:
    unknown = sorted(d for deps in graph.values() for d in deps if d not in graph)
    if unknown:
        return f"unknown:{unknown[0]}"
    return None if len(topological_order(graph)) == len(graph) else "cycle"


def topological_order(graph: Tasks) -> list[str]:
    """Smallest free name first; what lies on or behind a cycle is left out."""
    import heapq

    waiting = {t: len(deps) for t, deps in graph.items()}
    behind = defaultdict(list)
    for t, deps in graph.items():
        for d in deps:
            behind[d].append(t)
    free = [t for t, n in waiting.items() if n == 0]
    heapq.heapify(free)
    order = []
    while free:
        t = heapq.heappop(free)
        order.append(t)
        for child in behind[t]:
            waiting[child] -= 1
            if waiting[child] == 0:
                heapq.heappush(free, child)
    return order


def waves(graph: Tasks) -> dict[str, int]:
    """Stage of each task: the length of the longest chain of dependencies above it."""
    stage: dict[str, int] = {}
    for t in topological_order(graph):
        stage[t] = max((stage[d] + 1 for d in graph[t]), default=0)
    return stage


def critical_path(graph: Tasks) -> list[str]:
    """A longest chain; of several, it ends in the smallest last task and goes back over the dependency that was
    reached first in order of (stage, name)."""
    stage = waves(graph)
    if not stage:
        return []
    deepest = max(stage.values())
    at: str | None = min(t for t, s in stage.items() if s == deepest)
    path = []
    while at is not None:
        path.append(at)
        above = [d for d in graph[at] if stage[d] == stage[at] - 1]
        at = min(above) if above else None
    return path[::-1]


def ancestors(graph: Tasks) -> dict[str, set[str]]:
    above: dict[str, set[str]] = {}
    for t in topological_order(graph):
        above[t] = set(graph[t]).union(*[above[d] for d in graph[t]])
    return above


def placeholders(value) -> list[str]:
    """Paths between ${ and } in all texts of a JSON value, trimmed, without empty ones."""
    if isinstance(value, str):
        return [p for m in _PLACEHOLDER.finditer(value) if (p := m[1].strip())]
    if isinstance(value, dict):
        value = list(value.values())
    return [p for x in value for p in placeholders(x)] if isinstance(value, list) else []


def reference_warnings(records: list[dict], graph: Tasks) -> list[tuple[str, str, str]]:
    """(task, reference, self|unreachable) of references to outputs that a task cannot have."""
    above = ancestors(graph)
    found = []
    for t in records:
        name = str(t.get("name"))
        for path in placeholders(t.get("input")):
            parts = path.split(".")
            if parts[0] == "tasks" and len(parts) >= 2:
                if parts[1] == name:
                    found.append((name, path, "self"))
                elif parts[1] not in above.get(name, ()):
                    found.append((name, path, "unreachable"))
    return found


def ready_tasks(graph: Tasks, states: dict[str, str]) -> list[str]:
    """Failed tasks, and pending ones all of whose dependencies have succeeded."""
    of = lambda t: states.get(t, "pending")
    free = lambda t: all(states.get(d) == "succeeded" for d in graph[t])
    return sorted(t for t in graph if of(t) == "failed" or (of(t) == "pending" and free(t)))


def skip_closure(graph: Tasks, states: dict[str, str]) -> dict[str, str]:
    """Pending tasks with a dependency that has not succeeded become skipped, until nothing changes."""
    after = dict(states)
    changed = True
    while changed:
        changed = False
        for t, deps in graph.items():
            if after.get(t, "pending") == "pending" and any(after.get(d) != "succeeded" for d in deps):
                after[t], changed = "skipped", True
    return after


def per_definition(documents: DataFrame, keys: list[str], rows_of: Callable, schema: str) -> DataFrame:
    """Rows that rows_of(records, graph, value) yields for each readable definition, behind its keys."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch[keys].itertuples(index=False, name=None), batch["document"]):
                value = read_document(text)
                if isinstance(value, dict):
                    records, graph = tasks_of(value)
                    out += [(*key, *row) for row in rows_of(records, graph, value)]
            yield pd.DataFrame(out, columns=[*keys, *names])

    full = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema
    return documents.select(*keys, "document").where(F.col("document").isNotNull()).mapInPandas(run, full)


def definition_tasks(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., task, handler, deps): the first record of each task name; deps sorted, each once."""

    def rows(records, graph, _):
        handlers = {}
        for t in records:
            handlers.setdefault(str(t.get("name")), _first(t, ["handler", "handler_id", "uses"]))
        for name, deps in graph.items():
            yield name, handlers[name], sorted(deps)

    return per_definition(documents, keys, rows, "task STRING, handler STRING, deps ARRAY<STRING>").distinct()


def dangling(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., task, dep): dependencies of tasks (keys..., task, deps) on tasks that are not there."""
    edges = tasks.select(*keys, "task", F.explode("deps").alias("dep"))
    return edges.join(tasks.select(*keys, F.col("task").alias("dep")), [*keys, "dep"], "left_anti").select(*keys, "task", "dep")


def timeout_ms(value) -> int:
    """The timeout of a definition or task: a number or text of milliseconds, or an object of value and unit; 60,000 by default."""
    units = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}
    if isinstance(value, dict):
        unit, value = units.get(value.get("unit"), 1), value.get("value")
    else:
        unit = 1
    if isinstance(value, str) and re.fullmatch("[0-9]+", value.strip()):
        value = int(value)
    return int(value * unit) if isinstance(value, (int, float)) and not isinstance(value, bool) else 60_000


def definition_timeouts(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., timeout_ms): the timeout of each definition with tasks; of several documents the greatest."""
    rows = per_definition(documents, keys, lambda r, g, v: [(timeout_ms(v.get("timeout_ms")),)] if g else [], "timeout_ms BIGINT")
    return rows.groupBy(*keys).agg(F.max("timeout_ms").alias("timeout_ms"))


def task_waves(documents: DataFrame, keys: list[str]) -> DataFrame:
    return per_definition(documents, keys, lambda r, g, v: waves(g).items() if not graph_error(g) else [], "task STRING, stage INT")


def dry_runs(documents: DataFrame, keys: list[str]) -> DataFrame:
    """One report a definition: validity, order, number of stages, widest stage, critical path, references, warnings."""

    def rows(records, graph, _):
        error = graph_error(graph)
        stage = {} if error else waves(graph)
        sizes = pd.Series(list(stage.values())).value_counts() if stage else []
        refs = sorted({p for t in records for p in placeholders(t.get("input"))})
        yield (
            len(records), error, ",".join([] if error else topological_order(graph)), max(stage.values(), default=-1) + 1,
            int(max(sizes, default=0)), ",".join([] if error else critical_path(graph)), ",".join(refs),
            "; ".join(f"{t} {kind} {p}" for t, p, kind in reference_warnings(records, graph)),
        )

    schema = (
        "total_tasks INT, error STRING, topo_order STRING, n_stages INT, max_parallelism INT, critical_path STRING, "
        "variable_references STRING, warnings STRING"
    )
    return per_definition(documents, keys, rows, schema)


def definition_warnings(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., task, reference, kind) of references to outputs that a task cannot have."""
    rows = lambda records, graph, _: [] if graph_error(graph) else reference_warnings(records, graph)
    return per_definition(documents, keys, rows, "task STRING, reference STRING, kind STRING")


def transitive_dependencies(documents: DataFrame, keys: list[str]) -> DataFrame:
    def rows(records, graph, _):
        return [] if graph_error(graph) else [(t, a) for t, above in ancestors(graph).items() for a in above]

    return per_definition(documents, keys, rows, "task STRING, above STRING")


#: Limits of a definition and what a retry policy has where it says nothing (fixed values).
MAX_TASKS, MAX_TASK_NAME, MAX_DESCRIPTION = 256, 64, 512
RETRY_DEFAULTS = {"max_attempts": 3, "base_delay_ms": 1_000, "max_delay_ms": 60_000, "multiplier": 2.0}
#: The lists of hooks and their names in documents, in the order in which all hooks are listed (fixed values).
HOOK_NAMES = {
    "on_start": ("on_start", "onStart"),
    "on_success": ("on_success", "onSuccess"),
    "on_failure": ("on_failure", "onFailure", "on_error"),
    "on_cancel": ("on_cancel", "onCancel"),
}


def hooks_of(value) -> list[tuple[str, int, dict]]:
    """(list name, position, hook) of all four lists of a definition, in their order."""
    holder = next((h for k in ("hooks", "notifications") if isinstance(h := value.get(k), dict) and h), {})
    found = []
    for list_name, names in HOOK_NAMES.items():
        listed = next((holder[k] for k in names if holder.get(k)), [])
        listed = [listed] if isinstance(listed, dict) else listed if isinstance(listed, list) else []
        found += [(list_name, i, h) for i, h in enumerate(listed) if isinstance(h, dict)]
    return found


def hook_url(hook: dict) -> str | None:
    return hook.get("webhook_url") or hook.get("url") or hook.get("endpoint")


def policy_breaks(retry) -> bool:
    """Whether a retry policy breaks a rule; fields that are missing or no numbers have their defaults."""
    known = retry if isinstance(retry, dict) else {}
    of = lambda k: x if isinstance(x := known.get(k), (int, float)) and not isinstance(x, bool) else RETRY_DEFAULTS[k]
    attempts, base, most, multiplier = map(of, RETRY_DEFAULTS)
    growing = multiplier == multiplier and 1 <= multiplier < float("inf")
    return not (1 <= attempts <= 100 and base >= 1 and base <= most <= MOST_BACKOFF_MS and growing)


def url_breaks(url) -> bool:
    parts = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*).*", url, re.S) if isinstance(url, str) else None
    return not (parts and parts[1].lower() in ("http", "https") and re.sub(r"^.*@|:[0-9]*$", "", parts[2]))


def definition_error(value) -> str | None:
    """The first broken rule: name, description, number and names of tasks; then of each task its timeout, the length of
    its name and its retry policy; then the graph, the definition's own timeout, and the URLs of its hooks."""
    records, graph = tasks_of(value)
    name = value.get("name")
    if not (isinstance(name, str) and re.fullmatch(r"[a-z][a-z0-9-]{0,63}", name)):
        return "invalid_name"
    if len(str(value.get("description") or "")) > MAX_DESCRIPTION:
        return "description_too_long"
    if not records:
        return "empty_tasks"
    if len(records) > MAX_TASKS:
        return "too_many_tasks"
    if len(graph) < len(records):
        return "duplicate_task_name"
    for t in records:
        if t.get("timeout_ms") == 0:
            return "zero_timeout"
        if len(str(t.get("name")).encode()) > MAX_TASK_NAME:
            return "task_name_too_long"
        if t.get("retry") is not None and policy_breaks(t["retry"]):
            return "invalid_policy"
    if error := graph_error(graph):
        return error.partition(":")[0]
    if value.get("timeout_ms") == 0:
        return "zero_timeout"
    if any(url_breaks(url) for _, _, h in hooks_of(value) if (url := hook_url(h)) is not None):
        return "invalid_hook_url"
    return None


def definition_errors(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., error): the first broken rule of each definition that breaks one."""
    return per_definition(documents, keys, lambda r, g, value: [(e,)] if (e := definition_error(value)) else [], "error STRING")


def run_states(runs_with_documents: DataFrame, task_runs: DataFrame) -> DataFrame:
    """(id, document, states, task_attempts): each run with its definition's document and the states and attempts of its tasks
    as JSON.

    runs_with_documents has (id, document). States are gathered per run, of which there are as many as it has tasks; of several states of a task the greatest
    name holds, and the greatest attempts and error. What task_runs does not have is not there: task_attempts, task_errors.
    """
    values = [c for c in ("status", "attempts", "last_error") if c in task_runs.columns]
    one = task_runs.groupBy("run_id", "task_name").agg(*[F.max(c).alias(c) for c in values])
    gathered = lambda c: F.to_json(F.map_from_entries(F.collect_list(F.struct("task_name", c))))
    names = {"status": "states", "attempts": "task_attempts", "last_error": "task_errors"}
    states = one.groupBy("run_id").agg(*[gathered(c).alias(names[c]) for c in values])
    return runs_with_documents.join(states, runs_with_documents["id"] == states["run_id"], "left").drop("run_id")


def next_states(states: DataFrame) -> DataFrame:
    """(id, task, status, ready, after): of each task its state, whether it is ready, and its state after skipping."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, known in zip(batch["id"], batch["document"], batch["states"]):
                value = read_document(text)
                if not isinstance(value, dict):
                    continue
                _, graph = tasks_of(value)
                now = json.loads(known) if known else {}
                now = {t: now.get(t, "pending") for t in graph}
                free, after = set(ready_tasks(graph, now)), skip_closure(graph, now)
                out += [(key, t, now[t], t in free, after[t]) for t in graph]
            yield pd.DataFrame(out, columns=["id", "task", "status", "ready", "after"])

    return states.select("id", "document", "states").mapInPandas(
        run, "id STRING, task STRING, status STRING, ready BOOLEAN, after STRING"
    )
