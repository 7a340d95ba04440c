"""Deeply nested semi-structured records: related flat tables with parent-child links.

Documents are read and checked by the vectorised structural index alone, whatever their depth; a table is a path of field names from the root, each step with
the names that files give the field, and its rows are value spans with the keys of their row and their parent row. No
row is shuffled before equal rows are counted once.

Defined results: null, unreadable and blank documents give no rows; a document that is itself a JSON text of a document
(encoded twice or more) is read as that document. A lone object where a list belongs counts as a list of one; null
elements, and elements that are no objects where objects belong, give no row but keep their position. A text of
dependencies is split at commas, its parts are trimmed and blank parts give no row and take no position. Equal rows
count once. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.structural import Index, index
from weftline.session import table

#: Names that files give the fields (fixed values).
TASKS = ["tasks"]
DEPENDENCIES = ["depends_on", "dependsOn", "needs"]
HOOKS = ["hooks", "notifications"]
ON_FAILURE = ["on_failure", "onFailure", "on_error"]
HEADERS = ["headers"]
OUTPUT = ["output"]
ARTIFACTS = ["artifacts"]
PARTS = ["parts"]

CHUNK_BYTES = 4 << 20
_ROW = "parent_key STRING, child STRING, child_path STRING, parent_path STRING, value STRING"
_OBJECT, _LIST, _TEXT = ord("{"), ord("["), ord('"')


def readable(text: str | None) -> bytes | None:
    """The document's bytes with outer encodings removed, however many, or None."""
    while text is not None and (lead := text.lstrip()[:1]) == '"':
        try:
            text = json.loads(text)
        except ValueError:
            return None
    return text.encode("utf-8", "surrogatepass") if text is not None and lead in ("{", "[") else None


class Emitter:
    """Rows of one chunk of documents, as flat lists."""

    def __init__(self, ix: Index, keys: list[str], with_values: bool):
        self.ix, self.keys, self.with_values = ix, keys, with_values
        self.rows: list[tuple] = []

    def items(self, holders: np.ndarray, objects_only: bool = True) -> np.ndarray:
        """Elements of list values, and object values themselves."""
        ix = self.ix
        lists = holders[ix.kind[holders] == _LIST]
        inside = ix.children(lists)
        if objects_only:
            inside = inside[ix.kind[inside] == _OBJECT]
        lone = holders[ix.kind[holders] == _OBJECT]
        return np.sort(np.r_[inside, lone])

    def place(self, item: int) -> int:
        """Position in the list; a lone object has 0."""
        box = self.ix.box[item]
        return int(self.ix.nth[item]) if box >= 0 and self.ix.kind[box] == _LIST else 0

    def add(self, child: str, item: int, path: str, parent: str | None, value: str | None = None) -> None:
        if self.with_values and value is None:
            value = self.ix.text(item)
        self.rows.append((self.keys[self.ix.doc[item]], child, path, parent, value if self.with_values else None))


def _fields(e: Emitter, boxes: np.ndarray, names: list[str]) -> np.ndarray:
    return e.ix.keyed(e.ix.children(boxes), names)


def _roots(ix: Index) -> np.ndarray:
    return np.flatnonzero((ix.box < 0) & (ix.kind == _OBJECT))


def workflow_rows(e: Emitter) -> None:
    ix = e.ix
    roots = _roots(ix)
    tasks = e.items(_fields(e, roots, TASKS))
    paths = {int(t): str(e.place(t)) for t in tasks}
    for t, path in paths.items():
        e.add("task", t, path, None)
    deps = _fields(e, tasks, DEPENDENCIES)
    owner = dict(zip(deps.tolist(), ix.box[deps].tolist()))
    for d in deps[ix.kind[deps] == _TEXT].tolist():
        parts = [p.strip() for p in json.loads(ix.text(d)).split(",")]
        for j, name in enumerate(p for p in parts if p):
            e.add("task_dep", d, f"{paths[owner[d]]}/{j}", paths[owner[d]], json.dumps(name))
    listed = ix.children(deps[ix.kind[deps] == _LIST])
    for item in listed[ix.kind[listed] == _TEXT].tolist():
        task = paths[owner[int(ix.box[item])]]
        e.add("task_dep", item, f"{task}/{int(ix.nth[item])}", task)
    hooks = _fields(e, roots, HOOKS)
    failure = e.items(_fields(e, hooks[ix.kind[hooks] == _OBJECT], ON_FAILURE))
    hook_paths = {int(h): str(e.place(h)) for h in failure}
    for h, path in hook_paths.items():
        e.add("failure_hook", h, path, None)
    headers = _fields(e, failure, HEADERS)
    headers = headers[ix.kind[headers] == _OBJECT]
    for item in ix.children(headers).tolist():
        hook = hook_paths[int(ix.box[ix.box[item]])]
        e.add("hook_header", item, f"{hook}/{ix.key(item)}", hook)


def run_rows(e: Emitter) -> None:
    ix = e.ix
    outputs = _fields(e, _roots(ix), OUTPUT)
    outputs = outputs[(ix.kind[outputs] == _OBJECT) | (ix.kind[outputs] == _LIST)]
    held = ix.keyed(np.flatnonzero(ix.within(outputs)), ARTIFACTS) if len(outputs) else outputs
    artifacts = e.items(held)
    paths = {int(a): str(e.place(a)) for a in artifacts}
    for a, path in paths.items():
        e.add("artifact", a, path, None)
    parts = _fields(e, artifacts, PARTS)
    for p in e.items(parts).tolist():
        up = int(ix.box[p])
        artifact = paths[up if up in paths and ix.kind[up] == _OBJECT else int(ix.box[up])]
        e.add("artifact_part", p, f"{artifact}/{e.place(p)}", artifact)


def _chunks(keys: list[str], texts: list[bytes]) -> Iterator[tuple[list[str], list[bytes]]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES:
            yield keys[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield keys[start:], texts[start:]


def flatten(documents: DataFrame, extract: Callable[[Emitter], None], with_values: bool = True) -> DataFrame:
    """Flat rows (parent_key, child, child_path, parent_path, value) of documents (parent_key, document).

    child_path is the row's key below parent_key, parent_path that of its parent row (null: the document itself).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(k, t) for k, d in zip(batch["parent_key"], batch["document"]) if (t := readable(d)) is not None]
            for keys, texts in _chunks([k for k, _ in pairs], [t for _, t in pairs]):
                emitter = Emitter(index(texts), keys, with_values)
                extract(emitter)
                yield pd.DataFrame(emitter.rows, columns=["parent_key", "child", "child_path", "parent_path", "value"]).drop_duplicates()

    return documents.where(F.col("document").isNotNull()).mapInPandas(run, _ROW)


def workflow_key() -> Column:
    return F.concat_ws("/", "tenant", "name", "version").alias("parent_key")


def flat_rows(spark, sf_dir: str, with_values: bool = True) -> DataFrame:
    """Rows of all flat tables of workflows.document and runs.document; equal rows once."""
    workflows = table(spark, sf_dir, "workflows").select(workflow_key(), "document")
    runs = table(spark, sf_dir, "runs").select(F.col("id").alias("parent_key"), "document")
    # A run's document without the word cannot have an artifact; an escaped spelling has a backslash.
    runs = runs.where(F.col("document").contains("artifacts") | F.col("document").contains("\\"))
    both = flatten(workflows, workflow_rows, with_values).unionByName(flatten(runs, run_rows, with_values))
    columns = both.columns if with_values else ["parent_key", "child", "child_path"]
    return both.select(*columns).distinct()
