"""Schemas that drift between files: one consistent table, and a report of every change.

Each file's schema is a tree of field names. The change from a file to the next one of its exporter is the least-cost
script of a tree edit distance: keep, retype, delete, add, rename under the same parent, and move to another parent.
Children of two matched nodes are aligned by a least-cost assignment; matching two different names is only open to
pairs that carry the same values in at least half of the definitions both files hold, and costs less the more do.
Scripts are compiled into projections: renamed paths of all files form classes, together with paths that differ in
spelling alone; each class takes the name that most files use, each path the type most files give it, a moved path
belongs where most files have it, and every document is projected onto those. What has no place there is kept beside it.

Defined results: unreadable and null documents have no schema; a document encoded twice (or more) is read; a document
that is no object has an empty schema; below 256 keys everything is data. Files without a readable document are passed over, so a file is compared with
the nearest one before it that has one. Rows loaded twice count once; several versions of a definition in a file are
read in order of version. A null exporter or file_no is a file like any other, and precedes others. Empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.operators.structural import read_document, written
from weftline.session import cut_lineage

#: Fields whose inside is data (fixed values).
DATA_FIELDS = frozenset({"input", "meta", "annotations", "tags", "labels", "headers"})
TYPES = ["boolean", "number", "string", "object", "array"]
_BIT = {name: 1 << i for i, name in enumerate(TYPES)}
#: Wants of files that are broadcast at once.
BLOCK_BYTES = 16 << 20
SEPARATOR = "\x1f"  # between the keys of a path while it is worked on; a key may hold a dot


#: Objects that deep are data: their fields are no paths of their own.
DEEPEST = 256


def type_bit(value) -> int:
    if value is None:
        return 0
    if isinstance(value, bool):
        return _BIT["boolean"]
    if isinstance(value, (int, float)):
        return _BIT["number"]
    if isinstance(value, str):
        return _BIT["string"]
    return _BIT["object"] if isinstance(value, dict) else _BIT["array"]


def schema_of(value) -> dict[str, int]:
    """Type bits of each path of a document; lists add nothing to a path, data fields end it."""
    found: dict[str, int] = {}
    stack = [("", value)]
    while stack:
        prefix, at = stack.pop()
        if isinstance(at, list):
            stack.extend((prefix, x) for x in at if isinstance(x, (dict, list)))
        elif isinstance(at, dict):
            for key, inner in at.items():
                path = f"{prefix}{SEPARATOR}{key}" if prefix else key
                found[path] = found.get(path, 0) | type_bit(inner)
                if key not in DATA_FIELDS and isinstance(inner, (dict, list)) and path.count(SEPARATOR) + 1 < DEEPEST:
                    stack.append((path, inner))
    return found


def values_at(value, path: str) -> list:
    """All values at a path, in document order."""
    level = [value]
    for key in path.split(SEPARATOR):
        found: list = []
        stack = level[::-1]
        while stack:
            at = stack.pop()
            if isinstance(at, list):
                stack.extend(reversed(at))
            elif isinstance(at, dict) and key in at:
                found.append(at[key])
        level = found
    return level


@dataclass
class Node:
    types: int = 0
    children: dict[str, "Node"] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


def tree_of(paths: dict[str, int]) -> Node:
    root = Node(_BIT["object"])
    for path in sorted(paths):
        at = root
        for key in path.split(SEPARATOR):
            at = at.children.setdefault(key, Node())
        at.types = paths[path]
    return root


RETYPE_COST, RENAME_COST, EDIT_COST = 1.0, 1.0, 1.0


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of the rows of a square matrix (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        best, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=int)
        while True:
            used[j0] = True
            i0 = match[j0]
            slack = np.where(used[1:], np.inf, cost[i0 - 1] - u[i0] - v[1:])
            better = slack < best[1:]
            best[1:] = np.where(better, slack, best[1:])
            way[1:] = np.where(better, j0, way[1:])
            open_ = np.where(used[1:], np.inf, best[1:])
            j1 = int(np.argmin(open_)) + 1
            delta = open_[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            best[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    return [(match[j] - 1, j - 1) for j in range(1, n + 1)]


class EditScript:
    """Least-cost script from one schema tree to another; same(old, new) is the share of definitions with equal values."""

    def __init__(self, same):
        self.same = same
        self.memo: dict[tuple[str, str], tuple[float, list]] = {}

    def match(self, old: Node, new: Node, old_path: str, new_path: str) -> tuple[float, list]:
        """Cost and operations of turning one matched node's inside into the other's."""
        key = (old_path, new_path)
        if key not in self.memo:
            self.memo[key] = self._match(old, new, old_path, new_path)
        return self.memo[key]

    def _match(self, old: Node, new: Node, old_path: str, new_path: str) -> tuple[float, list]:
        cost, script = 0.0, []
        if old.types and new.types and old.types != new.types:
            cost += RETYPE_COST
            script.append(("retyped", old_path, new_path))
        # Equal names match; only what is left over can be renamed.
        for name in sorted(old.children.keys() & new.children.keys()):
            c, s = self.match(old.children[name], new.children[name], join(old_path, name), join(new_path, name))
            cost, script = cost + c, script + s
        gone, come = sorted(old.children.keys() - new.children.keys()), sorted(new.children.keys() - old.children.keys())
        if not gone and not come:
            return cost, script
        n, m = len(gone), len(come)
        far = 1e9
        costs = np.zeros((n + m, n + m))
        costs[:n, m:] = far
        costs[n:, :m] = far
        for i, a in enumerate(gone):
            costs[i, m + i] = EDIT_COST * old.children[a].size()
            for j, b in enumerate(come):
                share = self.same(join(old_path, a), join(new_path, b))
                if share >= 0.5:
                    inner, _ = self.match(old.children[a], new.children[b], join(old_path, a), join(new_path, b))
                    # A rename never costs more than deleting and adding: equal values are evidence enough.
                    least = EDIT_COST * (old.children[a].size() + new.children[b].size())
                    costs[i, j] = min(RENAME_COST * (1.5 - share) + inner, least * (1.5 - share) * 0.99)
                else:
                    costs[i, j] = far
        for j, b in enumerate(come):
            costs[n + j, j] = EDIT_COST * new.children[b].size()
        for i, j in assign(costs):
            if i >= n and j >= m:
                continue
            cost += costs[i, j]
            if i < n and j < m:
                old_at, new_at = join(old_path, gone[i]), join(new_path, come[j])
                script.append(("renamed", old_at, new_at))
                script += self.match(old.children[gone[i]], new.children[come[j]], old_at, new_at)[1]
            elif i < n:
                script.append(("removed", join(old_path, gone[i]), join(old_path, gone[i])))
            else:
                script.append(("added", join(new_path, come[j]), join(new_path, come[j])))
        return cost, script

    def moves(self, script: list) -> list[tuple[str, str]]:
        """Pairs of a removed and an added path under different parents that carry the same values: a least-cost
        assignment, in which a move costs less than taking a field away and adding it, the less the more values agree."""
        gone = [o for k, o, _ in script if k == "removed"]
        come = [n for k, _, n in script if k == "added"]
        n, m = len(gone), len(come)
        if not n or not m:
            return []
        costs = np.zeros((n + m, n + m))
        costs[:n, m:] = costs[n:, :m] = 1e9
        costs[np.arange(n), m + np.arange(n)] = costs[n + np.arange(m), np.arange(m)] = EDIT_COST
        for i, o in enumerate(gone):
            for j, c in enumerate(come):
                share = self.same(o, c) if parent(o) != parent(c) else 0.0
                renamed = o.split(SEPARATOR)[-1] != c.split(SEPARATOR)[-1]
                costs[i, j] = RENAME_COST * (1.5 - share + 0.01 * renamed) if share >= 0.5 else 1e9
        return [(gone[i], come[j]) for i, j in sorted(assign(costs)) if i < n and j < m]


def join(prefix: str, name: str) -> str:
    return f"{prefix}{SEPARATOR}{name}" if prefix else name


def parent(path: str) -> str:
    return path.rpartition(SEPARATOR)[0]


def topmost(script: list) -> list:
    """Without the operations below another operation's path."""
    olds = {o for k, o, _ in script if k != "added"}
    news = {n for k, _, n in script if k != "removed"}

    def below(path: str, reported: set[str]) -> bool:
        while path := parent(path):
            if path in reported:
                return True
        return False

    return [x for x in script if not (below(x[1], olds) if x[0] != "added" else below(x[2], news))]


def changed_paths(old: dict[str, int], new: dict[str, int]) -> tuple[list[str], list[str]]:
    """Paths that are only in the old or only in the new file although their parents are in both."""

    def only(a: dict, b: dict) -> list[str]:
        return sorted(p for p in a if p not in b and (not parent(p) or parent(p) in b))

    return only(old, new), only(new, old)


# ------------------------------------------------------------------------------------------------------------- plans


def file_schemas(workflows: DataFrame) -> DataFrame:
    """(exporter, file_no, path, types): merged in each task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found: dict[tuple, int] = defaultdict(int)
            for exporter, number, text in zip(rows["exporter"], rows["file_no"], rows["document"]):
                value = read_document(text)
                if value is None:
                    continue
                found[exporter, number, ""] |= 0
                for path, types in schema_of(value).items():
                    found[exporter, number, path] |= types
            keys = list(found)
            if not keys:
                continue
            yield pd.DataFrame(
                {
                    "exporter": [k[0] for k in keys],
                    "file_no": pd.array([None if pd.isna(k[1]) else int(k[1]) for k in keys], dtype="Int32"),
                    "path": [k[2] for k in keys],
                    "types": list(found.values()),
                }
            )

    raw = workflows.select("exporter", "file_no", "document").where(F.col("document").isNotNull())
    parts = raw.mapInPandas(run, "exporter STRING, file_no INT, path STRING, types INT")
    return parts.groupBy("exporter", "file_no", "path").agg(F.bit_or("types").alias("types"))


def file_pairs(schemas: DataFrame) -> DataFrame:
    """(exporter, file_no, previous_no, old, new): schemas of a file and of the one before it, as maps.

    A row is one file's schema, so the window of an exporter sorts files, not records.
    """
    packed = schemas.groupBy("exporter", "file_no").agg(
        F.map_from_entries(F.collect_list(F.struct("path", "types"))).alias("new")
    )
    w = W.partitionBy("exporter").orderBy("file_no")
    return packed.select(
        "exporter", "file_no", F.lag("file_no").over(w).alias("previous_no"), F.lag("new").over(w).alias("old"), "new"
    ).where(F.col("old").isNotNull())


def _clean(schema) -> dict[str, int]:
    return {path: int(types) for path, types in dict(schema).items() if path}


def wanted_paths(pairs: DataFrame) -> DataFrame:
    """(exporter, file_no, wants): the paths whose values each file must show for its pairs, as (side, pair_no, paths)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for exporter, number, previous, old, new in rows.itertuples(index=False):
                gone, come = changed_paths(_clean(old), _clean(new))
                if gone and come:
                    pair = None if pd.isna(number) else int(number)
                    out.append((exporter, None if pd.isna(previous) else int(previous), "old", pair, gone))
                    out.append((exporter, pair, "new", pair, come))
            if not out:
                continue
            frame = pd.DataFrame(out, columns=["exporter", "file_no", "side", "pair_no", "paths"])
            yield frame.astype({"file_no": "Int32", "pair_no": "Int32"})

    one = pairs.select("exporter", "file_no", "previous_no", "old", "new").mapInPandas(
        run, "exporter STRING, file_no INT, side STRING, pair_no INT, paths ARRAY<STRING>"
    )
    return one.groupBy("exporter", "file_no").agg(F.collect_list(F.struct("side", "pair_no", "paths")).alias("wants"))


def _beside(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows with the wants of their file. Wants follow the number of files and fields; while all of them are small they are
    broadcast, so that documents stay where they are, and otherwise in blocks of files, one pass over the rows each."""
    size = wanted.agg(F.sum(F.length(F.to_json("wants")) + 64)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("exporter", "file_no"), F.lit(blocks))
    same = rows["exporter"].eqNullSafe(F.col("w_exporter")) & rows["file_no"].eqNullSafe(F.col("w_file_no"))
    out = None
    for i in range(blocks):
        some = wanted.where(block == i).withColumnsRenamed({"exporter": "w_exporter", "file_no": "w_file_no"})
        part = rows.join(F.broadcast(some), same).drop("w_exporter", "w_file_no")
        out = part if out is None else out.unionByName(part)
    return out


def definition_values(workflows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(exporter, pair_no, side, tenant, name, path, digest): a digest of all values at each wanted path.

    On the new side the empty path marks every definition that can be read there.
    """
    import hashlib

    rows = workflows.select("exporter", "file_no", "tenant", "name", "version", "document").where(F.col("document").isNotNull())
    joined = _beside(rows, wanted).select("exporter", "tenant", "name", "version", "document", "wants")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for exporter, tenant, name, version, text, wants in batch.itertuples(index=False):
                value = read_document(text)
                if value is None:
                    continue
                shown: dict[str, str | None] = {}
                for side, pair, paths in ((w["side"], w["pair_no"], w["paths"]) for w in wants):
                    key = (exporter, None if pd.isna(pair) else int(pair), side, tenant, name, version)
                    if side == "new":
                        out.append((*key, "", ""))
                    for path in paths:
                        if path not in shown:
                            values = values_at(value, path)
                            shown[path] = hashlib.blake2b(written(values).encode(), digest_size=16).hexdigest() if values else None
                        if shown[path] is not None:
                            out.append((*key, path, shown[path]))
            if not out:
                continue
            frame = pd.DataFrame(out, columns=["exporter", "pair_no", "side", "tenant", "name", "version", "path", "digest"])
            yield frame.astype({"pair_no": "Int32", "version": "Int32"})

    shown = joined.mapInPandas(
        run, "exporter STRING, pair_no INT, side STRING, tenant STRING, name STRING, version INT, path STRING, digest STRING"
    ).distinct()
    # Of a definition with several versions in the file, all values in order of version.
    return shown.groupBy("exporter", "pair_no", "side", "tenant", "name", "path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version", "digest"))), lambda x: x["digest"]), " ").alias("digest")
    )


def evidence(values: DataFrame) -> DataFrame:
    """(exporter, pair_no, old_path, new_path, share) of pairs of paths under any parents with equal values in at least
    half of the definitions that are in both files and have the old path.

    Equality is found by joining on the values, so only pairs that agree somewhere are formed.
    """
    key = ["exporter", "pair_no", "tenant", "name"]
    exporter_key = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in key]
    old = values.where("side = 'old'").select(*exporter_key, F.col("path").alias("old_path"), "digest")
    new = values.where("side = 'new' AND path <> ''").select(*exporter_key, F.col("path").alias("new_path"), "digest")
    present = values.where("side = 'new' AND path = ''").select(*exporter_key)
    both = old.join(present, key, "left_semi")
    total = both.groupBy("exporter", "pair_no", "old_path").agg(F.count("*").alias("total"))
    equal = both.join(new, [*key, "digest"]).groupBy("exporter", "pair_no", "old_path", "new_path").agg(F.count("*").alias("n"))
    return (
        equal.join(total, ["exporter", "pair_no", "old_path"])
        .where(F.col("n") * 2 >= F.col("total"))
        .select("exporter", "pair_no", "old_path", "new_path", (F.col("n") / F.col("total")).alias("share"))
    )


def scripts(workflows: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(exporter, file_no, change_kind, old_path, new_path, topmost): the edit script of each file.

    The keys of a path stand between SEPARATORs. change_kind is added, removed, retyped, renamed, or moved; a moved path also is removed and
    added. topmost is false for operations below another one's path and for moved.
    """
    schemas = cut_lineage(file_schemas(workflows)) if schemas is None else schemas
    pairs = file_pairs(schemas)
    wanted = cut_lineage(wanted_paths(pairs))
    values = cut_lineage(definition_values(workflows, wanted))
    shares = evidence(values).groupBy("exporter", "pair_no").agg(
        F.collect_list(F.struct("old_path", "new_path", "share")).alias("shares")
    )
    keyed = pairs.withColumn("e", F.coalesce("exporter", F.lit("\x00"))).withColumn("p", F.coalesce(F.col("file_no").cast("string"), F.lit("\x00")))
    shares = shares.select(F.col("exporter").alias("e"), F.col("pair_no").alias("p"), "shares")
    ready = keyed.join(shares, ["e", "p"], "left").select("exporter", "file_no", "old", "new", "shares")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for exporter, number, old, new, listed in rows.itertuples(index=False):
                shared = {} if listed is None else {(x["old_path"], x["new_path"]): x["share"] for x in listed}
                editor = EditScript(lambda a, b: shared.get((a, b), 0.0))
                _, script = editor.match(tree_of(_clean(old)), tree_of(_clean(new)), "", "")
                top = set(topmost(script))
                number = None if pd.isna(number) else int(number)
                for kind, a, b in script:
                    out.append((exporter, number, kind, a, b, (kind, a, b) in top))
                for a, b in editor.moves(script):
                    out.append((exporter, number, "moved", a, b, False))
            if not out:
                continue
            frame = pd.DataFrame(out, columns=["exporter", "file_no", "change_kind", "old_path", "new_path", "topmost"])
            yield frame.astype({"file_no": "Int32"})

    return ready.mapInPandas(
        run, "exporter STRING, file_no INT, change_kind STRING, old_path STRING, new_path STRING, topmost BOOLEAN"
    )


def changes_found(workflows: DataFrame) -> DataFrame:
    """(exporter, file_no, change_kind, old_path, new_path) with dotted paths."""
    dotted = [F.translate(c, SEPARATOR, ".").alias(c) for c in ("old_path", "new_path")]
    return scripts(workflows).where("topmost").select("exporter", "file_no", "change_kind", *dotted)


def path_classes(renames: list[tuple[str, str]], files: dict[str, int]) -> dict[str, str]:
    """Canonical path of each renamed path: of those joined by renames, the one in most files, then the smallest.

    Parents come before their children, whose paths are written below the parents' canonical ones.
    """
    classes: dict[str, str] = {}
    deep = lambda r: r[0].count(SEPARATOR)
    for depth in sorted({deep(r) for r in renames}):
        up: dict[str, str] = {}
        uses: dict[str, int] = defaultdict(int)
        here = [r for r in renames if deep(r) == depth]

        def find(x: str) -> str:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        below = {p: join(canonical(parent(p), classes), p.rpartition(SEPARATOR)[2]) for r in here for p in r}
        for old, new in here:
            up[find(below[old])] = find(below[new])
        for path, at in below.items():
            uses[at] += files.get(path, 0)
        members = defaultdict(list)
        for path in up:
            members[find(path)].append(path)
        classes |= {p: min(m, key=lambda x: (-uses[x], x)) for m in members.values() for p in m}
    return classes


def spelled_alike(paths: list[str]) -> list[tuple[str, str]]:
    """Pairs of paths under one parent whose last keys differ in case and underscores alone, such as timeoutMs."""
    first: dict[tuple[str, str], str] = {}
    pairs = []
    for path in sorted(paths):
        above, _, key = path.rpartition(SEPARATOR)
        other = first.setdefault((above, key.replace("_", "").lower()), path)
        if other != path:
            pairs.append((other, path))
    return pairs


def canonical(path: str, classes: dict[str, str]) -> str:
    """A path under canonical names, from the root down."""
    at = ""
    for key in path.split(SEPARATOR) if path else []:
        at = join(at, key)
        at = classes.get(at, at)
    return at


def move_targets(moves: list[tuple[str, str]], classes: dict[str, str], files: dict[str, int]) -> dict[str, str]:
    """Where each moved path, under canonical names, belongs: of the two places the one that more files have, else the newer."""
    found: dict[str, str] = {}
    for old, new in sorted(moves):
        a, b = (old, new) if files.get(new, 0) >= files.get(old, 0) else (new, old)
        a, b = canonical(a, classes), canonical(b, classes)
        while b in found:
            b = found[b]
        if a != b and a not in found:
            found[a] = b
    return found


def target_types(counts: list[tuple[str, int, int]], classes: dict[str, str]) -> dict[str, int]:
    """The type bit of each canonical path that most files have, from (path, type bits, number of files)."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for path, types, n in counts:
        for bit in _BIT.values():
            if types & bit:
                votes[canonical(path, classes)][bit] += n
    return {path: min(v, key=lambda b: (-v[b], b)) for path, v in votes.items()}


#: Milliseconds of the units in which a length of time may be given (fixed values).
_UNITS = {"ms": 1, "s": 1000, "sec": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000}
_NUMBER = re.compile(r"v?(-?\d+(?:\.\d+)?)")


def fitted(value, target: int):
    """value as the target type, and whether it could be: numbers and truth values in text, versions like v3, times in
    text (as epoch ms), lengths of time with a unit (as ms), texts and lone objects for lists, key-value lists for
    objects. A null fits every type."""
    if value is None or type_bit(value) == target:
        return value, True
    if target == _BIT["number"]:
        if isinstance(value, str):
            if found := _NUMBER.fullmatch(value.strip()):
                return (float(found[1]) if "." in found[1] else int(found[1])), True
            try:
                at = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
            except ValueError:
                return None, False
            return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000), True
        if isinstance(value, dict) and value.get("unit") in _UNITS and type_bit(value.get("value")) == target:
            return value["value"] * _UNITS[value["unit"]], True
    if target == _BIT["boolean"] and isinstance(value, str) and value.strip().lower() in ("true", "false"):
        return value.strip().lower() == "true", True
    if target == _BIT["string"] and isinstance(value, (bool, int, float)):
        return json.dumps(value), True
    if target == _BIT["array"] and isinstance(value, str):
        return [x.strip() for x in value.split(",") if x.strip()], True
    if target == _BIT["array"] and isinstance(value, dict):
        return [value], True
    if target == _BIT["object"] and isinstance(value, list) and all(isinstance(x, dict) and "key" in x and "value" in x for x in value):
        return {str(x["key"]): x["value"] for x in value}, True
    return None, False


def compile_projection(classes: dict[str, str], targets: dict[str, int], moves: dict[str, str] | None = None):
    """A function that gives a document canonical names, places and types, and lists what has no place in it as (place,
    value): what fits no type, the losing one of two fields that come to one name, and what moves to where something is.
    A place is the path as it is written in the document, with positions in lists; a key with dots, brackets or quotes is
    quoted, so no two places are alike.

    Of two fields that come to one name the one that has it already holds, unless it is null. A field that moves goes to
    the object that its old and its new place share, in a list to that of its own element.
    """
    last = {old: new.rpartition(SEPARATOR)[2] for old, new in classes.items()}
    moves = moves or {}

    def named(place: str, key: str) -> str:
        key = key if key and not set(key) & set('.[]"') else json.dumps(key, ensure_ascii=False)
        return f"{place}.{key}" if place else key

    def inside(value, path: str, leftovers: list, place: str, above: tuple, moved: list):
        if isinstance(value, list):
            return [inside(x, path, leftovers, f"{place}[{i}]", above, moved) for i, x in enumerate(value)]
        if not isinstance(value, dict):
            return value
        out: dict = {}
        above = (*above, (path, out))
        source: dict = {}
        for key, inner in value.items():
            at, here = join(path, key), named(place, key)
            name, at = last.get(at, key), classes.get(at, at)
            fit, fits = fitted(inner, targets.get(moves.get(at, at), type_bit(inner)))
            if not fits:
                leftovers.append((here, inner))
            if key not in DATA_FIELDS and at.count(SEPARATOR) + 1 < DEEPEST:
                fit = inside(fit, at, leftovers, here, above, moved)
            if at in moves and fit is not None:
                moved.append((here, inner, fit, moves[at], above))
            elif out.get(name) is None or (name == key and fit is not None):
                lost = source.get(name) if out.get(name) is not None else None
                out[name], source[name] = fit, (here, inner)
                if lost:
                    leftovers.append(lost)
            elif fit is not None:
                leftovers.append((here, inner))
        return out

    def project(value, path: str, leftovers: list):
        moved: list = []
        out = inside(value, path, leftovers, "", (), moved)
        for here, inner, fit, target, above in moved:
            shared, holder = next((p, o) for p, o in reversed(above) if not p or target.startswith(p + SEPARATOR))
            *way, name = target[len(shared) + 1 if shared else 0 :].split(SEPARATOR)
            for key in way:
                if isinstance(holder, dict) and holder.get(key) is None:
                    holder[key] = {}
                holder = holder.get(key) if isinstance(holder, dict) else None
            if isinstance(holder, dict) and holder.get(name) is None:
                holder[name] = fit
            else:
                leftovers.append((here, inner))
        return out

    return project


def consistent_table(workflows: DataFrame) -> DataFrame:
    """One row per stored row: its key, whether it could be read, and its definition under canonical names and types.

    definition is JSON with sorted keys, leftovers a JSON object of what fits no type or lost
    its name to another field, by place (tasks[0].input); the typed columns beside them are
    fields that every definition has. The driver gets one row for each renamed pair of field paths and one for each
    field path and mixture of types, which follow the schema's size and not the data's.
    """
    schemas = cut_lineage(file_schemas(workflows))
    script = scripts(workflows, schemas).where("change_kind IN ('renamed', 'moved')").select("change_kind", "old_path", "new_path").distinct().collect()
    renames, moved = ([(o, n) for k, o, n in script if k == kind] for kind in ("renamed", "moved"))
    types = schemas.where("path <> ''").groupBy("path", "types").agg(F.count("*").alias("n")).collect()
    files: Counter = Counter()
    for path, _, n in types:
        files[path] += n
    classes = path_classes([*renames, *spelled_alike(list(files))], files)
    moves, targets = move_targets(moved, classes, files), target_types(types, classes)
    rows = workflows.select("tenant", "name", "version", "exporter", "file_no", "spec_version", "document")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project = compile_projection(classes, targets, moves)
        whole = lambda x: int(x) if type_bit(x) == _BIT["number"] else None
        for batch in batches:
            out = []
            for text in batch["document"]:
                value = read_document(text)
                if not isinstance(value, dict):
                    out.append((False, None, None, None, None, None, None))
                    continue
                left: list = []
                value = project(value, "", left)
                tasks, about = value.get("tasks"), value.get("description")
                out.append(
                    (
                        True, written(value), written(dict(left)) if left else None,
                        about if isinstance(about, str) else None, whole(value.get("timeout_ms")), whole(value.get("created_at_ms")),
                        len(tasks) if isinstance(tasks, list) else None,
                    )
                )
            names = ["readable", "definition", "leftovers", "description", "timeout_ms", "created_at_ms", "n_tasks"]
            frame = pd.DataFrame(out, columns=names).astype({"timeout_ms": "Int64", "created_at_ms": "Int64", "n_tasks": "Int32"})
            keys = batch[["tenant", "name", "version", "exporter", "file_no", "spec_version"]].reset_index(drop=True)
            yield pd.concat([keys, frame], axis=1)

    return rows.mapInPandas(
        run,
        "tenant STRING, name STRING, version INT, exporter STRING, file_no INT, spec_version INT, readable BOOLEAN, definition STRING, "
        "leftovers STRING, description STRING, timeout_ms BIGINT, created_at_ms BIGINT, n_tasks INT",
    )
