import ast
import json
import os
from collections import Counter
from pathlib import Path

import pytest

from weftline.operators import drift
from weftline.operators.drift import SEPARATOR as S

TABLES = Path(os.environ.get("WEFTLINE_TABLES", "/root/testdata/sf0.001"))
SCHEMA = "tenant STRING, name STRING, version INT, exporter STRING, file_no INT, document STRING, spec_version INT, path STRING, old STRING, new STRING"


def table(spark, docs):
    rows = [(t, n, v, e, f, d if d is None or isinstance(d, str) else json.dumps(d), 1, "", "", "") for t, n, v, e, f, d in docs]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, docs):
    found = drift.changes_found(table(spark, docs)).collect()
    return {(r.exporter, r.file_no, r.change_kind, r.old_path, r.new_path) for r in found}


def test_every_kind_of_change(spark):
    old = {"a": 1, "keep": {"x": [{"y": 1}, {"y": 2}], "gone": 3}, "t": 5, "meta": {"free": 1}, "size": "7"}
    new = {"b": 1, "keep": {"x": [{"z": 1}, {"z": 2}], "fresh": {"deep": 1}}, "t": {"unit": "ms"}, "meta": {"other": 1}, "size": 7}
    docs = [("t", "n", 1, "e", 1, old), ("t", "n", 2, "e", 3, json.dumps(json.dumps(new))), ("t", "n", 2, "e", 3, None), ("t", "n", 3, "e", 2, "{broken")]
    assert changes(spark, docs) == {
        ("e", 3, "renamed", "a", "b"), ("e", 3, "renamed", "keep.x.y", "keep.x.z"), ("e", 3, "removed", "keep.gone", "keep.gone"),
        ("e", 3, "added", "keep.fresh", "keep.fresh"), ("e", 3, "retyped", "t", "t"), ("e", 3, "retyped", "size", "size"),
    }


def test_rename_needs_half_of_the_common_definitions(spark):
    def docs(equal):
        before = [("t", f"n{i}", 1, "e", 1, {"a": i}) for i in range(4)]
        after = [("t", f"n{i}", 2, "e", 2, {"b": i if i < equal else -1}) for i in range(4)]
        return before + after

    assert changes(spark, docs(2)) == {("e", 2, "renamed", "a", "b")}
    assert changes(spark, docs(1)) == {("e", 2, "removed", "a", "a"), ("e", 2, "added", "b", "b")}


def test_empty_and_null_tables(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(None, None, None, None, None, None), (None, None, None, None, None, {"a": 1}), (None, None, None, None, 1, {"b": 1})]) == {
        (None, 1, "renamed", "a", "b")
    }


def test_repeated_rows_and_null_values(spark):
    docs = [("t", "n", 1, "e", 1, {"a": None}), ("t", "n", 1, "e", 1, {"a": None}), ("t", "n", 2, "e", 2, {"a": 3})]
    assert changes(spark, docs) == set()


def test_edit_script_prefers_the_better_evidence_and_finds_moves():
    shares = {("a", "x"): 0.5, ("a", "y"): 1.0, ("b", "x"): 0.6, (f"p{S}v", f"q{S}v"): 1.0}
    editor = drift.EditScript(lambda o, n: shares.get((o, n), 0.0))
    old = drift.tree_of({"a": 2, "b": 2, "p": 8, f"p{S}v": 2, "q": 8})
    new = drift.tree_of({"x": 2, "y": 2, "p": 8, "q": 8, f"q{S}v": 2})
    _, script = editor.match(old, new, "", "")
    assert ("renamed", "a", "y") in script and ("renamed", "b", "x") in script
    assert editor.moves(script) == [(f"p{S}v", f"q{S}v")]


@pytest.mark.parametrize("size", [1, 3, 6])
def test_assignment_is_least(size):
    import itertools

    import numpy as np

    cost = np.random.default_rng(size).integers(0, 20, (size, size)).astype(float)
    best = min(sum(cost[i, p[i]] for i in range(size)) for p in itertools.permutations(range(size)))
    assert sum(cost[i, j] for i, j in drift.assign(cost)) == best


def test_one_consistent_table(spark):
    def doc(new, i):
        if not new:
            return {"description": f"d{i}", "timeout_ms": 1000 * i, "tasks": [{"needs": [f"x{i}"]}], "hooks": {"on_failure": [{"url": f"u{i}"}]}, "tags": {"a": "b"}, "version": i}
        return {
            "summary": f"d{i}", "timeout_ms": {"value": i, "unit": "s"}, "tasks": [{"depends_on": [f"x{i}"]}], "hooks": {"on_failure": {"url": f"u{i}"}},
            "tags": [{"key": "a", "value": "b"}], "version": f"v{i}",
        }

    docs = [("t", f"n{i}", v, "e", v, doc(v == 3, i)) for v in (1, 2, 3) for i in (1, 2)] + [("t", "k", 1, "e", 3, "{nothing"), ("t", "k", 2, "f", 1, {"version": {"odd": 1}})]
    got = {(r.name, r.version): r for r in drift.consistent_table(table(spark, docs)).collect()}
    assert got["k", 1].readable is False and got["n2", 3].n_tasks == 1
    assert [got["n2", v].timeout_ms for v in (1, 2, 3)] == [2000] * 3
    assert got["n1", 1].definition == got["n1", 3].definition and got["n1", 1].description == "d1"
    assert json.loads(got["k", 2].leftovers) == {"version": {"odd": 1}}
    assert drift.consistent_table(table(spark, [])).count() == 0


def test_nothing_is_lost_that_fits_no_type_or_loses_its_name():
    project = drift.compile_projection({"timeoutMs": "timeout_ms"}, {f"tasks{S}n": drift._BIT["number"]})
    left: list = []
    value = project({"tasks": [{"n": "odd"}, {"n": 2}, {"n": ["x"]}], "a": {"b.c": 1}}, "", left)
    assert value["tasks"] == [{"n": None}, {"n": 2}, {"n": None}] and left == [("tasks[0].n", "odd"), ("tasks[2].n", ["x"])]
    for text, want, lost in [
        ({"timeoutMs": 5, "timeout_ms": 6}, 6, [("timeoutMs", 5)]), ({"timeout_ms": 6, "timeoutMs": 5}, 6, [("timeoutMs", 5)]),
        ({"timeoutMs": 5, "timeout_ms": None}, 5, []), ({"timeout_ms": None, "timeoutMs": 5}, 5, []),
    ]:
        left = []
        assert project(text, "", left) == {"timeout_ms": want} and left == lost
    project = drift.compile_projection({}, {"a.b": drift._BIT["number"], f"a{S}b": drift._BIT["number"]})
    left = []
    project({"a": {"b": "odd"}, "a.b": "odder"}, "", left)
    assert dict(left) == {"a.b": "odd", '"a.b"': "odder"}


def test_values_take_the_type_asked_for():
    bit = {n: 1 << i for i, n in enumerate(drift.TYPES)}
    cases = [
        ("12", "number", (12, True)), (" 1.5", "number", (1.5, True)), ("v7", "number", (7, True)), ("1970-01-01T00:00:01Z", "number", (1000, True)), ("soon", "number", (None, False)),
        ({"value": 2, "unit": "min"}, "number", (120_000, True)), ("TRUE", "boolean", (True, True)), ("no", "boolean", (None, False)), (3, "string", ("3", True)),
        ("a, b,,", "array", (["a", "b"], True)), ({"x": 1}, "array", ([{"x": 1}], True)), ([{"key": "k", "value": 1}], "object", ({"k": 1}, True)), ([1], "object", (None, False)), (None, "object", (None, True)),
    ]
    for value, target, want in cases:
        assert drift.fitted(value, bit[target]) == want


def deep(text):
    return text.replace(".", S)


def test_spelling_alone_is_no_other_field():
    assert drift.spelled_alike([deep(p) for p in ("a.x_y", "a.xY", "b.xY", "a.z")]) == [(deep("a.xY"), deep("a.x_y"))]


def test_names_are_followed_below_renamed_parents():
    pairs = [("hooks", "notifications"), ("notifications.on_failure", "notifications.on_error"), ("hooks.on_failure", "hooks.failed")]
    files = {"hooks": 3, "notifications": 2, "hooks.on_failure": 2, "hooks.failed": 1}
    classes = drift.path_classes([(deep(a), deep(b)) for a, b in pairs], {deep(k): n for k, n in files.items()})
    assert drift.canonical(deep("notifications.on_error.url"), classes) == drift.canonical(deep("hooks.failed.url"), classes) == deep("hooks.on_failure.url")
    # A key with a dot is one key.
    assert drift.canonical("hooks.failed", classes) == "hooks.failed"


def test_moves_are_projected():
    project = drift.compile_projection({}, {}, drift.move_targets([(deep("tasks.retry.max"), deep("tasks.limits.max")), ("note", deep("about.note"))], {}, {}))
    left: list = []
    value = project({"note": "n", "tasks": [{"retry": {"max": 1, "x": 2}}, {"retry": {"max": 3}, "limits": {"max": 4}}, {"limits": [5], "retry": {"max": 6}}]}, "", left)
    assert value == {"about": {"note": "n"}, "tasks": [{"retry": {"x": 2}, "limits": {"max": 1}}, {"retry": {}, "limits": {"max": 4}}, {"limits": [5], "retry": {}}]}
    assert left == [("tasks[1].retry.max", 3), ("tasks[2].retry.max", 6)]


def test_a_move_between_files(spark):
    before = [("t", f"n{i}", 1, "e", 1, {"own": i, "about": {}}) for i in range(3)]
    after = [("t", f"n{i}", v, "e", v, {"about": {"own": i}}) for i in range(3) for v in (2, 3)]
    assert changes(spark, before + after) == {("e", 2, "removed", "own", "own"), ("e", 2, "added", "about.own", "about.own")}
    got = {(r.name, r.version): r.definition for r in drift.consistent_table(table(spark, before + after)).collect()}
    assert got["n1", 1] == got["n1", 2] == '{"about": {"own": 1}}'


def test_deep_and_often_encoded_documents(spark):
    nested = '{"input":' + "[" * 5000 + "1" + "]" * 5000 + "}"
    often = '{"a": 1}'
    for _ in range(11):
        often = json.dumps(often)
    docs = [("t", "n", 1, "e", 1, nested), ("t", "m", 1, "e", 1, often), ("t", "k", 1, "f", 1, '{"b":' * 4000 + "1" + "}" * 4000)]
    got = {r.name: r for r in drift.consistent_table(table(spark, docs)).collect()}
    assert got["m"].definition == '{"a": 1}' and got["n"].readable and got["k"].readable
    assert got["n"].definition.count("[") == 5000 and got["k"].definition.count("{") == 4000
    assert drift.file_schemas(table(spark, docs)).where("exporter = 'f'").count() == 257


def leaves(value):
    if isinstance(value, (dict, list)):
        return [x for inner in (value.values() if isinstance(value, dict) else value) for x in leaves(inner)]
    return [] if value is None else [repr(value)]


@pytest.mark.skipif(not TABLES.exists(), reason="the tables are not here")
def test_every_value_is_in_the_definition_or_beside_it(spark):
    rows = drift.consistent_table(spark.read.parquet(f"{TABLES}/workflows.parquet")).drop("definition", "leftovers").columns
    docs = spark.read.parquet(f"{TABLES}/workflows.parquet").collect()
    texts = [d.document for d in docs]
    frame = spark.createDataFrame([(str(i), "n", 1, "e", int(d.file_no), d.document, 1) for i, d in enumerate(docs)], "tenant STRING, name STRING, version INT, exporter STRING, file_no INT, document STRING, spec_version INT")
    got = {int(r.tenant): r for r in drift.consistent_table(frame).collect()}
    assert len(got) == len(texts) and "timeout_ms" in rows
    seen = 0
    for i, text in enumerate(texts):
        value = drift.read_document(text)
        assert got[i].readable == isinstance(value, dict)
        if not isinstance(value, dict):
            continue
        kept = Counter(leaves(json.loads(got[i].definition)) + leaves(json.loads(got[i].leftovers or "{}")))
        # Values that took another form (a length of time as milliseconds, a list for a text) are there in that form.
        lost = Counter(leaves(value)) - kept
        seen += 1
        assert all(any(_same_but_for_its_form(x, k) for k in kept) for x in lost), (i, lost)
    assert seen > 50


def _same_but_for_its_form(lost, kept):
    lost, kept = str(ast.literal_eval(lost)), str(ast.literal_eval(kept))
    if kept in [x.strip() for x in lost.split(",")] or lost.lower().lstrip("v") == kept.lower() or lost in drift._UNITS:
        return True
    if lost in ("a", "b") or any(x.isalpha() for x in lost):
        return drift.fitted(lost, drift._BIT["number"]) == (float(kept), True) if kept.replace(".", "", 1).isdigit() else kept == lost
    return kept.replace(".", "", 1).isdigit() and lost.replace(".", "", 1).isdigit() and float(lost) in [float(kept) / u for u in drift._UNITS.values()]


@pytest.mark.skipif(not TABLES.exists(), reason="the tables are not here")
def test_changes_against_the_definition(spark):
    """The changes of the tables against a plain reading of what a change is."""
    files: dict = {}
    for r in spark.read.parquet(f"{TABLES}/workflows.parquet").collect():
        if (value := drift.read_document(r.document)) is not None:
            files.setdefault((r.exporter, r.file_no), []).append((r.tenant, r.name, r.version, r.document, value))
    want, exporters = set(), {}
    for exporter, number in files:
        exporters.setdefault(exporter, []).append(number)

    def schema(at):
        found: dict = {}
        for *_, value in files[at]:
            for path, types in drift.schema_of(value).items():
                found[path] = found.get(path, 0) | types
        return found

    def values(at, path):
        found: dict = {}
        for tenant, name, _, _, value in sorted({d[:4]: d for d in files[at]}.values(), key=lambda d: (d[:3], d[3])):
            found.setdefault((tenant, name), []).extend(drift.values_at(value, path))
        return found

    for exporter, numbers in exporters.items():
        for a, b in zip(sorted(numbers), sorted(numbers)[1:]):
            old, new = schema((exporter, a)), schema((exporter, b))
            gone, come = drift.changed_paths(old, new)
            pairs = []
            for o in gone:
                before = {k: v for k, v in values((exporter, a), o).items() if v}
                for n in come:
                    after = values((exporter, b), n)
                    both = [k for k in before if k in after]
                    equal = sum(before[k] == after[k] for k in both)
                    if drift.parent(o) == drift.parent(n) and both and 2 * equal >= len(both):
                        pairs.append((equal / len(both), o, n))
            taken: set = set()
            found = [("retyped", p, p) for p in old if p in new and old[p] and new[p] and old[p] != new[p]]
            for _, o, n in sorted(pairs, key=lambda x: -x[0]):
                if o not in taken and n not in taken:
                    taken |= {o, n}
                    found.append(("renamed", o, n))
            found += [("removed", o, o) for o in gone if o not in taken] + [("added", n, n) for n in come if n not in taken]
            want |= {(exporter, b, k, o.replace(S, "."), n.replace(S, ".")) for k, o, n in found}
    got = {tuple(r) for r in drift.changes_found(spark.read.parquet(f"{TABLES}/workflows.parquet")).collect()}
    above = {(e, f, p) for e, f, *ps in got for p in ps[1:]}
    hidden = lambda x: any((x[0], x[1], p.rpartition(".")[0]) in above for p in x[3:])
    assert got == {x for x in want if not hidden(x)} and len(got) > 5


def test_values_at_follow_document_order():
    assert drift.values_at({"a": [{"b": 1}, [{"b": [2]}], {"c": 0}, {"b": None}]}, f"a{S}b") == [1, [2], None]
