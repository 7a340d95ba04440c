import json
import os
import random
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators import nested
from weftline.operators.structural import index

TABLES = Path(os.environ.get("WEFTLINE_TABLES", "/root/testdata/sf0.001"))

json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-999, 999) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4),
    max_leaves=25,
)
documents = st.lists(json_values, max_size=4) | st.dictionaries(st.text(max_size=5), json_values, max_size=4)


def rebuilt(ix, row):
    kind = chr(ix.kind[row])
    if kind == "{":
        return {ix.key(int(c)): rebuilt(ix, int(c)) for c in ix.children([row])}
    if kind == "[":
        return [rebuilt(ix, int(c)) for c in ix.children([row])]
    return json.loads(ix.text(row))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(documents, st.sampled_from([None, 1, "\t"]), st.booleans()), max_size=5))
def test_index_rebuilds_every_document(batch):
    texts = [json.dumps(v, indent=i, ensure_ascii=a).encode() for v, i, a in batch]
    # Truncated ones between them must not disturb their neighbours.
    mixed = [t for text in texts for t in (text, text[:-1], text[: len(text) // 2])]
    ix = index(mixed)
    roots = {int(ix.doc[r]): r for r in range(len(ix.doc)) if ix.box[r] < 0}
    for i, (value, _, _) in enumerate(batch):
        assert ix.good[3 * i] and rebuilt(ix, roots[3 * i]) == value
        assert not ix.good[3 * i + 1]


def test_broken_structures():
    bad = [b"", b"{", b"}{", b"[1}", b'{"a":1}]', b'{"a":"x}', b'{"a" 1}x', b"[]{}", b'[{"a":[1,2}]', b"x[1]", b"\\"]
    ix = index([*bad, b"[]", b'{"a\\"b":[]}'])
    assert ix.good.tolist() == [False] * len(bad) + [True, True]


def flat(spark, docs, extract):
    df = spark.createDataFrame([(str(i), d if d is None or isinstance(d, str) else json.dumps(d), "x") for i, d in enumerate(docs)], "parent_key STRING, document STRING, child STRING")
    return {tuple(r)[:4] for r in nested.flatten(df, extract).collect()}


def test_workflow_tables(spark):
    doc = {
        "tasks": [{"name": "a", "dependsOn": "b, c,,d "}, None, {"name": "b", "needs": ["x", None, "y"]}, {"depends_on": None}],
        "notifications": {"on_error": [{"headers": {"h,1": 1, 'q"': 2}}, {"headers": None}], "on_start": [{"headers": {"no": 1}}]},
        "meta": {"tasks": [{"name": "no"}]},
    }
    lone = {"hooks": {"onFailure": {"headers": {"z": 1}}}, "tasks": []}
    got = flat(spark, [doc, json.dumps(json.dumps(lone)), None, "", "nonsense", '{"tasks":[{"name":"a"}', '{"tasks":[{"a" 1}]}'], nested.workflow_rows)
    assert got == {
        ("0", "task", "0", None), ("0", "task", "2", None), ("0", "task", "3", None), ("0", "task_dep", "0/0", "0"), ("0", "task_dep", "0/1", "0"), ("0", "task_dep", "0/2", "0"),
        ("0", "task_dep", "2/0", "2"), ("0", "task_dep", "2/2", "2"), ("0", "failure_hook", "0", None), ("0", "failure_hook", "1", None),
        ("0", "hook_header", "0/h,1", "0"), ("0", "hook_header", '0/q"', "0"), ("1", "failure_hook", "0", None), ("1", "hook_header", "0/z", "0"),
    }


def test_run_tables_at_any_depth(spark):
    deep = {"output": {"a": [{"b": {"artifacts": [{"parts": [{}, 3, {}]}, "no", {"parts": {"n": 1}}]}}]}, "input": {"artifacts": [{"no": 1}]}}
    lone = {"output": {"artifacts": {"parts": None}}}
    got = flat(spark, [deep, lone, {"output": None}, {"artifacts": [{}]}, {"output": {"\\u0061rtifacts": 1}}], nested.run_rows)
    assert got == {
        ("0", "artifact", "0", None), ("0", "artifact", "2", None), ("0", "artifact_part", "0/0", "0"), ("0", "artifact_part", "0/2", "0"),
        ("0", "artifact_part", "2/0", "2"), ("1", "artifact", "0", None),
    }


def test_long_documents_and_empty_tables(spark):
    long = {"output": {"pad": "\\\"[{" * 200_000, "artifacts": [{"parts": [{}]}] * 3}}
    assert len(flat(spark, [long, long], nested.run_rows)) == 12
    assert flat(spark, [], nested.run_rows) == set()


def test_the_index_knows_what_is_json():
    pick = random.Random(1)
    scalars = [None, True, 1, -2.5, 1e9, "x", 'a"b\\', "é\n", "", " ,:{}[]", 0]

    def value(depth=0):
        kind = pick.random()
        if depth > 4 or kind < 0.3:
            return pick.choice(scalars)
        inner = range(pick.randrange(4))
        return {pick.choice(["a", "b", 'c"', "d,", "e:"]): value(depth + 1) for _ in inner} if kind < 0.65 else [value(depth + 1) for _ in inner]

    def is_json(text):
        try:
            return isinstance(json.loads(text), (dict, list))
        except ValueError:
            return False

    for _ in range(300):
        docs = []
        for _ in range(20):
            text = list(json.dumps([value()], ensure_ascii=pick.random() < 0.5, indent=pick.choice([None, 1])))
            for _ in range(pick.choice([0, 1, 2])):
                at, what = pick.randrange(1, len(text)), pick.choice("{}[],:\"\\ \n\t01-.eEtrufalsn/x\x01u")
                text[at : at + pick.randrange(2)] = what if pick.random() < 0.7 else ""
            docs.append("".join(text).encode())
        assert index(docs).good.tolist() == [is_json(d) for d in docs]


def test_depth_costs_nothing(spark):
    deep = '{"output":' + '{"a":[' * 50_000 + '{"artifacts":[{}]}' + "]}" * 50_000 + "}"
    began = time.perf_counter()
    assert len(index([deep.encode()]).doc) == 100_004
    assert time.perf_counter() - began < 2
    assert flat(spark, [deep], nested.run_rows) == {("0", "artifact", "0", None)}
    twelve = json.dumps({"output": {"artifacts": {}}})
    for _ in range(12):
        twelve = json.dumps(twelve)
    assert flat(spark, [twelve], nested.run_rows) == {("0", "artifact", "0", None)}


@pytest.mark.skipif(not TABLES.exists(), reason="the tables are not here")
def test_tables_against_a_walk(spark):
    """The flat tables with their values, against a plain walk over parsed documents."""

    def parsed(text):
        try:
            while isinstance(text, str):
                text = json.loads(text)
        except ValueError:
            return None
        return text if isinstance(text, (dict, list)) else None

    def among(holder, names):
        return [v for k, v in holder.items() if k in names] if isinstance(holder, dict) else []

    def listed(value):
        found = enumerate([value] if isinstance(value, dict) else value if isinstance(value, list) else [])
        return [(i, x) for i, x in found if isinstance(x, dict)]

    def held(value):
        for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else []:
            yield from held(inner)
        yield from among(value, nested.ARTIFACTS)

    want = set()
    for r in spark.read.parquet(f"{TABLES}/workflows.parquet").select("tenant", "name", "version", "document").collect():
        key, doc = f"{r.tenant}/{r.name}/{r.version}", parsed(r.document)
        for i, task in (x for tasks in among(doc, nested.TASKS) for x in listed(tasks)):
            want.add((key, "task", f"{i}", None, repr(task)))
            for deps in among(task, nested.DEPENDENCIES):
                names = [p.strip() for p in deps.split(",") if p.strip()] if isinstance(deps, str) else deps or []
                want |= {(key, "task_dep", f"{i}/{j}", f"{i}", repr(d)) for j, d in enumerate(names)}
        for hooks in among(doc, nested.HOOKS):
            for i, hook in (x for failure in among(hooks, nested.ON_FAILURE) for x in listed(failure)):
                want.add((key, "failure_hook", f"{i}", None, repr(hook)))
                want |= {(key, "hook_header", f"{i}/{h}", f"{i}", repr(v)) for headers in among(hook, nested.HEADERS) for h, v in (headers or {}).items()}
    for r in spark.read.parquet(f"{TABLES}/runs.parquet").select("id", "document").collect():
        for i, artifact in (x for out in among(parsed(r.document), nested.OUTPUT) for a in held(out) for x in listed(a)):
            want.add((r.id, "artifact", f"{i}", None, repr(artifact)))
            want |= {(r.id, "artifact_part", f"{i}/{j}", f"{i}", repr(p)) for parts in among(artifact, nested.PARTS) for j, p in listed(parts)}
    got = {(*r[:4], repr(json.loads(r[4]))) for r in nested.flat_rows(spark, str(TABLES)).collect()}
    assert got == want and len(want) > 100
