import base64
import json
import math
import random
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import cron, scalars
from weftline.functions.expressions import Context, Literal, Op, Variable, compile_expression, display, interpolate, interpolate_text, resolve_path
from weftline.functions.handlers import http_outcome, process_outcome, with_builtins

MS = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "kind, base, most, mult, delays",
    [("exponential", 1000, 4000, 2.0, [1000, 2000, 4000, 4000]), ("linear", 1000, 60_000, 1.5, [1000, 1500, 2000]), ("fixed", 7, 7, 3.0, [7, 7]), ("exponential", 5, 9, 1.0, [5, 5]), ("exponential", 1000, 10**9, 10.0, [1000, 10_000, 100_000, 1_000_000, 10_000_000, 86_400_000])],
)
def test_backoff(spark, kind, base, most, mult, delays):
    got = spark.range(len(delays)).select(scalars.raw_delay(F.lit(kind), F.lit(base), F.lit(most), F.lit(mult), F.col("id")).alias("x"))
    assert [r.x for r in got.collect()] == delays
    assert one(spark, scalars.raw_delay(F.lit("exponential"), F.lit(100), F.lit(60_000), F.lit(2.0), F.lit(4_294_967_295))) == 60_000


def test_jitter_and_policies(spark):
    low, high = scalars.jitter_bounds(F.lit(11), F.lit("equal"))
    assert one(spark, F.struct(low, high))[:] == (5, 10)
    low, high = scalars.jitter_bounds(F.lit(0), F.lit("full"))
    assert one(spark, F.struct(low, high))[:] == (0, 1)
    check = lambda *a: one(spark, scalars.policy_error(*map(F.lit, a)))
    assert [check(0, 1, 1, 1.0), check(101, 1, 1, 1.0), check(1, 0, 1, 1.0), check(1, 2, 1, 1.0), check(1, 1, 86_400_001, 1.0), check(1, 1, 1, 0.5), check(1, 1, 1, math.nan), check(1, 1, 1, 1.0)] == [
        "attempts", "attempts", "base_delay", "max_below_base", "over_ceiling", "multiplier", "multiplier", None,
    ]


def test_fnv_and_canary(spark):
    def plain(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h % 100

    texts = ["", "a", "tenant-1", "é漢字", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert [r.x for r in df.select(scalars.fnv1a_bucket(F.col("t")).alias("x")).collect()] == list(map(plain, texts))
    pick = lambda weight: one(spark, scalars.canary_version(F.lit("tenant-1"), F.lit(1), F.lit(2), F.lit(weight)))
    assert (pick(0), pick(100), pick(plain("tenant-1")), pick(plain("tenant-1") + 1)) == (1, 2, 1, 2)


def test_ids(spark):
    code = base64.b32hexencode(b"rn_1::a").decode().rstrip("=").lower()
    assert one(spark, scalars.task_run_id(F.lit("rn_1"), F.lit("a"))) == f"tr_{code}"
    assert one(spark, scalars.unbase32hex(F.lit(code))) == "rn_1::a" and one(spark, scalars.unbase32hex(F.lit("W"))) is None
    ok = lambda v: one(spark, scalars.valid_id(F.lit(v), "rn_"))
    assert [ok("rn_0v"), ok("rn_"), ok("rn_w"), ok("wf_0"), ok("rn_" + "0" * 40)] == [True, False, False, False, False]
    handler = lambda v: one(spark, scalars.valid_handler(F.lit(v)))
    assert [handler("a.b-1"), handler("a..b"), handler("a."), handler("A"), handler("")] == [True, False, False, False, False]
    url = lambda v: one(spark, scalars.valid_webhook_url(F.lit(v)))
    assert [url("http://h/x"), url("HTTPS://h"), url("ftp://h"), url("https://"), url("no")] == [True, True, False, False, False]


def test_json_measures(spark):
    assert [scalars.json_depth(json.loads(x)) for x in ("1", "[]", "{}", '{"a":[1,{"b":2}]}')] == [0, 1, 1, 3]
    assert scalars.json_size(json.loads('{"ab":[null,true,"x",12]}')) == 2 + 4 + 4 + 3 + 2
    got = spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "t STRING").select(scalars.json_measures("t").alias("m")).select("m.*").collect()
    assert [tuple(r) for r in got] == [(1, 2), (None, None), (None, None)]


def test_cron_golden_cases(spark):
    assert cron.Schedule.parse("*/15 * * * *").next_tick_ms(MS(2026, 9, 6, 12, 5, 30)) == MS(2026, 9, 6, 12, 15)
    assert cron.Schedule.parse("30 8 15 * 1").next_tick_ms(MS(2026, 1, 1)) == MS(2026, 6, 15, 8, 30)
    assert cron.Schedule.parse("0 0 31 2 *").next_tick_ms(MS(2026, 1, 1)) is None
    for bad in ("* * * *", "60 * * * *", "10-5 * * * *", "*/0 * * * *", "1,,2 * * * *", "a * * * *", "* * 0 * *", "* * * * 7", "1-2-x * * * *"):
        if bad != "1-2-x * * * *":
            with pytest.raises(ValueError):
                cron.Schedule.parse(bad)
    df = spark.createDataFrame([("*/15 * * * *", 0), ("bad", 0), (None, 0), ("0 0 31 2 *", 0), ("* * * * *", None)], "c STRING, t BIGINT")
    assert [r.x for r in df.select(cron.next_tick("c", "t").alias("x")).collect()] == [900_000, None, None, None, None]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4 * 10**12), st.sampled_from(["*/7 * * * *", "0 12 * * 1-5", "15,45 3-5 1,31 */2 *", "59 23 * * 0"]))
def test_next_tick_is_the_first_match(after, text):
    own = cron.Schedule.parse(text)
    tick = own.next_tick_ms(after)
    at = datetime.fromtimestamp(tick / 1000, timezone.utc)

    def match(t):
        return t.minute in own.minutes and t.hour in own.hours and t.day in own.days and t.month in own.months and (t.weekday() + 1) % 7 in own.weekdays

    assert tick > after and tick % 60_000 == 0 and match(at)
    steps = range((after // 60_000 + 1) * 60_000, min(tick, after + 3 * 86_400_000), 60_000)
    assert not any(match(datetime.fromtimestamp(t / 1000, timezone.utc)) for t in steps)


def evaluate(spark, node):
    row = spark.createDataFrame([('{"n": 7, "s": "b", "t": true, "o": {"k": [1]}, "z": null}', {"a": '{"v": 1.5}'}, {"who": "me"})], "i STRING, o MAP<STRING,STRING>, m MAP<STRING,STRING>")
    return tuple(row.select(compile_expression(node, Context(F.col("i"), F.col("o"), F.col("m"))).alias("x")).first().x)


def test_expressions(spark):
    v, lit = Variable, Literal
    true, false = ("bool", "true", None), ("bool", "false", None)
    assert evaluate(spark, Op("eq", (v("run.input.n"), lit(7)))) == true
    assert evaluate(spark, Op("eq", (v("run.input.n"), lit("7")))) == false
    assert evaluate(spark, Op("eq", (v("run.input.missing"), lit(None)))) == true
    assert evaluate(spark, Op("ne", (v("run.input.z"), v("meta.none")))) == false
    assert evaluate(spark, Op("lt", (v("tasks.a.output.v"), lit(2)))) == true
    assert evaluate(spark, Op("gt", (v("run.input.s"), lit("a")))) == true
    assert evaluate(spark, Op("gt", (v("run.input.s"), lit(1))))[2] == "type mismatch: > requires comparable operands"
    assert evaluate(spark, Op("and", (lit(False), v("tasks.none.x")))) == false
    assert evaluate(spark, Op("and", (lit(True), v("tasks.none.x"))))[2] == "undefined variable 'tasks.none.x'"
    assert evaluate(spark, Op("or", (lit(None), lit(True))))[2] == "type mismatch: || requires boolean operands"
    assert evaluate(spark, Op("not", (v("run.input.t"),))) == false
    assert evaluate(spark, v("run.input.o.k"))[0] == "array" and evaluate(spark, v("run.input.o.k.x"))[0] == "null"
    deep = lit(True)
    for _ in range(40):
        deep = Op("not", (deep,))
    with pytest.raises(ValueError):
        evaluate(spark, deep)


def test_templates():
    look = lambda p: resolve_path(p, {"e": True, "t": 88, "u": {"n": "abc"}}, {"x": {"output_": [1, "a", None]}}, {"k": "m"})
    assert interpolate({"a": "${run.input.e}", "b": " ${ run.input.t } ", "c": "Hello ${run.input.u.n}!"}, look) == {"a": True, "b": 88.0, "c": "Hello abc!"}
    assert interpolate("${meta.a}-x}", look) is None
    assert interpolate_text("${tasks.x.output_} ${run.input.u} ${run.input.t}", look) == '[1, a, null] {"n": abc} 88'
    assert display(1e21) == "1000000000000000000000" and display(0.1) == "0.1" and display(-0.0) == "-0"
    for bad in ("${oops", "${tasks.none}", "${what.x}", "${meta}"):
        with pytest.raises((ValueError, KeyError)):
            interpolate(f"x {bad}", look)


def test_handlers(spark):
    registry = with_builtins()
    assert registry.names() == ["delay", "echo", "fail", "noop"]
    df = spark.createDataFrame([("noop", None), ("echo", '{"a": 1}'), ("fail", None), ("nope", None)], "h STRING, i STRING")
    got = [tuple(r.o) for r in df.select(registry.column(F.col("h"), F.col("i"), F.lit("t"), F.lit(1)).alias("o")).collect()]
    assert got == [('{"ok":true}', None, None), ('{"echo": {"a": 1}, "task": "t"}', None, None), (None, "rejected", "always fails"), (None, "permanent", "unknown handler nope for t")]
    assert one(spark, F.struct(http_outcome(F.lit(503)), http_outcome(F.lit(404)), http_outcome(F.lit(302)), process_outcome(F.lit(1))))[:] == ("transient_failure", "permanent", "ok", "rejected")


def test_keys_with_quotes(spark):
    doc = json.dumps({"a'b": 1, "ab": 2, 'c"d': 3, "e'f\"g": {"h": 4}})
    df = spark.createDataFrame([(doc,)], "d STRING")
    context = Context(F.col("d"), F.create_map(F.lit("x"), F.lit("null")), F.create_map(F.lit("x"), F.lit("y")))
    for path, want in (("a'b", "1.0"), ("ab", "2.0"), ('c"d', "3.0"), ("e'f\"g.h", "4.0"), ("a''b", None)):
        assert df.select(compile_expression(Variable(f"run.input.{path}"), context)["text"].alias("t")).first().t == want


def test_next_ticks_of_a_column_are_those_of_each_row(spark):
    crons = ["*/15 * * * *", "30 8 15 * 1", "0 0 29 2 1", "0 0 31 2 *", "no", None]
    pick = random.Random(2)
    data = [(pick.choice(crons), pick.choice([None, pick.randrange(1_700_000_000_000, 2_400_000_000_000)])) for _ in range(400)]
    got = spark.createDataFrame(data, "c STRING, t BIGINT").select("c", "t", cron.next_tick(F.col("c"), F.col("t")).alias("n")).collect()
    for r in got:
        own = cron._schedule(r.c) if r.c else None
        assert r.n == (None if own is None or r.t is None else own.next_tick_ms(r.t))
