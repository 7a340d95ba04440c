"""Expressions over JSON: an AST compiled into columns, and templates.

Values are columns of one struct: kind (null, bool, number, string, array, object), text (the value's comparable
form) and error. Comparison is two-valued and by structure; order needs two numbers or two strings; logic needs
booleans, evaluates its right side only when the left one leaves it open, and an error on the way is the result.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The deepest expression, and the texts of errors, which are part of results (fixed values).
DEEPEST = 32
TOO_DEEP = "maximum expression nesting depth exceeded"
UNDEFINED = "undefined variable '{}'"
MISMATCH = "type mismatch: {}"
NOT_BOOLEAN = {"not": "! requires boolean operand", "and": "&& requires boolean operands", "or": "|| requires boolean operands"}
NOT_COMPARABLE = {"lt": "< requires comparable operands", "gt": "> requires comparable operands"}


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Variable:
    """A dotted path below one of the roots: run.input, tasks.<name>[.output], meta.<key>."""

    path: str


@dataclass(frozen=True)
class Op:
    """name: eq, ne, lt, gt, and, or, not."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Context:
    """JSON text columns: the run's input, a map from task name to output, a map of metadata."""

    run_input: Column
    task_outputs: Column
    meta: Column


def _value(kind: Column, text: Column, error: Column | None = None) -> Column:
    no = F.lit(None).cast("string")
    return F.struct(kind.cast("string").alias("kind"), text.cast("string").alias("text"), (no if error is None else error).alias("error"))


def _of_variant(variant: Column) -> Column:
    return _bound(variant, _typed)


def _typed(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    kind = (
        F.when(v.isNull() | (shape == "VOID"), "null").when(shape == "BOOLEAN", "bool").when(shape == "STRING", "string")
        .when(F.startswith(shape, F.lit("ARRAY")), "array").when(F.startswith(shape, F.lit("OBJECT")), "object").otherwise("number")
    )
    number = F.try_variant_get(v, "$", "double").cast("string")
    text = F.when(kind == "number", number).when(kind.isin("bool", "string"), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    return _value(kind, F.when(kind == "null", F.lit(None)).otherwise(text))


def _below(document: Column, keys: list[str]) -> Column:
    v = F.try_parse_json(document)
    for key in keys:
        if "'" not in key:
            v = F.try_variant_get(v, f"$['{key}']", "variant")
        elif '"' not in key:
            v = F.try_variant_get(v, f'$["{key}"]', "variant")
        else:
            v = F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))
    return _of_variant(v)


def _resolve(path: str, context: Context) -> Column:
    parts = path.split(".")
    undefined = _value(F.lit("null"), F.lit(None), F.lit(UNDEFINED.format(path)))
    if parts[:2] == ["run", "input"]:
        return _below(context.run_input, parts[2:])
    if parts[0] == "tasks" and len(parts) >= 2:
        rest = parts[3:] if parts[2:3] == ["output"] else parts[2:]
        document = F.try_element_at(context.task_outputs, F.lit(parts[1]))
        return F.when(F.map_contains_key(context.task_outputs, parts[1]), _below(document, rest)).otherwise(undefined)
    if parts[0] == "meta" and len(parts) == 2:
        text = F.try_element_at(context.meta, F.lit(parts[1]))
        return _value(F.when(text.isNull(), "null").otherwise("string"), text)
    return undefined


def _literal(value: Any) -> Column:
    if value is None:
        return _value(F.lit("null"), F.lit(None))
    if isinstance(value, bool):
        return _value(F.lit("bool"), F.lit(str(value).lower()))
    if isinstance(value, (int, float)):
        return _value(F.lit("number"), F.lit(float(value)).cast("string"))
    if isinstance(value, str):
        return _value(F.lit("string"), F.lit(value))
    return _of_variant(F.parse_json(F.lit(json.dumps(value))))


def compile_expression(node: Any, context: Context, depth: int = 0) -> Column:
    if depth > DEEPEST:
        raise ValueError(TOO_DEEP)
    if isinstance(node, Literal):
        return _literal(node.value)
    if isinstance(node, Variable):
        return _resolve(node.path, context)
    args = [compile_expression(a, context, depth + 1) for a in node.args]
    truth = lambda c: _value(F.lit("bool"), c.cast("string"))
    wrong = lambda what: _value(F.lit("null"), F.lit(None), F.lit(MISMATCH.format(what)))

    if node.name == "not":
        what = wrong(NOT_BOOLEAN["not"])
        return _bound(args[0], lambda x: F.when(x["error"].isNotNull(), x).when(x["kind"] == "bool", truth(x["text"] == "false")).otherwise(what))
    if node.name in ("and", "or"):
        what = wrong(NOT_BOOLEAN[node.name])
        settled = "false" if node.name == "and" else "true"
        right = _bound(args[1], lambda r: F.when(r["error"].isNotNull() | (r["kind"] == "bool"), r).otherwise(what))
        return _bound(
            args[0], lambda x: F.when(x["error"].isNotNull(), x).when(x["kind"] != "bool", what).when(x["text"] == settled, x).otherwise(right)
        )

    def compared(left: Column, right: Column) -> Column:
        first = F.when(left["error"].isNotNull(), left).when(right["error"].isNotNull(), right)
        if node.name in ("eq", "ne"):
            nan = (left["kind"] == "number") & (left["text"] == "NaN")
            same = (left["kind"] == right["kind"]) & left["text"].eqNullSafe(right["text"]) & ~nan
            return first.otherwise(truth(same if node.name == "eq" else ~same))
        less = node.name == "lt"
        a, b = left["text"], right["text"]
        n, m = a.try_cast("double"), b.try_cast("double")
        kinds = lambda kind: (left["kind"] == kind) & (right["kind"] == kind)
        return (
            first.when(kinds("number"), truth((n < m) if less else (n > m)))
            .when(kinds("string"), truth((a < b) if less else (a > b)))
            .otherwise(wrong(NOT_COMPARABLE[node.name]))
        )

    return _bound(args[0], lambda x: _bound(args[1], lambda y: compared(x, y)))


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once; without it, an expression would grow with every mention of an operand."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ------------------------------------------------------------------------------------------------------- templates


def resolve_path(path: str, run_input: Any, tasks: dict[str, Any], meta: dict[str, str]) -> Any:
    """The JSON value at a path; missing keys give None, an unknown root or task is a KeyError."""
    parts = path.split(".")
    if parts[:2] == ["run", "input"]:
        at, rest = run_input, parts[2:]
    elif parts[0] == "tasks" and len(parts) >= 2:
        at, rest = tasks[parts[1]], parts[3:] if parts[2:3] == ["output"] else parts[2:]
    elif parts[0] == "meta" and len(parts) == 2:
        return meta.get(parts[1])
    else:
        raise KeyError(path)
    for key in rest:
        at = at.get(key) if isinstance(at, dict) else None
    return at


def display(value: Any) -> str:
    """Text of a value inside a longer text: whole numbers without a point, strings in lists without quotes."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        number = float(value)
        if number.is_integer():
            return "-0" if number == 0 and math.copysign(1, number) < 0 else str(int(number))
        return np.format_float_positional(number, trim="-")
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "[" + ", ".join(map(display, value)) + "]"
    return "{" + ", ".join(f'"{k}": {display(value[k])}' for k in sorted(value)) + "}"


def as_numbers(value: Any) -> Any:
    """All numbers become floating point, as values do that pass through an expression."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return [as_numbers(x) for x in value] if isinstance(value, list) else {k: as_numbers(v) for k, v in value.items()}


def interpolate_text(template: str, look) -> str:
    out, at = [], 0
    while (start := template.find("${", at)) >= 0:
        end = template.find("}", start + 2)
        if end < 0:
            raise ValueError(f"unclosed expression at {start}")
        out += [template[at:start], display(look(template[start + 2 : end].strip()))]
        at = end + 1
    return "".join([*out, template[at:]])


def interpolate(value: Any, look) -> Any:
    """A string that is one whole expression becomes its value; in other strings expressions become text."""
    if isinstance(value, str):
        trimmed = value.strip()
        if trimmed.startswith("${") and trimmed.endswith("}") and "${" not in trimmed[2:-1]:
            return as_numbers(look(trimmed[2:-1].strip()))
        return interpolate_text(value, look)
    if isinstance(value, list):
        return [interpolate(x, look) for x in value]
    return {k: interpolate(v, look) for k, v in value.items()} if isinstance(value, dict) else value


@F.pandas_udf(T.StructType([T.StructField("result", T.StringType()), T.StructField("error", T.StringType())]))
def render_template(templates: pd.Series, run_inputs: pd.Series, tasks: pd.Series, metas: pd.Series) -> pd.DataFrame:
    """Templates (JSON texts) filled from run inputs, task outputs and metadata (JSON texts); errors are rows too."""

    def one(template, run_input, outputs, meta):
        try:
            own = [None if x is None else json.loads(x) for x in (template, run_input, outputs, meta)]
            look = lambda path: resolve_path(path, own[1], own[2] or {}, own[3] or {})
            return json.dumps(interpolate(own[0], look), sort_keys=True), None
        except KeyError as e:
            return None, UNDEFINED.format(e.args[0])
        except ValueError as e:
            return None, str(e)

    rows = [one(*x) for x in zip(templates, run_inputs, tasks, metas)]
    return pd.DataFrame(rows, columns=["result", "error"])
