"""Scalar functions: backoff, hashes, ids, validators, JSON measures. Columns where built-ins can say it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.structural import loaded, read_document

MOST_BACKOFF_MS = 86_400_000
#: Limits of a run's input (fixed values).
MAX_INPUT_BYTES = 1 << 20
MAX_INPUT_DEPTH = 64
BASE32_DIGITS = "0123456789abcdefghijklmnopqrstuv"  # fixed value


def raw_delay(kind: Column, base: Column, most: Column, multiplier: Column, index: Column) -> Column:
    """Backoff before jitter: fixed, linear or exponential growth, cut to whole ms, within [base, min(most, a day)]."""
    top = F.least(most, F.lit(MOST_BACKOFF_MS)).cast("double")
    b, i = base.cast("double"), index.cast("double")
    grown = (
        F.when((kind == "linear") & (multiplier > 1), b + F.floor(b * (multiplier - 1) * i))
        .when((kind == "exponential") & (multiplier > 1), b * F.pow(multiplier, i))
        .otherwise(b)
    )
    return F.greatest(F.floor(F.least(grown, top)).cast("bigint"), base.cast("bigint"))


def jitter_bounds(raw: Column, jitter: Column) -> tuple[Column, Column]:
    """Least and greatest delay a jitter may give; the draw itself is random and not part of the engine."""
    half = F.floor(raw / 2).cast("bigint")
    low = F.when(jitter == "none", raw).when(jitter == "equal", half).otherwise(F.lit(0).cast("bigint"))
    high = F.when(jitter == "none", raw).when(jitter == "equal", half + F.greatest(half, F.lit(1))).otherwise(F.greatest(raw, F.lit(1)))
    return low, high


def outbox_backoff(base: int, attempts: Column) -> Column:
    return (F.lit(max(base, 10)) * F.pow(F.lit(2.0), F.least(attempts, F.lit(10)))).cast("bigint")


def policy_error(attempts: Column, base: Column, most: Column, multiplier: Column) -> Column:
    """The first broken rule of a retry policy, or null."""
    return (
        F.when((attempts < 1) | (attempts > 100), "attempts")
        .when(base < 1, "base_delay")
        .when(most < base, "max_below_base")
        .when(most > MOST_BACKOFF_MS, "over_ceiling")
        .when(F.isnan(multiplier) | (multiplier < 1) | (multiplier == float("inf")), "multiplier")
    )


def fnv1a_bucket(key: Column) -> Column:
    """FNV-1a (64 bits) of the UTF-8 bytes, modulo 100. Products are taken in halves, in decimals wide enough for them."""
    two64, prime = "18446744073709551616", 0x100000001B3
    bytes_ = F.transform(
        F.sequence(F.lit(1), F.octet_length(key)),
        lambda i: F.conv(F.substring(F.hex(F.encode(key, "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"),
    )
    bytes_ = F.when(F.octet_length(key) > 0, bytes_).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("high"), F.lit(0x84222325).cast("bigint").alias("low"))
    word = 1 << 32

    def step(h, byte):
        # (high * 2^32 + low) * prime mod 2^64 with prime = 2^40 + 435.
        low = h["low"].bitwiseXOR(byte)
        product = low * 435
        high = (h["high"] * 435 + F.floor(product / F.lit(word)).cast("bigint") + low * 256) % word
        return F.struct(high.alias("high"), (product % word).alias("low"))

    h = F.aggregate(bytes_, start, step)
    return ((h["high"] * (word % 100) + h["low"] % 100) % 100).cast("int")


def canary_version(key: Column, baseline: Column, canary: Column, weight: Column) -> Column:
    return F.when(weight <= 0, baseline).when(weight >= 100, canary).when(fnv1a_bucket(key) < weight, canary).otherwise(baseline)


@F.pandas_udf(T.StringType())
def base32hex(texts: pd.Series) -> pd.Series:
    """Lower-case, unpadded base32hex of the UTF-8 bytes."""
    import base64

    return texts.map(lambda t: None if t is None else base64.b32hexencode(t.encode()).decode().rstrip("=").lower())


@F.pandas_udf(T.StringType())
def unbase32hex(texts: pd.Series) -> pd.Series:
    """The text such a code stands for; null if it is none."""
    import base64

    def decode(text: str | None) -> str | None:
        if not text or set(text) - set(BASE32_DIGITS):
            return None
        try:
            return base64.b32hexdecode(text.upper() + "=" * (-len(text) % 8)).decode()
        except ValueError:
            return None

    return texts.map(decode)


def task_run_id(run_id: Column, task_name: Column) -> Column:
    return F.concat(F.lit("tr_"), base32hex(F.concat(run_id, F.lit("::"), task_name)))


def valid_id(value: Column, prefix: str, most_bytes: int = 24) -> Column:
    """Prefix, at most 96 characters, a base32hex body of one or more bytes that decodes to at most most_bytes."""
    body = F.substring(value, len(prefix) + 1, 96)
    return (
        F.startswith(value, F.lit(prefix))
        & (F.length(value) <= 96)
        & body.rlike("^[0-9a-v]+$")
        & (F.floor(F.length(body) * 5 / 8) <= most_bytes)
    )


def valid_tenant(value: Column) -> Column:
    return value.rlike("^[a-z][a-z0-9-]{0,47}$")


def valid_name(value: Column) -> Column:
    return value.rlike("^[a-z][a-z0-9-]{0,63}$")


def valid_handler(value: Column) -> Column:
    return (F.length(value) <= 80) & value.rlike(r"^[a-z][a-z0-9-]*(\.[a-z0-9-]+)*$")


def valid_webhook_url(value: Column) -> Column:
    scheme = F.lower(F.try_parse_url(value, F.lit("PROTOCOL")))
    host = F.try_parse_url(value, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & (F.length(host) > 0), F.lit(False))


def split_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_tags(value: Column) -> tuple[Column, Column]:
    """Tags of a text such as a=1,b=2, and the error that keeps them from being read: a part without '=' or a key that comes
    twice. Blanks around parts, keys and values do not count; an error leaves no tags."""
    parts = F.transform(split_list(value), lambda x: F.split(x, "=", 2))
    keys = F.transform(parts, lambda p: F.trim(F.get(p, F.lit(0))))
    error = F.when(F.exists(parts, lambda p: F.size(p) < 2), "no_value").when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_key")
    values = F.transform(parts, lambda p: F.trim(F.get(p, F.lit(1))))
    return F.when(error.isNull(), F.map_from_arrays(F.when(error.isNull(), keys), F.when(error.isNull(), values))), error


def json_depth(value) -> int:
    deepest, stack = 0, [(value, 0)]
    while stack:
        at, depth = stack.pop()
        inner = at.values() if isinstance(at, dict) else at if isinstance(at, list) else None
        if inner is None:
            deepest = max(deepest, depth)
        else:
            deepest = max(deepest, depth + 1)
            stack += [(x, depth + 1) for x in inner]
    return deepest


def json_size(value) -> int:
    """An approximation: no punctuation is counted, and null and booleans are four bytes."""
    total, stack = 0, [value]
    while stack:
        at = stack.pop()
        if at is None or isinstance(at, bool):
            total += 4
        elif isinstance(at, (int, float)):
            total += len(json.dumps(at))
        elif isinstance(at, str):
            total += len(at.encode()) + 2
        elif isinstance(at, dict):
            total += sum(len(k.encode()) for k in at)
            stack += at.values()
        else:
            stack += at
    return total


@F.pandas_udf(T.StringType())
def _innermost(texts: pd.Series) -> pd.Series:
    def inner(text: str | None) -> str | None:
        while text is not None and text.lstrip()[:1] == '"':
            try:
                text = json.loads(text)
            except ValueError:
                return None
        return text

    return texts.map(inner)


def unwrapped(document: Column) -> Column:
    """The text of a JSON document that may be encoded twice or more; only such texts go through Python."""
    quoted = F.startswith(F.ltrim(document), F.lit('"'))
    return F.when(quoted, _innermost(F.when(quoted, document))).otherwise(document)


@F.pandas_udf(T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("size", T.LongType())]))
def json_measures(texts: pd.Series) -> pd.DataFrame:
    """Depth and approximate size of a JSON text; null if it cannot be read."""

    def measure(text: str | None) -> tuple:
        try:
            value = loaded(text)
        except (TypeError, ValueError):
            return None, None
        return json_depth(value), json_size(value)

    both = texts.map(measure)
    return pd.DataFrame({"depth": both.str[0].astype("Int32"), "size": both.str[1].astype("Int64")})


def input_error_of(value, most_bytes: int = MAX_INPUT_BYTES, most_depth: int = MAX_INPUT_DEPTH) -> str | None:
    """The limit that a run's input breaks, size before depth."""
    if json_size(value) > most_bytes:
        return "too_large"
    return "too_deep" if json_depth(value) > most_depth else None


def input_errors(most_bytes: int = MAX_INPUT_BYTES, most_depth: int = MAX_INPUT_DEPTH):
    """A function of columns: input_error_of the input of each run's document, whose outer encodings are removed; unreadable
    documents and missing inputs break no limit."""

    @F.pandas_udf(T.StringType())
    def errors(documents: pd.Series) -> pd.Series:
        def error(text: str | None) -> str | None:
            value = read_document(text)
            return input_error_of(value.get("input"), most_bytes, most_depth) if isinstance(value, dict) else None

        return documents.map(error)

    return errors


def log_line(kind: Column, task: Column, message: Column, attempts: Column) -> Column:
    code = F.when(kind == "transient_failure", "transient").otherwise(kind)
    prefix = F.concat(F.lit("["), code, F.lit("] "))
    middle = F.when(task.isNotNull(), F.concat(task, F.lit(": "))).otherwise("")
    return F.concat(prefix, middle, message, F.lit(" (attempt "), attempts.cast("string"), F.lit(")"))
