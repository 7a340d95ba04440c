"""Task handlers: a registry of functions (input JSON, task, attempt) -> (output JSON, error kind, message).

Handlers that run processes or call networks are not part of the engine; their outcomes can be classified.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.scalars import valid_webhook_url

Result = tuple[str | None, str | None, str | None]
OUTCOME = "struct<output: string, kind: string, message: string>"


class Registry:
    def __init__(self):
        self._handlers: dict[str, Callable[[str | None, str, int], Result]] = {}

    def register(self, name: str, handler: Callable[[str | None, str, int], Result]) -> None:
        self._handlers[name] = handler

    def names(self) -> list[str]:
        return sorted(self._handlers)

    def column(self, handler: Column, input_: Column, task: Column, attempt: Column) -> Column:
        """Outcome of each row's handler, in Arrow batches; an unknown handler is a permanent failure."""
        own = dict(self._handlers)

        @F.pandas_udf(OUTCOME)
        def run(h: pd.Series, i: pd.Series, t: pd.Series, a: pd.Series) -> pd.DataFrame:
            rows = [
                own[n](x, y, int(z)) if n in own else (None, "permanent", f"unknown handler {n} for {y}") for n, x, y, z in zip(h, i, t, a)
            ]
            return pd.DataFrame(rows, columns=["output", "kind", "message"])

        return run(handler, input_, task, attempt)


def with_builtins() -> Registry:
    registry = Registry()
    registry.register("noop", lambda i, t, a: ('{"ok":true}', None, None))
    registry.register("echo", lambda i, t, a: (json.dumps({"echo": json.loads(i or "null"), "task": t}), None, None))
    registry.register("fail", lambda i, t, a: (None, "rejected", "always fails"))
    registry.register("delay", lambda i, t, a: ('{"slept_ms":50}', None, None))
    return registry


def http_outcome(status: Column) -> Column:
    return F.when(status >= 500, "transient_failure").when(status >= 400, "permanent").otherwise("ok")


def process_outcome(exit_code: Column) -> Column:
    return F.when(exit_code == 0, "ok").otherwise("rejected")


def webhook_outcome(url: Column, status: Column) -> Column:
    """What came of a delivery: sent with a status from 200 to 399, refused otherwise; a URL that is none is not tried."""
    return F.when(~valid_webhook_url(url), "invalid_url").when((status >= 200) & (status < 400), "sent").otherwise("refused")
