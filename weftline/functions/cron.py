"""Cron schedules of five fields in UTC: parsing on the driver, matching as columns, next ticks per row.

A day must satisfy the day of month and the day of week. Sunday is 0. Ranges take no step, names are not known.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields with their least and greatest value (fixed values).
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day_of_month", 1, 31), ("month", 1, 12), ("day_of_week", 0, 6))
HORIZON = timedelta(minutes=2_628_000)
_HORIZON_MS = 2_628_000 * 60_000
#: In so many horizons days of the week and dates, leap days too, come round in all ways.
_HORIZONS = 81


def parse_field(text: str, name: str, low: int, high: int) -> tuple[int, ...]:
    values: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        step, first, last = 1, low, high
        body = part
        if part.startswith("*/"):
            body, step = "*", _number(part[2:], name)
            if step == 0:
                raise ValueError(f"{name}: a step must be greater than 0")
        if body != "*":
            ends = body.split("-")
            first, last = _number(ends[0], name), _number(ends[1] if len(ends) > 1 else ends[0], name)
            for value in (first, last):
                if not low <= value <= high:
                    raise ValueError(f"{name}: {value} is not within {low} and {high}")
            if first > last:
                raise ValueError(f"{name}: {first} exceeds {last}")
        values.update(range(first, last + 1, step))
    return tuple(sorted(values))


def _number(text: str, name: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"{name}: {text!r} is no number")
    return int(text)


@dataclass(frozen=True)
class Schedule:
    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: tuple[int, ...]
    months: tuple[int, ...]
    weekdays: tuple[int, ...]

    @classmethod
    def parse(cls, text: str) -> Schedule:
        parts = text.split()
        if len(parts) != len(FIELDS):
            raise ValueError(f"five fields are needed, {len(parts)} given")
        return cls(*(parse_field(p, *f) for p, f in zip(parts, FIELDS)))

    def matches(self, at: Column) -> Column:
        """Whether a UTC timestamp lies in a minute of the schedule."""
        tests = (
            (F.minute(at), self.minutes), (F.hour(at), self.hours), (F.dayofmonth(at), self.days),
            (F.month(at), self.months), (F.dayofweek(at) - 1, self.weekdays),
        )
        result = F.lit(True)
        for value, allowed in tests:
            result = result & value.isin(*allowed)
        return result

    def next_tick_ms(self, after_ms: int) -> int | None:
        """First matching minute strictly after a time; days are skipped whole, within a five-year horizon."""
        start = datetime.fromtimestamp(after_ms // 60_000 * 60, timezone.utc) + timedelta(minutes=1)
        end, day = start + HORIZON, start
        while day < end:
            if day.month in self.months and day.day in self.days and (day.weekday() + 1) % 7 in self.weekdays:
                for hour in self.hours:
                    if hour < day.hour:
                        continue
                    least = day.minute if hour == day.hour else 0
                    minute = next((m for m in self.minutes if m >= least), None)
                    if minute is not None:
                        tick = day.replace(hour=hour, minute=minute)
                        return int(tick.timestamp()) * 1000 if tick < end else None
            day = (day + timedelta(days=1)).replace(hour=0, minute=0)
        return None


@lru_cache(maxsize=4096)
def _schedule(text: str) -> Schedule | None:
    try:
        return Schedule.parse(text)
    except ValueError:
        return None


@F.pandas_udf(T.LongType())
def next_tick(schedules: pd.Series, after_ms: pd.Series) -> pd.Series:
    """Next tick per row; null for a schedule that cannot be read, never fires, or a null time."""

    minutes = np.floor_divide(after_ms.to_numpy(dtype="float64", na_value=np.nan), 60_000)
    ticks = pd.Series([pd.NA] * len(minutes), dtype="Int64")
    for text, rows in schedules.groupby(schedules).indices.items():
        own = _schedule(text)
        if own is None:
            continue
        rows = rows[~np.isnan(minutes[rows])]
        distinct, place = np.unique(minutes[rows], return_inverse=True)
        # A tick holds for all minutes before it, so of ascending minutes only those at or behind the last one are looked up;
        # it counts for a minute if it lies within that one's horizon.
        found, tick = [], 0
        for minute in distinct.astype("int64").tolist():
            if tick is not None and minute * 60_000 >= tick:
                looks = (own.next_tick_ms(minute * 60_000 + k * _HORIZON_MS) for k in range(_HORIZONS))
                tick = next((t for t in looks if t is not None), None)
            found.append(tick if tick is not None and tick < (minute + 1) * 60_000 + _HORIZON_MS else None)
        ticks.iloc[rows] = pd.array(found, dtype="Int64")[place]
    return ticks
