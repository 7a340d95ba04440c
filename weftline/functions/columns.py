"""Column helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode's White_Space property (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def packed_key(*columns: Column) -> Column:
    """One text for several columns, equal exactly when all are equal; null if one is null."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts += [F.length(text).cast("string"), F.lit(":"), text]
    return F.concat(*parts)
