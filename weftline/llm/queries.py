"""Queries of the text operators (p8 to p10) over the project's tables. SQL can express none of them, but it can tell what
the shares of a mix have to be."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.llm import mixing, sentences, tokens
from weftline.session import table


def _mix(spark, d, part):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[part]


def _overlap(spark, d, part):
    """As _mix, where documents that are not in English are members of a source without documents of its own, too."""
    other = F.when(~F.coalesce(F.lower("lang"), F.lit("en")).startswith("en"), "interop-annex")
    listed = table(spark, d, "documents").withColumn("source", F.array("source", other))
    return mixing.mix(listed, table(spark, d, "mix_targets"))[part]


def _met(report):
    """Whether each source has the tokens asked of it but for its longest document, half at either end of a stretch, and
    was asked its weight's share of what all were asked."""
    every = W.partitionBy()  # as many rows as there are targets
    whole, weights = F.sum("asked").over(every), F.sum(F.when(F.col("asked") > 0, F.col("weight"))).over(every)
    near = F.abs(F.col("tokens") - F.col("asked")) <= F.col("longest")
    fair = F.abs(F.col("asked") - whole * F.col("weight") / weights) <= 8
    return report.select("source", "weight", F.coalesce((F.col("asked") > 0) & near & fair, F.lit(False)).alias("met"))


QUERIES = {
    "p8_ids": lambda spark, d: tokens.encode(table(spark, d, "documents")),
    "p9_mix": lambda spark, d: _mix(spark, d, 0),
    "p9_shares": lambda spark, d: _mix(spark, d, 1),
    "p9_met": lambda spark, d: _met(_mix(spark, d, 1)),
    "p9_overlap_met": lambda spark, d: _met(_overlap(spark, d, 1)),
    "p10_found": lambda spark, d: sentences.sentence_units(table(spark, d, "documents")),
}

_HELD = "SELECT 1 FROM documents d WHERE d.text <> '' AND d.source = t.source"
_ABROAD = "SELECT 1 FROM documents d WHERE d.text <> '' AND NOT starts_with(coalesce(lower(d.lang), 'en'), 'en') AND t.source = 'interop-annex'"

SQL: dict[str, str] = {
    "p9_met": f"SELECT source, weight, EXISTS ({_HELD}) AS met FROM mix_targets t",
    "p9_overlap_met": f"SELECT source, weight, EXISTS ({_HELD}) OR EXISTS ({_ABROAD}) AS met FROM mix_targets t",
}
