"""Comparison of two sets of windows, aligned by position.

Defined results: windows without a partner are left out of the deltas; texts without a common window have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned(a: DataFrame, b: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """by, and |a - b| of each value, of the windows of the same position."""
    left = a.select(*by, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(*by, *[F.col(v).alias(f"{v}_b") for v in values])
    return left.join(right, by).select(*by, *[F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")).alias(v) for v in values])


def delta(a: DataFrame, b: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean absolute difference of each value over the aligned windows."""
    return aligned(a, b, by, values).agg(F.count("*").alias("windows"), *[F.round(F.avg(v) + 1e-9, 6).alias(v) for v in values])


def position_scores(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, score = 1 - distance of the relative middles (start, end, length of the text), at least 0."""
    left = a.select(*by, ((F.col("start_char") + F.col("end_char")) / 2 / F.col("length")).alias("ma"))
    right = b.select(*by, ((F.col("start_char") + F.col("end_char")) / 2 / F.col("length")).alias("mb"))
    return left.join(right, by).select(*by, F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("ma") - F.col("mb"))) + 1e-9, 6).alias("score"))


def burrows(rates: DataFrame, key: str, value: str = "rate", word: str = "word") -> DataFrame:
    """key, delta: mean absolute z-score of a text's function-word rates, that is Burrows' Delta to the average text."""
    s = rates.groupBy(word).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"))
    z = rates.join(s, word).filter("sd > 0").withColumn("z", F.abs((F.col(value) - F.col("mu")) / F.col("sd")))
    return z.groupBy(key).agg(F.round(F.avg("z") + 1e-9, 6).alias("delta"))


def event_counts(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, events_a, events_b, difference (b - a): events of two sides, 0 where one has none."""
    left, right = (x.groupBy(*by).agg(F.count("*").alias(name)) for x, name in ((a, "events_a"), (b, "events_b")))
    out = left.join(right, by, "full").na.fill(0, ["events_a", "events_b"])
    return out.withColumn("difference", F.col("events_b") - F.col("events_a"))
