"""Itemised health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import grade, rounded1

# Factor, start, weight and cap of each penalty.
FACTORS = [("cpu", 70, 0.6, 18), ("mem", 75, 0.8, 20), ("commit", 80, 0.8, 15), ("disk", 85, 1.5, 20), ("critical", 0, 8, 24), ("warning", 0, 1.5, 9), ("sweeps", 0, 15, 30), ("services", 0, 3, 12)]


def penalty(value: Column, start: float, weight: float, cap: float) -> Column:
    p = rounded1(F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), (value.cast("double") - start) * weight)))
    return F.when(p > 0.05, p).otherwise(0.0)


def score(inputs: DataFrame) -> DataFrame:
    """``inputs`` (a column per factor) with penalties, score and grade."""
    out = inputs
    for name, start, weight, cap in FACTORS:
        out = out.withColumn(f"{name}_penalty", F.coalesce(penalty(F.col(name), start, weight, cap), F.lit(0.0)))
    total = sum((F.col(f"{n}_penalty") for n, *_ in FACTORS), F.lit(0.0))
    return out.withColumn("score", rounded1(F.greatest(F.lit(0.0), F.lit(100.0) - total))).withColumn("grade", grade(F.col("score")))
