"""Counters and bounded series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalars import micros


def rates(rows: DataFrame, entity: list[str], ts: str, counters: list[str], reset: str = "zero") -> DataFrame:
    """``<counter>_rate`` per second since the entity's row before. On a counter that went back: `zero` or `null`. The first row has 0 or null likewise."""
    w = Window.partitionBy(*entity).orderBy(ts)
    seconds = (micros(ts) - micros(F.lag(ts).over(w))) / 1e6
    other = F.lit(0.0) if reset == "zero" else F.lit(None).cast("double")
    out = rows.withColumn("_s", seconds)
    for c in counters:
        delta = F.col(c) - F.lag(c).over(w)
        out = out.withColumn(f"{c}_rate", F.when((delta >= 0) & (F.col("_s") > 0), delta / F.col("_s")).otherwise(other))
    return out.drop("_s")


def last_n(rows: DataFrame, entity: str, ts: str, n: int) -> DataFrame:
    """Ring retention."""
    w = Window.partitionBy(entity).orderBy(F.desc(ts))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def moving_average(rows: DataFrame, entity: str, ts: str, value: str, n: int = 60) -> DataFrame:
    return rows.withColumn("avg", F.avg(value).over(Window.partitionBy(entity).orderBy(ts).rowsBetween(1 - n, 0)))


def growth(rows: DataFrame, entity: str, ts: str, value: str, n: int = 60, least: int = 10) -> DataFrame:
    """Change per minute over the last ``n`` samples of each entity that has ``least``."""
    kept = last_n(rows, entity, ts, n)
    at = micros(ts)
    g = kept.groupBy(entity).agg(F.count("*").alias("samples"), F.min_by(value, ts).alias("a"), F.max_by(value, ts).alias("b"), F.min(at).alias("s"), F.max(at).alias("e"))
    return g.where((F.col("samples") >= least) & (F.col("e") > F.col("s"))).select(entity, "samples", ((F.col("b") - F.col("a")) / (F.col("e") - F.col("s")) * 60e6).alias("per_minute"))


def new_per_second(polls: DataFrame, ts: str, added: str, seconds: int = 10, host: str = "host") -> DataFrame:
    """New rows a second over each host's polls of the last ``seconds``, those of the first poll left out."""
    w = Window.partitionBy(host).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    span = (micros(ts) - F.min(micros(ts)).over(w)) / 1e6
    return polls.withColumn("per_second", F.when(span > 0, (F.sum(added).over(w) - F.first(added).over(w)) / span).otherwise(0.0))


def sustained(rows: DataFrame, entity: str, ts: str, value: str, n: int = 60, floor: float = 0.05, hot: float = 25.0, top: int = 10) -> DataFrame:
    """The entities with the highest mean of their last ``n`` samples, of at least ``floor``, and whether they are hot."""
    mean = last_n(rows, entity, ts, n).groupBy(entity).agg(F.avg(value).alias("mean"))
    return mean.where(F.col("mean") >= floor).withColumn("hot", F.col("mean") >= hot).orderBy(F.desc("mean"), entity).limit(top)


def growing(rows: DataFrame, entity: str, ts: str, value: str, n: int = 60, floor: float = 1 << 20, hot: float = 64 << 20, top: int = 10) -> DataFrame:
    """The entities that grow fastest a minute, by more than ``floor``, and whether they are hot."""
    return growth(rows, entity, ts, value, n).where(F.col("per_minute") > floor).withColumn("hot", F.col("per_minute") > hot).orderBy(F.desc("per_minute"), entity).limit(top)


def max_burst(rows: DataFrame, group: list[str], ts: str, seconds: int) -> DataFrame:
    """The most rows of a group within ``seconds``, both ends included."""
    w = Window.partitionBy(*group).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("_k", F.count("*").over(w)).groupBy(*group).agg(F.max("_k").alias("burst"), F.count("*").alias("n"))


def sessions(rows: DataFrame, group: list[str], ts: str, gap_seconds: int, order: list[Column] | None = None) -> DataFrame:
    """``session`` from 1: a new one begins where the gap to the row before is more than ``gap_seconds``."""
    w = Window.partitionBy(*group).orderBy(ts, *(order or []))
    far = micros(ts) - micros(F.lag(ts).over(w)) > gap_seconds * 1_000_000
    return rows.withColumn("session", F.sum(F.when(far, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
