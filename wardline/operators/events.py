"""Event filters, classification, summaries and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import dims
from wardline.functions.scalars import micros, truncated


def category(provider: Column, event_id: Column, level: Column) -> Column:
    low, out = F.lower(provider), F.lit("other")
    for part, ids, name in reversed(dims.EVENT_RULES):
        fits = low.contains(part) & (event_id.isin(ids) if ids else level.between(1, 3))
        out = F.when(fits, name).otherwise(out)
    return out


def select(events: DataFrame, levels: str = "", since=None, until=None, kind: str = "", text: str = "", limit: int = 1000) -> DataFrame:
    out = events
    if levels:
        out = out.where(F.col("level_str").isin([x.strip().lower() for x in levels.split(",")]))
    if since is not None:
        out = out.where(F.col("time") >= since)
    if until is not None:
        out = out.where(F.col("time") <= until)
    if kind:
        out = out.where(F.col("category") == kind)
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "provider", "message")), F.lit(text.lower())))
    return out.orderBy(F.desc("time"), F.desc("record_id")).limit(min(limit, 10_000))


def summary(events: DataFrame) -> DataFrame:
    """Counts by level and by category without `other`."""
    return events.select(F.explode(F.array(F.struct(F.lit("level").alias("kind"), F.col("level_str").alias("name")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")))).alias("x")).where("x.kind = 'level' or x.name != 'other'").groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def timeline(events: DataFrame, start: Column, end: Column, bins: int = 56) -> DataFrame:
    """Equal-width bins of integer microseconds, empty ones included; ``end`` itself falls in the last."""
    width = F.floor((micros(end) - micros(start)) / bins)
    at = micros("time") - micros(start)
    inside = events.where((F.col("time") >= start) & (F.col("time") <= end)).select(F.least(F.floor(at / width), F.lit(bins - 1)).cast("long").alias("bin"), "level")
    counts = inside.groupBy("bin").agg(*(F.count_if(F.col("level") == k).alias(name) for k, name in ((1, "critical"), (2, "error"), (3, "warning"))), F.count_if(~F.col("level").isin(1, 2, 3)).alias("info"))
    spine = events.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return spine.join(counts, "bin", "left").na.fill(0)


def alert_severity(level: Column, kind: Column) -> Column:
    return F.when(level == 1, "critical").when(level == 2, F.when(kind != "other", "warning").otherwise("info")).when((level == 3) & (kind != "other"), "info")


def top_sources(events: DataFrame, n: int = 10) -> DataFrame:
    """The providers with most events of levels 1 to 3."""
    return events.where("level between 1 and 3").groupBy(F.col("provider").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)


def after(events: DataFrame, channel: str, since: Column | None = None, most: int = 2000, max_level: int = 0, after_record: int = 0) -> DataFrame:
    """A channel's newest events: after a record, since a time, up to a level (0: all). Offsets of a stream take the cursor's place."""
    out = events.where((F.col("channel") == channel) & (F.col("record_id") > after_record))
    if since is not None:
        out = out.where(F.col("time") >= since)
    if max_level:
        out = out.where(F.col("level").between(1, max_level))
    return out.orderBy(F.desc("time"), F.desc("record_id")).limit(most)


def cursors(events: DataFrame) -> DataFrame:
    """The last record of each channel."""
    return events.groupBy("channel").agg(F.max("record_id").alias("after_record"))


def retained(events: DataFrame, each: int) -> DataFrame:
    """The newest ``each`` events of every channel."""
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("time"), F.desc("record_id")))
    return events.withColumn("_k", place).where(F.col("_k") <= each).drop("_k")


def latest_bad(events: DataFrame, n: int = 25) -> DataFrame:
    return events.where("level <= 2").orderBy(F.desc("time"), F.desc("record_id")).limit(n)


def baseline(events: DataFrame) -> DataFrame:
    """What a first load holds: it raises no alerts, only counts."""
    return events.agg(F.count_if(F.col("level") == 1).alias("critical"), F.count_if(F.col("level") == 2).alias("errors"))


def fresh(events: DataFrame, first_load: Column) -> DataFrame:
    """Alerts of events after the first load: severity, category and key; the rest raises none."""
    own = events.where(F.col("time") > first_load).withColumn("severity", alert_severity(F.col("level"), F.col("category"))).where("severity is not null")
    return own.select("record_id", "time", "severity", F.when(F.col("category") == "other", "system").otherwise("reliability").alias("alert_category"), F.concat_ws(":", F.lit("ev"), F.lower("provider"), F.col("event_id").cast("string")).alias("key"), truncated(F.coalesce("message", F.lit("")), 400).alias("detail"))


def xpath(ids: list[int] | None = None, levels: list[int] | None = None, window_ms: int = 0, after_record: int = 0) -> str:
    """The query text for a log that is read by XPath: ids, levels, age and record as conditions of the System element."""
    either = lambda name, values: "(" + " or ".join(f"{name}={v}" for v in values) + ")"
    own = [either(n, v) for n, v in (("EventID", ids), ("Level", levels)) if v]
    own += [f"TimeCreated[timediff(@SystemTime) <= {window_ms}]"] if window_ms > 0 else []
    own += [f"(EventRecordID > {after_record})"] if after_record else []
    return f"*[System[{' and '.join(own)}]]" if own else "*"
