"""Port-sweep detection over observations (ip, port, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalars import micros, valid_ip
from wardline.operators.rates import sessions


#: Windows that a slice of an address's observations spans.
SLICE = 64


def hits(observations: DataFrame, window_seconds: int = 5, threshold: int = 10) -> DataFrame:
    """Observations with the distinct ports of their address in the window that ends with them, and its running peak. An address is cut
    into slices of time that overlap by a window, so that one that scans all the time fills no task."""
    window, span = window_seconds * 1_000_000, SLICE * window_seconds * 1_000_000
    own = F.floor(micros("ts") / span)
    spill = F.when((own + 1) * span - micros("ts") <= window, F.array(own, own + 1)).otherwise(F.array(own))
    rows = observations.withColumn("_own", own).withColumn("_slice", F.explode(spill))
    by = Window.partitionBy("ip", "_slice").orderBy(micros("ts"))
    rows = rows.withColumn("in_window", F.size(F.collect_set("port").over(by.rangeBetween(-window, 0)))).where("_slice = _own")
    most = rows.groupBy("ip", "_slice").agg(F.max("in_window").alias("_most"))
    before = F.max("_most").over(Window.partitionBy("ip").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    peak = F.max("in_window").over(by.rangeBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_peak", peak).join(most.select("ip", "_slice", before.alias("_before")), ["ip", "_slice"])
    return out.withColumn("trigger", F.col("in_window") > threshold).withColumn("peak", F.greatest("_peak", F.coalesce("_before", F.lit(0)))).drop("_own", "_slice", "_peak", "_before")


def incidents(observations: DataFrame, window_seconds: int = 5, threshold: int = 10, cooldown_seconds: int = 60) -> DataFrame:
    """One row per incident: a session of observations with gaps of the cooldown at most opens one at its first trigger, seeded with the window before it."""
    if window_seconds >= cooldown_seconds:
        raise ValueError("the window must be shorter than the cooldown")
    own = sessions(hits(observations, window_seconds, threshold), ["ip"], "ts", cooldown_seconds)
    opened = F.min(F.when(F.col("trigger"), micros("ts"))).over(Window.partitionBy("ip", "session"))
    inside = own.withColumn("opened", opened).where(micros("ts") >= F.col("opened") - window_seconds * 1_000_000)
    late = micros("ts") >= F.col("opened")
    return inside.groupBy("ip", "session").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("attempts"), F.countDistinct("port").alias("ports"), F.max(F.when(late, F.col("in_window"))).alias("peak"), F.sort_array(F.collect_set("port")).alias("port_list")
    )


def port_text(ports: Column, most: int = 12) -> Column:
    """Sorted distinct ports as text: `21-23, 80, 443 (+N more)`."""
    start = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc, p):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), p.alias("b"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] == p - 1), joined).otherwise(F.concat(acc, F.array(F.struct(p.alias("a"), p.alias("b")))))

    groups = F.aggregate(ports.cast("array<int>"), start, step)
    text = F.transform(F.slice(groups, 1, most), lambda g: F.when(g["a"] == g["b"], g["a"].cast("string")).otherwise(F.concat_ws("-", g["a"].cast("string"), g["b"].cast("string"))))
    over = F.size(groups) - most
    return F.concat(F.array_join(text, ", "), F.when(over > 0, F.concat(F.lit(" (+"), over.cast("string"), F.lit(" more)"))).otherwise(""))


def host_stats(observations: DataFrame, now: Column, window_seconds: int = 5, minute_seconds: int = 60) -> DataFrame:
    age = micros(now) - micros("ts")
    near, minute = age <= window_seconds * 1_000_000, age <= minute_seconds * 1_000_000
    return observations.groupBy("ip").agg(
        F.count_if(near).alias("conns_window"), F.countDistinct(F.when(near, F.col("port"))).alias("ports_window"), F.count_if(minute).alias("conns60"), (F.count_if(minute) / minute_seconds).alias("rate"), F.count("*").alias("total"), F.countDistinct("port").alias("ports"), F.max("ts").alias("last_seen")
    )


def histogram(observations: DataFrame, bucket: str = "1 second") -> DataFrame:
    return observations.groupBy(F.window("ts", bucket)["start"].alias("bucket")).agg(F.count("*").alias("n"))


def not_allowed(observations: DataFrame, allow: DataFrame) -> DataFrame:
    """Without the addresses of the allow-list."""
    return observations.join(allow.select("ip"), "ip", "left_anti")


def port_ranges(observations: DataFrame, most: int = 12) -> DataFrame:
    """(ip, text): the ports of each address as ranges, by islands of consecutive numbers."""
    ports = observations.select("ip", "port").distinct()
    by = Window.partitionBy("ip").orderBy("port")
    islands = ports.withColumn("_i", F.col("port") - F.row_number().over(by)).groupBy("ip", "_i").agg(F.min("port").alias("a"), F.max("port").alias("b"))
    places = islands.withColumn("k", F.row_number().over(Window.partitionBy("ip").orderBy("a")))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    few = F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.struct("k", text.alias("t")))))
    out = places.groupBy("ip").agg(F.array_join(F.transform(few, lambda x: x["t"]), ", ").alias("text"), (F.max("k") - most).alias("over"))
    return out.select("ip", F.concat("text", F.when(F.col("over") > 0, F.concat(F.lit(" (+"), F.col("over").cast("string"), F.lit(" more)"))).otherwise("")).alias("text"))


def host_order(stats: DataFrame, limit: int = 100) -> DataFrame:
    """Hosts with an open incident first, then by ports in the window, connections of the minute and last time."""
    return stats.orderBy(F.desc("flagged"), F.desc("ports_window"), F.desc("conns60"), F.desc("last_seen"), "ip").limit(limit)


def active(incidents: DataFrame, now: Column, cooldown_seconds: int = 60) -> DataFrame:
    """Incidents with whether they are open at ``now``: not longer than the cooldown after their last observation."""
    return incidents.withColumn("active", micros(now) - micros("last_seen") <= cooldown_seconds * 1_000_000)


def series(observations: DataFrame, now: Column, buckets: int = 60, seconds: int = 1) -> DataFrame:
    """Observations in each of the last ``buckets`` spans of ``seconds`` until ``now``, empty ones included, the oldest 0."""
    width = seconds * 1_000_000
    place = F.floor(micros("ts") / width) - F.floor(micros(now) / width) + buckets - 1
    counts = observations.withColumn("_i", place.cast("long")).where(f"_i >= 0 and _i < {buckets}").groupBy(F.col("_i").alias("bucket")).agg(F.count("*").alias("n"))
    return observations.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)


def decoy_ports(observations: DataFrame, seconds: int = 60) -> DataFrame:
    """Each observation with the sorted distinct ports that its address has touched in the ``seconds`` that end with it."""
    by = Window.partitionBy("ip").orderBy(micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return observations.withColumn("touched", F.sort_array(F.collect_set("port").over(by)))


def blocked(events: DataFrame, own: list[str]) -> DataFrame:
    """Inbound attempts from audited denies (5157): TCP, inbound, with just one end among the ``own`` addresses, which is the host's."""
    data = lambda k: F.trim(F.coalesce(F.try_element_at(F.col("data"), F.lit(k)), F.lit("")))
    e = events.where((F.col("event_id") == 5157) & (F.col("channel") == "Security") & (F.col("provider") == "Microsoft-Windows-Security-Auditing"))
    e = e.where((data("Protocol") == "6") & F.lower(data("Direction")).isin("%%14592", "inbound"))
    e = e.withColumns({"src": data("SourceAddress"), "dst": data("DestAddress"), "sport": data("SourcePort").try_cast("int"), "dport": data("DestPort").try_cast("int")})
    loop = lambda c: F.col(c).rlike(r"^127\.|^::1$")
    e = e.where(valid_ip(F.col("src")) & valid_ip(F.col("dst")) & ~loop("src") & ~loop("dst")).withColumn("inward", F.col("dst").isin(own)).where(F.col("inward") != F.col("src").isin(own))
    pick = lambda a, b: F.when(F.col("inward"), F.col(a)).otherwise(F.col(b))
    out = e.select(F.col("time").alias("ts"), pick("src", "dst").alias("ip"), F.coalesce(pick("sport", "dport"), F.lit(0)).alias("remote_port"), pick("dst", "src").alias("local_ip"), pick("dport", "sport").alias("port"), F.lit("wfp-5157").alias("sensor"))
    return out.where(F.col("port").between(1, 65535) & ~F.col("ip").rlike(r"^(0\.0\.0\.0$|22[4-9]\.|23[0-9]\.|::$|[fF][fF])"))


def self_test(spark, ports: int, threshold: int = 10, start: Column | None = None) -> DataFrame:
    """Made-up observations of one documentation address on so many ports, 40 ms apart; too few for the threshold become 14 more than it."""
    n = min(1024, threshold + 14 if ports <= threshold else ports)
    begin = start if start is not None else F.current_timestamp()
    return spark.range(n).select(F.lit("198.51.100.77").alias("ip"), (F.col("id") + 1).cast("int").alias("port"), F.timestamp_micros(F.unix_micros(begin) + F.col("id") * 40_000).alias("ts"))
