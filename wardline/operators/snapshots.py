"""Snapshot relations: differences, statistics, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import dims
from wardline.functions.scalars import connection_key, listen_key, looks_outbound


def diff(before: DataFrame, now: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Rows added, removed or changed in ``state``: the keys, change, old and new state."""
    a = before.select(*keys, F.col(state).alias("old_state"), F.lit(True).alias("was"))
    b = now.select(*keys, F.col(state).alias("new_state"), F.lit(True).alias("is_"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_").isNull(), "removed").when(~F.col("old_state").eqNullSafe(F.col("new_state")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", "old_state", "new_state")


def transitions(rows: DataFrame, entity: str, ts: str, state: str) -> DataFrame:
    """Rows whose state differs from the entity's row before; the first is none."""
    w = Window.partitionBy(entity).orderBy(ts)
    return rows.withColumn("from_state", F.lag(state).over(w)).where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))


def top(rows: DataFrame, name: Column, n: int = 8) -> DataFrame:
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name").limit(n)


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of each column, from one pass."""
    exploded = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x"))
    return exploded.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def accepted(observations: DataFrame, listeners: DataFrame) -> DataFrame:
    """Theta semi join: same protocol and port, an empty, wildcard or equal address, and an equal or system pid."""
    o, l = observations.alias("o"), listeners.alias("l")
    address = F.col("l.addr").isin("", "0.0.0.0", "::") | (F.col("l.addr") == F.col("o.local_addr"))
    pid = (F.col("l.pid") == F.col("o.pid")) | F.col("l.pid").isin(0, 4) | F.col("o.pid").isin(0, 4)
    return o.join(l, (F.col("l.proto") == F.col("o.proto")) & (F.col("l.port") == F.col("o.local_port")) & address & pid, "left_semi")


def with_names(sockets: DataFrame, processes: DataFrame) -> DataFrame:
    """Process names by pid: constants for 0 and 4, the name, the path's last part, or a placeholder."""
    from wardline.functions.scalars import base_name

    p = processes.select("pid", F.col("name").alias("_name"), F.col("path").alias("_path"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.when(F.col("pid") == 0, "System Idle").when(F.col("pid") == 4, "System").otherwise(F.coalesce(blank("_name"), F.nullif(base_name(F.col("_path")), F.lit("")), F.concat(F.lit("pid "), F.col("pid").cast("string"))))
    return sockets.join(p, "pid", "left").withColumn("process_name", name).withColumn("process_path", F.coalesce("_path", F.lit(""))).drop("_name", "_path")


TCP = ("TCP", "TCP6")


def table_observations(added: DataFrame, listeners: DataFrame, clients: list[str] | None = None) -> DataFrame:
    """New sockets (proto, state, local_addr, local_port, remote_addr, remote_port, pid, process_name) that are inbound attempts: TCP with
    a remote end, not of a client program, and either still shaking hands, or not outbound by its ports and accepted by a listener."""
    names = [x.strip().lower() for x in [*dims.CLIENT_PROCESSES, *(clients or [])] if x.strip()]
    own = added.where(F.col("proto").isin(*TCP) & (F.col("state") != "LISTEN") & (F.coalesce("remote_addr", F.lit("")) != "") & (F.coalesce("remote_port", F.lit(0)) != 0))
    own = own.where(~F.lower(F.coalesce("process_name", F.lit(""))).isin(names))
    settled = own.where((F.col("state") != "SYN_RECEIVED") & ~looks_outbound(F.col("local_port"), F.col("remote_port")))
    return own.where("state = 'SYN_RECEIVED'").unionByName(accepted(settled, listeners))


def listeners(sockets: DataFrame) -> DataFrame:
    """Listening sockets by protocol and port, with each one's address and pid, in order."""
    own = sockets.where("state = 'LISTEN'").select(listen_key(F.col("proto"), F.col("local_port")).alias("key"), F.struct(F.col("local_addr").alias("addr"), "pid").alias("l"))
    return own.groupBy("key").agg(F.sort_array(F.collect_list("l")).alias("listeners"))


def socket_stats(sockets: DataFrame, most: int = 8) -> DataFrame:
    """(kind, name, n): the total, sockets by protocol, by state (without `-`), the busiest processes and remote addresses. One pass counts
    them all; a process without a name is `pid N`, remote addresses count when established and not local."""
    name = F.coalesce(F.nullif("process_name", F.lit("")), F.concat(F.lit("pid "), F.col("pid").cast("string")))
    remote = F.when((F.col("state") == "ESTABLISHED") & (F.coalesce("remote_addr", F.lit("")) != "") & ~F.col("remote_addr").isin("127.0.0.1", "::1", "0.0.0.0", "::"), F.col("remote_addr"))
    kinds = {"total": F.lit(""), "proto": F.col("proto"), "state": F.nullif("state", F.lit("-")), "process": name, "remote": remote}
    each = sockets.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in kinds.items()))).alias("x"))
    counts = each.where("x.name is not null").groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    tops = [counts.where(F.col("kind") == k).orderBy(F.desc("n"), "name").limit(most) for k in ("process", "remote")]
    return counts.where(~F.col("kind").isin("process", "remote")).union(tops[0]).union(tops[1])


def socket_order(sockets: DataFrame, limit: int | None = None) -> DataFrame:
    """Sockets by protocol, local port and key."""
    key = connection_key("proto", "local_addr", "local_port", "remote_addr", "remote_port", "pid")
    out = sockets.withColumn("key", key).orderBy("proto", "local_port", "key")
    return out if limit is None else out.limit(limit)


def sockets_of(processes: DataFrame, sockets: DataFrame) -> DataFrame:
    """Processes with the number of their sockets."""
    return processes.join(sockets.groupBy("pid").agg(F.count("*").alias("sockets")), "pid", "left").na.fill(0, ["sockets"])


def services_of(processes: DataFrame, services: DataFrame) -> DataFrame:
    """Processes with the sorted names of the running services that they host."""
    own = services.where("pid != 0 and state = 'running'").groupBy("pid").agg(F.sort_array(F.collect_list("name")).alias("services"))
    return processes.join(own, "pid", "left").withColumn("services", F.coalesce("services", F.array().cast("array<string>")))


def service_summary(services: DataFrame) -> DataFrame:
    auto, stopped = F.col("start_type").isin("auto", "auto-delayed"), F.col("state") == "stopped"
    failed = auto & stopped & failed_service()
    return services.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "running").alias("running"), F.count_if(stopped).alias("stopped"), F.count_if(F.col("start_type") == "disabled").alias("disabled"), F.count_if(auto & stopped).alias("auto_stopped"), F.count_if(failed).alias("auto_failed"))


def failed_service() -> Column:
    """Whether a service stopped with an exit code; 1077 says that it was never started."""
    return (F.col("state") == "stopped") & ~F.coalesce("exit_code", F.lit(0)).isin(0, 1077)


def interface_totals(interfaces: DataFrame) -> DataFrame:
    own = interfaces.where("up and kind != 'loopback'")
    return own.agg(F.coalesce(F.sum("in_bps"), F.lit(0.0)).alias("in_bps"), F.coalesce(F.sum("out_bps"), F.lit(0.0)).alias("out_bps"))


def interface_rank() -> Column:
    """Down ones after up ones, virtual after physical, loopback last."""
    return F.when(F.col("up"), 0).otherwise(4) + F.when(F.col("physical"), 0).otherwise(1) + F.when(F.col("kind") == "loopback", 8).otherwise(0)


def interface_order(interfaces: DataFrame) -> DataFrame:
    return interfaces.orderBy(interface_rank(), F.desc(F.col("in_bps") + F.col("out_bps")), "name")


def flows(sockets: DataFrame, rates: DataFrame, geo: DataFrame, limit: int = 200) -> DataFrame:
    """The first ``limit`` established sockets to another host, with their rates by key, country by address and likely direction."""
    own = sockets.where("state = 'ESTABLISHED' and coalesce(remote_addr, '') != '' and coalesce(remote_port, 0) != 0").where(~F.col("remote_addr").rlike(r"^127\.|^::1$"))
    own = socket_order(own, limit)
    direction = F.when((F.col("local_port") < 1024) & (F.col("remote_port") >= 1024), "inbound/likely").otherwise("outbound/unknown")
    return own.join(rates, "key", "left").join(geo.select(F.col("ip").alias("remote_addr"), "country"), "remote_addr", "left").withColumn("direction", direction)


def process_feed(processes: DataFrame) -> DataFrame:
    """Of each image, by lower-case name, the highest cpu, memory and threads, and the pid of the highest cpu; of equals the one with less
    memory, then the higher pid. Processes that deny access and pid 0 are left out."""
    own = processes.where("access and pid != 0").withColumn("image", F.lower("name"))
    return own.groupBy("image").agg(F.max("cpu").alias("cpu"), F.max(F.col("working_set") / (1 << 20)).alias("memory_mb"), F.max("threads").alias("threads"), F.max_by("pid", F.struct("cpu", -F.col("working_set"), "pid")).alias("pid"))


def process_order(processes: DataFrame) -> DataFrame:
    return processes.orderBy(F.desc("cpu"), F.desc("working_set"), "pid")


def heaviest(processes: DataFrame, memory_total: Column, n: int = 10) -> DataFrame:
    """The processes with the highest sum of cpu and memory shares."""
    weight = F.col("cpu") / 100 + F.col("working_set") / F.greatest(F.lit(1), memory_total)
    return processes.where("access").withColumn("weight", weight).orderBy(F.desc("weight"), "pid").limit(n)


def changes(before: DataFrame, now: DataFrame, keys: list[str], state: str) -> DataFrame:
    """What a client that holds ``before`` needs to hold ``now``: a JSON envelope per difference, in order of the keys."""
    own = diff(before, now, keys, state)
    return own.select(*keys, F.to_json(F.struct(F.col("change").alias("type"), F.struct(*keys, F.col("new_state").alias("state")).alias("data"))).alias("message"))
