"""Driver queries: the operators on the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import dims
from wardline.functions import scalars as X
from wardline.operators import alerts, audit, events, health, inventory, radar, rates, snapshots, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = 86_400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: ip <- user, port <- k."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("ip"), F.get_json_object("props", "$.k").cast("int").alias("port"), "ts", "event_type", "value")


OBS = """o AS (SELECT event_id AS id, user_id AS ip, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS port, ts, event_type, value FROM events)"""
LEVEL = "CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


def leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    return e.select(F.col("event_id").alias("record_id"), F.col("user_id"), F.col("ts").alias("time"), level.alias("level"), F.col("event_type").alias("provider"), F.col("props").alias("message"), "value")


@query(f"""WITH {OBS} SELECT id, ip, port, n AS in_window FROM (SELECT *, count(DISTINCT port) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM o WHERE ip % 10 <> 3) WHERE n > 6""")
def sweep_hits(spark, sf_dir):
    o = observations(spark, sf_dir)
    allow = o.where("ip % 10 = 3").select("ip").distinct()
    return radar.hits(radar.not_allowed(o, allow), DAY, 6).where("trigger").select("id", "ip", "port", F.col("in_window").cast("long").alias("in_window"))


@query(f"""WITH {OBS}, w AS (SELECT *, count(DISTINCT port) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n,
 CASE WHEN ts - lag(ts) OVER (PARTITION BY ip ORDER BY ts) > INTERVAL 2 DAY THEN 1 ELSE 0 END AS far FROM o),
s AS (SELECT *, sum(far) OVER (PARTITION BY ip ORDER BY ts) AS session FROM w),
t AS (SELECT *, min(CASE WHEN n > 6 THEN ts END) OVER (PARTITION BY ip, session) AS opened FROM s)
SELECT ip, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS attempts, count(DISTINCT port) AS ports, max(CASE WHEN ts >= opened THEN n END) AS peak FROM t WHERE ts >= opened - INTERVAL 1 DAY GROUP BY ip, session""")
def sweep_incidents(spark, sf_dir):
    found = radar.incidents(observations(spark, sf_dir), DAY, 6, 2 * DAY)
    return found.select("ip", "first_seen", "last_seen", "attempts", "ports", F.col("peak").cast("long").alias("peak"))


@query(f"""WITH {OBS}, p AS (SELECT DISTINCT ip, port FROM o), g AS (SELECT ip, port, port - row_number() OVER (PARTITION BY ip ORDER BY port) AS island FROM p),
r AS (SELECT ip, min(port) AS a, max(port) AS b, row_number() OVER (PARTITION BY ip ORDER BY min(port)) AS k FROM g GROUP BY ip, island)
SELECT ip, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) FILTER (WHERE k <= 12) || CASE WHEN max(k) > 12 THEN ' (+' || (max(k) - 12) || ' more)' ELSE '' END AS text FROM r GROUP BY ip""")
def port_ranges(spark, sf_dir):
    return radar.port_ranges(observations(spark, sf_dir))


@query("SELECT user_id, event_type, max(k) AS burst, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS k FROM events) GROUP BY user_id, event_type")
def burst_peak(spark, sf_dir):
    return rates.max_burst(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 3 * DAY)


@query("""WITH s AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY ts) + 1 AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 1 DAY THEN 1 ELSE 0 END AS far FROM events))
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""")
def session_dedupe(spark, sf_dir):
    own = rates.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", DAY)
    return own.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {OBS}, n AS (SELECT max(ts) AS now FROM events) SELECT ip, count(*) FILTER (WHERE ts >= now - INTERVAL 1 DAY) AS conns_window, count(DISTINCT port) FILTER (WHERE ts >= now - INTERVAL 1 DAY) AS ports_window, count(*) FILTER (WHERE ts >= now - INTERVAL 7 DAY) AS conns60, round(count(*) FILTER (WHERE ts >= now - INTERVAL 7 DAY) / 604800.0, 9) AS rate, count(*) AS total, count(DISTINCT port) AS ports, max(ts) AS last_seen FROM o, n GROUP BY ip""")
def host_stats(spark, sf_dir):
    o = observations(spark, sf_dir)
    now = o.agg(F.max("ts")).first()[0]
    return radar.host_stats(o, F.lit(now), DAY, 7 * DAY).withColumn("rate", F.round("rate", 9))


@query("SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
def obs_histogram(spark, sf_dir):
    return radar.histogram(observations(spark, sf_dir), "1 hour")


@query(f"""WITH b AS (SELECT min(ts) AS a, max(ts) AS z, (epoch_us(max(ts)) - epoch_us(min(ts))) // 56 AS w FROM events), e AS (SELECT least((epoch_us(ts) - epoch_us(a)) // w, 55) AS bin, {LEVEL} AS level FROM events, b)
SELECT s.bin, count(*) FILTER (WHERE level = 1) AS critical, count(*) FILTER (WHERE level = 2) AS error, count(*) FILTER (WHERE level = 3) AS warning, count(*) FILTER (WHERE level = 4) AS info FROM (SELECT unnest(range(56)) AS bin) s LEFT JOIN e ON e.bin = s.bin GROUP BY s.bin""")
def event_timeline(spark, sf_dir):
    e = leveled(spark, sf_dir)
    a, z = e.agg(F.min("time"), F.max("time")).first()
    return events.timeline(e, F.lit(a), F.lit(z))


@query(f"""WITH e AS (SELECT CASE {LEVEL} WHEN 2 THEN 'error' WHEN 3 THEN 'warning' ELSE 'info' END AS level_str, CASE WHEN event_type IN ('click', 'error') THEN event_type ELSE 'other' END AS category FROM events)
SELECT 'level' AS kind, level_str AS name, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM e WHERE category <> 'other' GROUP BY 2""")
def event_summary(spark, sf_dir):
    e = leveled(spark, sf_dir)
    kind = F.when(F.col("provider").isin("click", "error"), F.col("provider")).otherwise("other")
    return events.summary(e.withColumn("level_str", X.level_name(F.col("level"))).withColumn("category", kind))


@query("SELECT CAST(user_id AS VARCHAR) AS name, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_sources(spark, sf_dir):
    return snapshots.top(table(spark, sf_dir, "events"), F.col("user_id").cast("string"))


@query(f"SELECT event_id AS record_id, ts AS time, event_type AS provider FROM events WHERE {LEVEL} IN (2, 3) AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND contains(lower(event_type || ' ' || props), '7') ORDER BY ts DESC, event_id DESC LIMIT 1000")
def event_filter(spark, sf_dir):
    e = leveled(spark, sf_dir).withColumn("level_str", X.level_name(F.col("level")))
    return events.select(e, "Error,warning", F.expr("timestamp '2024-01-05'"), F.expr("timestamp '2024-01-20'"), text="7").select("record_id", "time", "provider")


def as_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), F.col("ts").alias("time"), severity.alias("severity"), F.col("props").alias("detail"), F.col("ts").alias("updated"))


@query("""WITH s AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS far FROM events))
SELECT CAST(user_id AS VARCHAR) AS key, CAST(session AS BIGINT) AS session, min(ts) AS time, max(ts) AS updated, count(*) AS count, CASE min(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, arg_max(props, ts) AS detail FROM s GROUP BY user_id, session""")
def alert_fold(spark, sf_dir):
    found = alerts.fold(as_alerts(spark, sf_dir), 12 * 3600)
    return found.select("key", F.col("session").cast("long").alias("session"), "time", "updated", "count", "severity", "detail")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS critical, count(*) FILTER (WHERE event_type = 'purchase') AS warning, count(*) FILTER (WHERE event_type NOT IN ('error', 'purchase')) AS info, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS last24h FROM events")
def alert_counts(spark, sf_dir):
    return alerts.counts(as_alerts(spark, sf_dir)).drop("unacked")


CUM = "c AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts), 2) AS total FROM events)"


def cumulative(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.round(F.sum("value").over(w), 2).alias("total"))


@query(f"WITH {CUM} SELECT event_id, user_id, coalesce(round(greatest(0, (total - lag(total) OVER w) / ((us - lag(us) OVER w) / 1e6)), 6), 0) AS rate FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def counter_rates(spark, sf_dir):
    return rates.rates(cumulative(spark, sf_dir), ["user_id"], "ts", ["total"]).select("event_id", "user_id", F.round("total_rate", 6).alias("rate"))


@query(f"""WITH {CUM}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM c)
SELECT user_id, count(*) AS samples, round((arg_max(total, ts) - arg_min(total, ts)) / (max(us) - min(us)) * 60e6, 5) AS per_minute FROM r WHERE rn <= 60 GROUP BY user_id HAVING count(*) >= 10""")
def growth_per_min(spark, sf_dir):
    return rates.growth(cumulative(spark, sf_dir), "user_id", "ts", "total").withColumn("per_minute", F.round("per_minute", 5))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 7) AS avg FROM events")
def moving_avg(spark, sf_dir):
    return rates.moving_average(table(spark, sf_dir, "events"), "user_id", "ts", "value").select("event_id", F.round("avg", 7).alias("avg"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 5")
def ring_last_n(spark, sf_dir):
    return rates.last_n(table(spark, sf_dir, "events"), "user_id", "ts", 5).select("event_id", "user_id")


@query("""WITH a AS (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change, a.s AS old_state, b.s AS new_state FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.s <> b.s""")
def snapshot_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("s"))
    return snapshots.diff(part(0), part(1), ["o_custkey"], "s")


@query("SELECT o_orderkey, o_custkey, p AS from_state, o_orderstatus AS to_state FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p IS NOT NULL AND p <> o_orderstatus")
def state_transitions(spark, sf_dir):
    return snapshots.transitions(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus").select("o_orderkey", "o_custkey", "from_state", F.col("o_orderstatus").alias("to_state"))


@query(f"""WITH {OBS}, x AS (SELECT id, event_type AS proto, port AS local_port, CAST(ip % 7 AS VARCHAR) AS local_addr, ip % 9 AS pid FROM o), l AS (SELECT DISTINCT event_type AS proto, port, CASE ip % 30 WHEN 0 THEN '' WHEN 3 THEN '0.0.0.0' WHEN 6 THEN '*' ELSE CAST(ip % 7 AS VARCHAR) END AS addr, ip % 9 AS pid FROM o WHERE event_type = 'error')
SELECT id FROM x WHERE EXISTS (SELECT 1 FROM l WHERE l.proto = x.proto AND l.port = x.local_port AND (l.addr IN ('', '0.0.0.0') OR l.addr = x.local_addr) AND (l.pid = x.pid OR l.pid IN (0, 4) OR x.pid IN (0, 4)))""")
def accepted_theta(spark, sf_dir):
    o = observations(spark, sf_dir)
    x = o.select("id", F.col("event_type").alias("proto"), F.col("port").alias("local_port"), (F.col("ip") % 7).cast("string").alias("local_addr"), (F.col("ip") % 9).alias("pid"))
    addr = F.when(F.col("ip") % 30 == 0, "").when(F.col("ip") % 30 == 3, "0.0.0.0").when(F.col("ip") % 30 == 6, "*").otherwise((F.col("ip") % 7).cast("string"))
    listening = o.where("event_type = 'error'").select(F.col("event_type").alias("proto"), "port", addr.alias("addr"), (F.col("ip") % 9).alias("pid")).distinct()
    return snapshots.accepted(x, listening).select("id")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 400)")
def anti_allow(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.join(e.where("event_type = 'error' and value > 400").select("user_id").distinct(), "user_id", "left_anti").select("event_id")


@query("""WITH d AS (SELECT p_partkey, upper(lpad(to_hex(p_partkey * 2654435761 % 1099511627776), 12, '0')) AS m FROM part), r AS (SELECT substr(m, 1, n) AS prefix, max('org' || p_partkey) AS organisation FROM d, (VALUES (6), (7), (9)) v(n) WHERE p_partkey % (n * 5) = 0 GROUP BY 1)
SELECT d.p_partkey, CASE WHEN m IN ('000000000000', 'FFFFFFFFFFFF') THEN NULL WHEN substr(m, 2, 1) IN ('2', '3', '6', '7', 'A', 'B', 'E', 'F') THEN 'Random' ELSE coalesce(a.organisation, b.organisation, c.organisation) END AS vendor FROM d LEFT JOIN r a ON a.prefix = substr(m, 1, 9) LEFT JOIN r b ON b.prefix = substr(m, 1, 7) LEFT JOIN r c ON c.prefix = substr(m, 1, 6)""")
def prefix_match(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.hex(F.col("p_partkey") * 2654435761 % 1099511627776), 12, "0").alias("mac"))
    n = F.explode(F.array(F.lit(6), F.lit(7), F.lit(9)))
    registry = d.withColumn("n", n).where("p_partkey % (n * 5) = 0").select(F.expr("substring(mac, 1, n)").alias("prefix"), F.concat(F.lit("org"), "p_partkey").alias("organisation"))
    return inventory.vendors(d, registry).select("p_partkey", "vendor")


@query("SELECT provider, event_id, level, CASE " + " ".join(f"WHEN contains(lower(provider), '{p}') AND {'event_id IN (' + ', '.join(map(str, ids)) + ')' if ids else 'level BETWEEN 1 AND 3'} THEN '{c}'" for p, ids, c in dims.EVENT_RULES) + """ ELSE 'other' END AS category, count(*) AS n FROM (SELECT CASE user_id % 6 WHEN 0 THEN 'Service Control Manager' WHEN 1 THEN 'Application Error' WHEN 2 THEN 'Microsoft-Windows-Kernel-Power' WHEN 3 THEN 'disk' WHEN 4 THEN 'MyDriver' ELSE 'x' END AS provider, CASE user_id % 5 WHEN 0 THEN 7031 WHEN 1 THEN 1000 WHEN 2 THEN 41 WHEN 3 THEN 7 ELSE 42 END AS event_id, """ + LEVEL + " AS level FROM events) GROUP BY 1, 2, 3, 4")
def classify_case(spark, sf_dir):
    pick = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % n + 1).cast("int"))
    e = leveled(spark, sf_dir).withColumn("provider", pick(6, ["Service Control Manager", "Application Error", "Microsoft-Windows-Kernel-Power", "disk", "MyDriver", "x"])).withColumn("event_id", pick(5, [7031, 1000, 41, 7, 42]))
    return e.withColumn("category", events.category(F.col("provider"), F.col("event_id"), F.col("level"))).groupBy("provider", "event_id", "level", "category").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, max(l_extendedprice) AS top_price, max(l_quantity) AS top_quantity, first(l_orderkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) AS orderkey FROM lineitem GROUP BY 1")
def argmax_per_group(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("top_price"), F.max("l_quantity").alias("top_quantity"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("orderkey"))


@query("""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS DOUBLE) AS value FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(1 AS DOUBLE) FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, round(c_acctbal) FROM customer),
up AS (SELECT id, id AS ancestor, 0 AS depth FROM n UNION ALL SELECT up.id, n.parent, up.depth + 1 FROM up JOIN n ON n.id = up.ancestor WHERE n.parent IS NOT NULL)
SELECT d.id, CAST(d.depth AS INTEGER) AS depth, CAST(round(s.subtree) AS BIGINT) AS subtree, s.descendants FROM (SELECT id, max(depth) AS depth FROM up GROUP BY id) d JOIN (SELECT ancestor, sum(value) AS subtree, count(*) - 1 AS descendants FROM up JOIN n USING (id) GROUP BY ancestor) s ON s.ancestor = d.id""")
def tree_rollup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = t("region").select(named("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("value"))
    nodes = nodes.union(t("nation").select(named("n", "n_nationkey"), named("r", "n_regionkey"), F.lit(1.0))).union(t("customer").select(named("c", "c_custkey"), named("n", "c_nationkey"), F.round("c_acctbal")))
    return tree.rollup(nodes).withColumn("subtree", F.round("subtree").cast("long"))


@query("""WITH a AS (SELECT p_partkey AS app_id, regexp_replace(lower(p_name), '[ \\-_.(),]', '', 'g') AS a, p_size AS version FROM part), u AS (SELECT p_name AS upgrade_name, regexp_replace(lower(p_name), '[ \\-_.(),]', '', 'g') AS u, max(p_size) AS current FROM part GROUP BY 1, 2 UNION ALL SELECT '()', '', 1)
SELECT upgrade_name, app_id FROM (SELECT *, row_number() OVER (PARTITION BY upgrade_name ORDER BY (version = current) DESC, CASE WHEN version = current THEN -app_id ELSE app_id END) AS r FROM u JOIN a ON u.u <> '' AND (a.a = u.u OR (length(u.u) >= 8 AND starts_with(a.a, u.u)))) WHERE r = 1""")
def name_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    apps = p.select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"), F.col("p_size").alias("version"))
    available = p.groupBy(F.col("p_name").alias("upgrade_name")).agg(F.max("p_size").alias("current"))
    available = available.union(spark.range(1).select(F.lit("()"), F.lit(1)))
    return inventory.upgrades(apps, available).select("upgrade_name", "app_id")


@query("""WITH r AS (SELECT p_partkey, lower(p_brand) AS name, p_size AS version, CASE WHEN p_partkey % 3 = 0 THEN 'machine' ELSE 'user' END AS scope, p_partkey % 5 = 0 AS hidden FROM part),
g AS (SELECT name, version, arg_min(scope, p_partkey) AS s, arg_min(hidden, p_partkey) AS h, min(p_partkey) AS f, min(CASE WHEN scope <> 'user' THEN p_partkey END) AS b FROM r GROUP BY 1, 2)
SELECT r.p_partkey, CASE WHEN r.p_partkey = f THEN r.hidden ELSE r.hidden AND h END AS hidden FROM g JOIN r ON r.p_partkey = CASE WHEN s = 'user' THEN coalesce(b, f) ELSE f END""")
def inventory_dedupe(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), F.col("p_size").alias("version"), F.when(F.col("p_partkey") % 3 == 0, "machine").otherwise("user").alias("scope"), (F.col("p_partkey") % 5 == 0).alias("hidden"))
    return inventory.deduplicated(p, "p_partkey").select("p_partkey", "hidden")


_PENALTY = lambda c, start, weight, cap: f"CASE WHEN floor(greatest(0.0, least({cap}.0, ({c} - {start}) * {weight})) * 10 + 0.5) / 10 > 0.05 THEN floor(greatest(0.0, least({cap}.0, ({c} - {start}) * {weight})) * 10 + 0.5) / 10 ELSE 0 END"


@query(f"""WITH i AS (SELECT user_id, CAST(max(value) / 5 AS DOUBLE) AS cpu, CAST(avg(value) / 3 AS DOUBLE) AS mem, count(*) FILTER (WHERE event_type = 'error') AS critical, count(*) FILTER (WHERE event_type = 'purchase') AS warning FROM events GROUP BY 1)
SELECT user_id, round(floor(greatest(0, 100 - {" - ".join("(" + _PENALTY(n, s, w, c) + ")" for n, s, w, c in health.FACTORS if n in ("cpu", "mem", "critical", "warning"))}) * 10 + 0.5) / 10, 1) AS score FROM i""")
def health_score(spark, sf_dir):
    i = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max("value") / 5).alias("cpu"), (F.avg("value") / 3).alias("mem"), F.count_if(F.col("event_type") == "error").alias("critical"), F.count_if(F.col("event_type") == "purchase").alias("warning"))
    for name in ("commit", "disk", "sweeps", "services"):
        i = i.withColumn(name, F.lit(0))
    return health.score(i).select("user_id", F.round("score", 1).alias("score"))


@query("""WITH g AS (SELECT event_type AS kind, user_id AS subject, count(*) AS count, min(ts) AS first, max(ts) AS last, CASE WHEN count(*) >= 20 THEN 'critical' WHEN count(*) >= 12 THEN 'warning' ELSE 'info' END AS severity FROM events GROUP BY 1, 2)
SELECT kind, subject, count, severity, first, last, 'EVT-' || lpad(CAST(row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, count DESC, last DESC, subject, kind) AS VARCHAR), 6, '0') AS id FROM g""")
def severity_report(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.col("user_id").alias("subject")).agg(F.count("*").alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    g = g.withColumn("severity", F.when(F.col("count") >= 20, "critical").when(F.col("count") >= 12, "warning").otherwise("info"))
    order = [X.severity_rank(F.col("severity")), F.desc("count"), F.desc("last"), "subject", "kind"]
    return audit.numbered(g, order, "id", "EVT-", 6).select("kind", "subject", "count", "severity", "first", "last", "id")


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\r\n\t ]+', ' ', 'g'), '^ | $', '', 'g')) AS clean, md5(regexp_replace(lower(source), '[ \-_.(),]', '', 'g')) AS norm FROM documents")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.collapsed(F.col("text")).cast("binary")).alias("clean"), F.md5(X.normalised(F.col("source")).cast("binary")).alias("norm"))


@query("""WITH v AS (SELECT p_partkey, p_size % 4 AS a1, p_size % 7 AS a2, p_partkey % 3 AS b1, p_partkey % 11 AS b2 FROM part) SELECT p_partkey, CASE WHEN a1 < b1 THEN -1 WHEN a1 > b1 THEN 1 WHEN a2 < b2 THEN -1 WHEN a2 > b2 THEN 1 ELSE 0 END AS cmp FROM v""")
def version_compare(spark, sf_dir):
    text = lambda a, b: F.concat_ws(".", a.cast("string"), b.cast("string"))
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", X.compare_versions(text(s % 4, s % 7), text(k % 3, k % 11)).alias("cmp"))


@query("SELECT doc_id, md5(CASE WHEN substr(t, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || t ELSE t END) AS cell FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' || text WHEN doc_id % 3 = 1 THEN '@' || text ELSE text END AS t FROM documents)")
def csv_safe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.when(d.doc_id % 3 == 0, F.concat(F.lit("="), "text")).when(d.doc_id % 3 == 1, F.concat(F.lit("@"), "text")).otherwise(d.text)
    return d.select("doc_id", F.md5(X.csv_safe(t).cast("binary")).alias("cell"))


@query("SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1 HAVING max(o_orderdate) >= TIMESTAMP '1995-01-01' AND min(o_orderdate) <= TIMESTAMP '1995-06-30'")
def overlap_filter(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    return g.where("last >= timestamp '1995-01-01' and first <= timestamp '1995-06-30'")


@query("SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def facet_counts(spark, sf_dir):
    return snapshots.facets(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT event_id, CASE WHEN value >= 400 THEN 'critical' WHEN value >= 300 THEN 'warning' ELSE 'info' END AS state FROM events WHERE (user_id % 65536 >= 32768 OR user_id % 100 < 50) AND value >= 200")
def threshold_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("(user_id % 65536 >= 32768 or user_id % 100 < 50) and value >= 200")
    return e.select("event_id", F.when(F.col("value") >= 400, "critical").when(F.col("value") >= 300, "warning").otherwise("info").alias("state"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Apple' WHEN 1 THEN 'Foo Technology' WHEN 2 THEN 'Microsoft' ELSE 'Intel' END AS short, CASE s_suppkey % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN NULL WHEN 2 THEN 'console' ELSE 'pc' END AS class FROM supplier")
def brand_match(spark, sf_dir):
    names = F.array(*map(F.lit, ["Apple, Inc.", "Foo Technology Co.,Ltd.", "Microsoft XBOX Corp", "Intel Corporate"]))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", inventory.brand(F.element_at(names, (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("b"))
    return s.select("s_suppkey", "b.short", "b.class")


@query("""WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN ts END AS changed FROM events)
SELECT user_id AS ip, arg_max(event_type, ts) AS mac, min(ts) AS first_seen, max(ts) AS last_seen, max(changed) AS mac_since FROM c GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""")
def device_inventory(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("ip"), F.col("event_type").alias("mac"), "ts")
    return inventory.devices(e, F.lit(e.agg(F.max("ts")).first()[0]), DAY // 2)
