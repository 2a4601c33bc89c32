"""Driver queries of the host operators: sockets, processes, services, interfaces, rules, audits, alerts and inventory made from the
test tables. What stands for a host's table is a list of SQL expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import dims
from wardline.functions import scalars as X
from wardline.operators import alerts, audit, events, inventory, radar, rates, rules, snapshots, tree
from wardline.plans.queries import DAY, OBS, QUERIES, SQL, observations, query, table
from wardline.sources import binary, readers

PORT = """CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER)"""
SOCKETS = {
    "id": "event_id",
    "proto": "CASE user_id % 4 WHEN 0 THEN 'TCP6' WHEN 1 THEN 'UDP' ELSE 'TCP' END",
    "state": "CASE WHEN user_id % 4 = 1 THEN '-' WHEN event_type = 'click' THEN 'SYN_RECEIVED' WHEN event_type = 'view' THEN 'LISTEN' WHEN event_type = 'signup' THEN 'TIME_WAIT' ELSE 'ESTABLISHED' END",
    "local_addr": "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '0.0.0.0' WHEN 2 THEN '::' WHEN 3 THEN '10.0.0.1' ELSE '10.0.0.2' END",
    "local_port": f"{PORT} + CASE WHEN event_id % 3 = 0 THEN 49000 ELSE 0 END",
    "remote_addr": "CASE WHEN event_type = 'view' THEN '' WHEN event_id % 11 = 0 THEN '127.0.0.1' ELSE '10.1.0.' || CAST(event_id % 200 AS STRING) END",
    "remote_port": "CAST(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 443 WHEN 2 THEN 8080 ELSE 50000 + event_id % 1000 END AS INTEGER)",
    "pid": "user_id % 9",
    "process_name": "CASE user_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Chrome.exe' WHEN 2 THEN 'sshd' ELSE 'svc' || CAST(user_id % 9 AS STRING) END",
}
PROCESSES = {"ts": "ts", "pid": "event_id", "name": "CASE event_type WHEN 'error' THEN 'Alpha.EXE' WHEN 'click' THEN 'alpha.exe' ELSE event_type END", "cpu": "round(value / 5)", "working_set": f"CAST({PORT} * 1048576 AS BIGINT)", "threads": "CAST(floor(value) AS INTEGER) % 40", "access": "user_id % 7 <> 0"}
SERVICES = {"name": "s_name", "state": "CASE s_nationkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'stopped' ELSE 'paused' END", "start_type": "CASE s_suppkey % 5 WHEN 0 THEN 'disabled' WHEN 1 THEN 'manual' WHEN 2 THEN 'auto-delayed' ELSE 'auto' END", "exit_code": "CASE s_suppkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1077 ELSE 5 END", "pid": "s_suppkey % 6"}
INTERFACES = {"name": "s_name", "kind": "CASE s_nationkey % 4 WHEN 0 THEN 'loopback' WHEN 1 THEN 'wifi' ELSE 'ethernet' END", "up": "s_suppkey % 3 <> 0", "physical": "s_suppkey % 2 = 0", "in_bps": "round(abs(s_acctbal))", "out_bps": "CAST(s_suppkey AS DOUBLE)"}
LOGONS = {
    "record_id": "event_id",
    "time": "ts",
    "event_id": "CASE event_type WHEN 'error' THEN 4625 WHEN 'click' THEN 4672 WHEN 'view' THEN 4740 ELSE 4624 END",
    "user": "CASE user_id % 12 WHEN 0 THEN 'Administrator' WHEN 1 THEN 'SYSTEM' WHEN 2 THEN '' ELSE 'User' || CAST(user_id % 12 AS STRING) END",
    "domain": "CASE user_id % 3 WHEN 0 THEN 'CORP' ELSE '' END",
    "source": "CASE user_id % 10 WHEN 0 THEN '' WHEN 1 THEN '127.0.0.1' ELSE '10.2.0.' || CAST(user_id % 5 AS STRING) END",
    "status": "CASE event_id % 4 WHEN 0 THEN '0xC000006A' WHEN 1 THEN '0xc0000064' WHEN 2 THEN '0x1' ELSE '' END",
}
FAULTS = {
    "record_id": "event_id",
    "time": "ts",
    "event_id": "CASE event_type WHEN 'error' THEN 7031 WHEN 'click' THEN 1000 WHEN 'view' THEN 1002 WHEN 'purchase' THEN 41 ELSE 6008 END",
    "provider": "CASE event_type WHEN 'error' THEN 'Service Control Manager' WHEN 'click' THEN 'Application Error' WHEN 'view' THEN 'Application Hang' WHEN 'purchase' THEN 'Microsoft-Windows-Kernel-Power' ELSE 'EventLog' END",
    "subject": "CASE user_id % 5 WHEN 0 THEN '' ELSE 'Name' || CAST(user_id % 40 AS STRING) END",
    "code": "CASE user_id % 3 WHEN 0 THEN '159' WHEN 1 THEN '0x124' ELSE '0' END",
}


def select(spark, sf_dir, name: str, columns: dict[str, str]):
    return table(spark, sf_dir, name).selectExpr(*(f"{v} AS `{k}`" for k, v in columns.items()))


def cte(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in columns.items()) + f" FROM {source})"


CONN = cte("c", "events", SOCKETS)
OUTBOUND = f"remote_port <> 0 AND local_port >= {dims.EPHEMERAL_START} AND (remote_port < 1024 OR remote_port IN ({', '.join(map(str, dims.SERVICE_PORTS))}))"
CLIENTS = ", ".join(f"'{x}'" for x in dims.CLIENT_PROCESSES)
ACCEPTED = "EXISTS (SELECT 1 FROM c l WHERE l.state = 'LISTEN' AND l.proto = c.proto AND l.local_port = c.local_port AND (l.local_addr IN ('', '0.0.0.0', '::') OR l.local_addr = c.local_addr) AND (l.pid = c.pid OR l.pid IN (0, 4) OR c.pid IN (0, 4)))"


@query(f"""WITH {CONN}, n AS (SELECT *, CASE WHEN process_name = '' THEN 'pid ' || pid ELSE process_name END AS who FROM c)
SELECT 'total' AS kind, '' AS name, count(*) AS n FROM n UNION ALL SELECT 'proto', proto, count(*) FROM n GROUP BY 2 UNION ALL SELECT 'state', state, count(*) FROM n WHERE state <> '-' GROUP BY 2
UNION ALL (SELECT 'process', who, count(*) AS k FROM n GROUP BY 2 ORDER BY k DESC, 2 LIMIT 8) UNION ALL (SELECT 'remote', remote_addr, count(*) AS k FROM n WHERE state = 'ESTABLISHED' AND remote_addr NOT IN ('', '127.0.0.1') GROUP BY 2 ORDER BY k DESC, 2 LIMIT 8)""")
def socket_stats(spark, sf_dir):
    return snapshots.socket_stats(select(spark, sf_dir, "events", SOCKETS))


@query(f"""WITH {CONN} SELECT id FROM c WHERE proto IN ('TCP', 'TCP6') AND state <> 'LISTEN' AND remote_addr <> '' AND remote_port <> 0 AND lower(process_name) NOT IN ({CLIENTS})
AND (state = 'SYN_RECEIVED' OR (NOT ({OUTBOUND}) AND {ACCEPTED}))""")
def table_sensor(spark, sf_dir):
    c = select(spark, sf_dir, "events", SOCKETS)
    heard = c.where("state = 'LISTEN'").select("proto", F.col("local_port").alias("port"), F.col("local_addr").alias("addr"), "pid").distinct()
    return snapshots.table_observations(c, heard).select("id")


@query(f"""WITH {CONN}, l AS (SELECT proto || ':' || local_port AS key, local_addr, pid FROM c WHERE state = 'LISTEN') SELECT key, string_agg(local_addr || '/' || pid, ',' ORDER BY local_addr, pid) AS listeners FROM l GROUP BY key""")
def listener_map(spark, sf_dir):
    found = snapshots.listeners(select(spark, sf_dir, "events", SOCKETS))
    return found.select("key", F.array_join(F.transform("listeners", lambda x: F.concat_ws("/", x["addr"], x["pid"].cast("string"))), ",").alias("listeners"))


@query(f"""WITH {CONN} SELECT id FROM c ORDER BY proto, local_port, concat_ws('|', proto, local_addr, local_port, remote_addr, remote_port, pid), id LIMIT 500""")
def socket_page(spark, sf_dir):
    c = select(spark, sf_dir, "events", SOCKETS)
    return snapshots.socket_order(c).orderBy("proto", "local_port", "key", "id").limit(500).select("id")


@query(f"""WITH {CONN}, f AS (SELECT *, concat_ws('|', proto, local_addr, local_port, remote_addr, remote_port, pid) AS key FROM c WHERE state = 'ESTABLISHED' AND remote_addr NOT IN ('', '127.0.0.1') AND remote_port <> 0)
SELECT direction, count(*) AS n FROM (SELECT CASE WHEN local_port < 1024 AND remote_port >= 1024 THEN 'inbound/likely' ELSE 'outbound/unknown' END AS direction FROM (SELECT DISTINCT key, proto, local_port, remote_port FROM f ORDER BY proto, local_port, key LIMIT 200)) GROUP BY 1""")
def flow_directions(spark, sf_dir):
    c = select(spark, sf_dir, "events", SOCKETS).drop("id").dropDuplicates(["proto", "local_addr", "local_port", "remote_addr", "remote_port", "pid", "state"])
    none = spark.createDataFrame([], "key string, in_bps double"), spark.createDataFrame([], "ip string, country string")
    return snapshots.flows(c, *none).groupBy("direction").agg(F.count("*").alias("n"))


@query(f"""WITH {CONN}, {cte("s", "supplier", SERVICES)}, p AS (SELECT DISTINCT pid FROM c UNION SELECT 100), k AS (SELECT pid, count(*) AS sockets FROM c GROUP BY pid), v AS (SELECT pid, string_agg(name, ',' ORDER BY name) AS services FROM s WHERE pid <> 0 AND state = 'running' GROUP BY pid)
SELECT p.pid, coalesce(sockets, 0) AS sockets, coalesce(services, '') AS services FROM p LEFT JOIN k ON k.pid = p.pid LEFT JOIN v ON v.pid = p.pid""")
def process_links(spark, sf_dir):
    c = select(spark, sf_dir, "events", SOCKETS)
    p = c.select("pid").distinct().union(spark.range(100, 101).select(F.col("id").alias("pid"))).distinct()
    out = snapshots.services_of(snapshots.sockets_of(p, c), select(spark, sf_dir, "supplier", SERVICES))
    return out.select("pid", "sockets", F.array_join("services", ",").alias("services"))


@query(f"""WITH {cte("s", "supplier", SERVICES)} SELECT count(*) AS total, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'stopped') AS stopped, count(*) FILTER (WHERE start_type = 'disabled') AS disabled,
count(*) FILTER (WHERE state = 'stopped' AND start_type IN ('auto', 'auto-delayed')) AS auto_stopped, count(*) FILTER (WHERE state = 'stopped' AND start_type IN ('auto', 'auto-delayed') AND exit_code NOT IN (0, 1077)) AS auto_failed FROM s""")
def service_summary(spark, sf_dir):
    return snapshots.service_summary(select(spark, sf_dir, "supplier", SERVICES))


@query(f"""WITH {cte("i", "supplier", INTERFACES)} SELECT sum(in_bps) AS in_bps, sum(out_bps) AS out_bps FROM i WHERE up AND kind <> 'loopback'""")
def interface_totals(spark, sf_dir):
    return snapshots.interface_totals(select(spark, sf_dir, "supplier", INTERFACES))


@query(f"""WITH {cte("i", "supplier", INTERFACES)} SELECT name, CASE WHEN up THEN 0 ELSE 4 END + CASE WHEN physical THEN 0 ELSE 1 END + CASE WHEN kind = 'loopback' THEN 8 ELSE 0 END AS rank FROM i ORDER BY rank, in_bps + out_bps DESC, name LIMIT 50""")
def interface_page(spark, sf_dir):
    return snapshots.interface_order(select(spark, sf_dir, "supplier", INTERFACES)).limit(50).select("name", snapshots.interface_rank().alias("rank"))


@query(f"""WITH {cte("p", "events", PROCESSES)}, a AS (SELECT lower(name) AS image, * FROM p WHERE access AND pid <> 0)
SELECT image, max(cpu) AS cpu, max(working_set / 1048576.0) AS memory_mb, max(threads) AS threads, first(pid ORDER BY cpu DESC, working_set, pid DESC) AS pid FROM a GROUP BY image""")
def process_feed(spark, sf_dir):
    return snapshots.process_feed(select(spark, sf_dir, "events", PROCESSES))


@query(f"""WITH {cte("p", "events", PROCESSES)} SELECT pid, round(cpu / 100 + working_set / 104857600.0, 9) AS weight FROM p WHERE access ORDER BY cpu / 100 + working_set / 104857600.0 DESC, pid LIMIT 10""")
def heaviest_processes(spark, sf_dir):
    return snapshots.heaviest(select(spark, sf_dir, "events", PROCESSES), F.lit(104857600)).select("pid", F.round("weight", 9).alias("weight"))


@query(f"""WITH {cte("p", "events", PROCESSES)} SELECT pid FROM p ORDER BY cpu DESC, working_set DESC, pid LIMIT 200""")
def process_page(spark, sf_dir):
    return snapshots.process_order(select(spark, sf_dir, "events", PROCESSES)).limit(200).select("pid")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal) DESC, c_custkey % 10 DESC, c_custkey) AS place FROM customer")
def sibling_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("parent"), F.round("c_acctbal").alias("cpu"), (F.col("c_custkey") % 10).alias("memory"))
    return tree.siblings(c, "cpu", "memory", "c_custkey").select("c_custkey", F.col("place").cast("long").alias("place"))


RULE_OBS = "o AS (SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS instance, date_trunc('hour', ts) AS ts, max(least(value, 100.0)) AS value FROM events GROUP BY 1, 2)"
RULE = {"id": "hot", "metric": "proc_cpu", "op": ">", "threshold": 60.0, "for_sec": 3600, "hysteresis": 20.0, "scope": "click/1*,error/[2-4]?,view/7, purchase/*"}
STATES = f"""WITH {RULE_OBS}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) AS tick, lead(ts) OVER (ORDER BY ts) AS next_ts FROM (SELECT DISTINCT ts FROM o)),
m AS (SELECT o.*, tick, next_ts, value > 60 AS held, coalesce(tick - lag(tick) OVER w > 1, FALSE) AS gone, lead(tick) OVER w AS next_tick FROM o JOIN t ON t.ts = o.ts WHERE regexp_full_match(instance, 'click/1[^/]*|error/[2-4][^/]|view/7|purchase/[^/]*') WINDOW w AS (PARTITION BY instance ORDER BY tick)),
s AS (SELECT *, sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER (PARTITION BY instance ORDER BY tick) AS stretch FROM m),
r AS (SELECT *, sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY instance, stretch ORDER BY tick) AS run FROM s),
h AS (SELECT *, CASE WHEN held THEN min(CASE WHEN held THEN ts END) OVER (PARTITION BY instance, stretch, run) END AS since FROM r),
k AS (SELECT *, CASE WHEN held AND ts - since >= INTERVAL 1 HOUR THEN TRUE WHEN NOT held AND value < 40 THEN FALSE END AS mark FROM h),
x AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY instance, stretch ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS was, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY instance, stretch ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS firing FROM k)"""


def rule_observations(spark, sf_dir):
    """The highest value of each event type and user in an hour: absent hours are absences."""
    e = table(spark, sf_dir, "events").select(F.lit("proc_cpu").alias("metric"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("instance"), F.date_trunc("hour", "ts").alias("ts"), F.least(F.col("value"), F.lit(100.0)).alias("value"))
    return e.groupBy("metric", "instance", "ts").agg(F.max("value").alias("value"))


@query(f"""{STATES} SELECT 'hot' AS rule_id, instance, ts, value, CASE WHEN firing THEN 'fired' ELSE 'resolved' END AS event FROM x WHERE firing <> was
UNION ALL SELECT 'hot', instance, next_ts, NULL, 'resolved' FROM x WHERE firing AND next_ts IS NOT NULL AND (next_tick IS NULL OR next_tick > tick + 1)""")
def rule_firings(spark, sf_dir):
    return rules.evaluate(rule_observations(spark, sf_dir), [RULE])


DAILY = RULE | {"for_sec": 0, "scope": ""}
DAILY_STATES = STATES.replace("date_trunc('hour', ts)", "date_trunc('day', ts)").replace("INTERVAL 1 HOUR", "INTERVAL 0 HOUR").replace("regexp_full_match(instance, 'click/1[^/]*|error/[2-4][^/]|view/7|purchase/[^/]*')", "TRUE")


@query(f"""{DAILY_STATES}, z AS (SELECT * FROM x WHERE ts = (SELECT max(ts) FROM o)), b AS (SELECT instance, row_number() OVER (ORDER BY firing DESC, value DESC, instance) AS place FROM z WHERE firing OR since IS NOT NULL)
SELECT 'hot' AS rule_id, count(*) FILTER (WHERE firing) AS firing, count(*) FILTER (WHERE NOT firing AND since IS NOT NULL) AS pending, max(value) AS worst, (SELECT count(*) FROM x WHERE firing AND NOT was) AS fired, (SELECT string_agg(instance, ',' ORDER BY place) FROM b WHERE place <= 10) AS instances FROM z""")
def rule_states(spark, sf_dir):
    o = rule_observations(spark, sf_dir).groupBy("metric", "instance", F.date_trunc("day", "ts").alias("ts")).agg(F.max("value").alias("value"))
    return rules.runtime(o, [DAILY], F.lit(o.agg(F.max("ts")).first()[0]))


def logons(spark, sf_dir):
    e = select(spark, sf_dir, "events", LOGONS)
    data = F.create_map(F.lit("TargetUserName"), F.col("user"), F.lit("TargetDomainName"), F.col("domain"), F.lit("SubjectUserName"), F.col("user"), F.lit("SubjectDomainName"), F.col("domain"), F.lit("IpAddress"), F.col("source"), F.lit("Status"), F.col("status"))
    return e.select("record_id", "time", F.col("event_id").cast("long").alias("event_id"), data.alias("data"))


ACCOUNT = """(CASE WHEN "domain" = '' THEN '' ELSE "domain" || '\\' END) || CASE WHEN "user" = '' THEN '(empty)' ELSE "user" END"""


@query(f"""WITH {cte("l", "events", LOGONS)}, a AS (SELECT *, {ACCOUNT} AS account, lower({ACCOUNT}) AS who, lower("user") AS name FROM l),
f AS (SELECT *, count(*) OVER (PARTITION BY who, source ORDER BY time RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW) AS k FROM a WHERE event_id = 4625),
g AS (SELECT 'failed-logon' AS kind, arg_max(account, time) AS subject, count(*) AS count, min(time) AS first, max(time) AS last, CASE WHEN count(*) >= 20 OR max(k) >= 10 THEN 'critical' WHEN count(*) >= 5 OR max(k) >= 5 THEN 'warning' ELSE 'info' END AS severity FROM f GROUP BY who, source
UNION ALL SELECT 'password-spray', source, count(*), min(time), max(time), 'critical' FROM f WHERE source NOT IN ('', '127.0.0.1') GROUP BY source HAVING count(DISTINCT account) >= 5
UNION ALL SELECT 'account-lockout', arg_max(CASE WHEN "user" = '' THEN '(empty)' ELSE "user" END, time), count(*), min(time), max(time), CASE WHEN count(*) >= 3 THEN 'critical' ELSE 'warning' END FROM a WHERE event_id = 4740 GROUP BY lower(CASE WHEN "user" = '' THEN '(empty)' ELSE "user" END)
UNION ALL SELECT 'privileged-logon', arg_max(account, time), count(*), min(time), max(time), CASE WHEN name IN (SELECT name FROM f) OR who = 'administrator' OR ends_with(who, '\\administrator') THEN 'warning' ELSE 'info' END FROM a WHERE event_id = 4672 AND upper("user") <> 'SYSTEM' GROUP BY who, name
UNION ALL SELECT 'privileged-logon', 'built-in service accounts', count(*), min(time), max(time), 'info' FROM a WHERE event_id = 4672 AND upper("user") = 'SYSTEM' HAVING count(*) > 0)
SELECT kind, severity, subject, count, first, last, 'AUT-' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS id FROM (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, count DESC, last DESC, subject, kind) AS r FROM g)""")
def auth_audit(spark, sf_dir):
    return audit.authentication(logons(spark, sf_dir)).select("kind", "severity", "subject", "count", "first", "last", "id")


@query(f"""WITH {cte("l", "events", LOGONS)}, a AS (SELECT *, {ACCOUNT} AS account FROM l WHERE event_id = 4625), s AS (SELECT lower(account) AS who, source, lower(status) AS status FROM a WHERE status <> ''),
t AS (SELECT DISTINCT who, source, status, CASE status {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.LOGON_STATUS.items())} ELSE 'status ' || status END AS text FROM s)
SELECT lower(account) AS who, a.source, coalesce(any_value(x.codes), '') AS codes, 'unknown: ' || coalesce(any_value(x.texts), 'no reason recorded') AS reason FROM a LEFT JOIN (SELECT who, source, string_agg(status, ', ' ORDER BY status) AS codes, string_agg(text, '; ' ORDER BY status) AS texts FROM t GROUP BY 1, 2) x ON x.who = lower(account) AND x.source = a.source GROUP BY 1, 2""")
def logon_reasons(spark, sf_dir):
    found = audit.authentication(logons(spark, sf_dir)).where("kind = 'failed-logon'")
    return found.select(F.lower("subject").alias("who"), F.coalesce(F.try_element_at("details", F.lit("sourceIp")), F.lit("")).alias("source"), F.coalesce(F.try_element_at("details", F.lit("statusCode")), F.lit("")).alias("codes"), "reason")


@query(f"""WITH {cte("l", "events", LOGONS)} SELECT 'scanned' AS part, '' AS name, count(*) AS n FROM l WHERE event_id <> 4624 UNION ALL SELECT 'event_id', CAST(event_id AS VARCHAR), count(*) FROM l WHERE event_id <> 4624 GROUP BY 2""")
def audit_report(spark, sf_dir):
    e = logons(spark, sf_dir)
    return audit.report(e, audit.authentication(e), audit.AUTH_IDS).where("part != 'severity'")


def faults(spark, sf_dir):
    e = select(spark, sf_dir, "events", FAULTS)
    data = F.create_map(F.lit("param1"), F.col("subject"), F.lit("AppName"), F.col("subject"), F.lit("BugcheckCode"), F.col("code"))
    return e.select("record_id", "time", F.col("event_id").cast("long").alias("event_id"), "provider", F.lit("").alias("message"), data.alias("data"))


@query(f"""WITH {cte("l", "events", FAULTS)}, n AS (SELECT *, CASE WHEN subject <> '' THEN subject WHEN event_id = 7031 THEN '(unknown service)' ELSE '(unknown application)' END AS name FROM l),
d AS (SELECT *, CASE WHEN time - lag(time) OVER (ORDER BY time) > INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS far FROM n WHERE event_id = 6008 OR (event_id = 41 AND code = '0')),
g AS (SELECT CASE event_id WHEN 7031 THEN 'service-crash' WHEN 1000 THEN 'app-fault' ELSE 'app-hang' END AS kind, arg_max(name, time) AS subject, count(*) AS count, min(time) AS first, max(time) AS last, CASE event_id WHEN 7031 THEN CASE WHEN count(*) >= 3 THEN 'critical' ELSE 'warning' END WHEN 1000 THEN CASE WHEN count(*) >= 5 THEN 'critical' WHEN count(*) = 1 THEN 'info' ELSE 'warning' END ELSE CASE WHEN count(*) >= 3 THEN 'warning' ELSE 'info' END END AS severity FROM n WHERE event_id IN (7031, 1000, 1002) GROUP BY event_id, lower(name)
UNION ALL SELECT 'bugcheck', CASE code WHEN '159' THEN '0x0000009F DRIVER_POWER_STATE_FAILURE' ELSE '0x00000124 WHEA_UNCORRECTABLE_ERROR' END, count(*), min(time), max(time), 'critical' FROM n WHERE event_id = 41 AND code <> '0' GROUP BY code
UNION ALL SELECT 'unexpected-shutdown', 'System', sum(far) + 1, min(time), max(time), CASE WHEN sum(far) + 1 >= 3 THEN 'critical' ELSE 'warning' END FROM d HAVING count(*) > 0)
SELECT kind, severity, subject, CAST(count AS BIGINT) AS count, first, last, 'REL-' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS id FROM (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, count DESC, last DESC, subject, kind) AS r FROM g)""")
def reliability_audit(spark, sf_dir):
    return audit.reliability(faults(spark, sf_dir)).select("kind", "severity", "subject", "count", "first", "last", "id")


@query(f"""WITH {OBS}, n AS (SELECT max(ts) AS now FROM events) SELECT s.bucket, count(o.ts) AS n FROM (SELECT unnest(range(60)) AS bucket) s LEFT JOIN (SELECT epoch_us(ts) // 3600000000 - epoch_us(now) // 3600000000 + 59 AS bucket, ts FROM o, n) o ON o.bucket = s.bucket GROUP BY 1""")
def obs_series(spark, sf_dir):
    o = observations(spark, sf_dir)
    return radar.series(o, F.lit(o.agg(F.max("ts")).first()[0]), 60, 3600)


@query(f"""WITH {OBS}, n AS (SELECT max(ts) AS now FROM events) SELECT ip FROM (SELECT ip, ip % 9 = 0 AS flagged, count(DISTINCT port) FILTER (WHERE ts >= now - INTERVAL 1 DAY) AS p, count(*) FILTER (WHERE ts >= now - INTERVAL 7 DAY) AS c, max(ts) AS l FROM o, n GROUP BY ip) ORDER BY flagged DESC, p DESC, c DESC, l DESC, ip LIMIT 100""")
def radar_hosts(spark, sf_dir):
    o = observations(spark, sf_dir)
    stats = radar.host_stats(o, F.lit(o.agg(F.max("ts")).first()[0]), DAY, 7 * DAY)
    return radar.host_order(stats.withColumn("flagged", F.col("ip") % 9 == 0)).select("ip")


@query(f"""WITH {OBS} SELECT id, array_to_string(list_sort(list_distinct(list(port) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))), ',') AS touched FROM o""")
def decoy_ports(spark, sf_dir):
    found = radar.decoy_ports(observations(spark, sf_dir), DAY)
    return found.select("id", F.array_join(F.transform("touched", lambda p: p.cast("string")), ",").alias("touched"))


@query(f"""WITH {OBS}, w AS (SELECT *, count(DISTINCT port) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM o) SELECT id, n AS in_window, max(n) OVER (PARTITION BY ip ORDER BY ts) AS peak FROM w""")
def running_peak(spark, sf_dir):
    return radar.hits(observations(spark, sf_dir), DAY, 6).select("id", F.col("in_window").cast("long").alias("in_window"), F.col("peak").cast("long").alias("peak"))


BLOCKED = {"time": "ts", "src": "CASE user_id % 4 WHEN 0 THEN '192.168.1.5' WHEN 1 THEN '127.0.0.1' ELSE '203.0.113.' || CAST(user_id % 200 AS STRING) END", "dst": "CASE user_id % 3 WHEN 0 THEN '192.168.1.5' ELSE '198.51.100.' || CAST(user_id % 250 AS STRING) END", "protocol": "CASE event_type WHEN 'click' THEN '17' ELSE '6' END", "direction": "CASE event_type WHEN 'view' THEN 'Inbound ' WHEN 'error' THEN '%%14593' ELSE '%%14592' END", "sport": f"CAST({PORT} AS STRING)", "dport": "CAST(event_id % 70000 AS STRING)"}


@query(f"""WITH {cte("b", "events", BLOCKED)}, x AS (SELECT *, dst = '192.168.1.5' AS inward FROM b WHERE protocol = '6' AND lower(trim(direction)) IN ('%%14592', 'inbound') AND src <> '127.0.0.1' AND (src = '192.168.1.5') <> (dst = '192.168.1.5')),
y AS (SELECT time AS ts, CASE WHEN inward THEN src ELSE dst END AS ip, CAST(CASE WHEN inward THEN dport ELSE sport END AS INTEGER) AS port, CAST(CASE WHEN inward THEN sport ELSE dport END AS INTEGER) AS remote_port FROM x) SELECT * FROM y WHERE port BETWEEN 1 AND 65535""")
def blocked_events(spark, sf_dir):
    b = select(spark, sf_dir, "events", BLOCKED)
    data = F.create_map(*(x for k, c in (("SourceAddress", "src"), ("DestAddress", "dst"), ("Protocol", "protocol"), ("Direction", "direction"), ("SourcePort", "sport"), ("DestPort", "dport")) for x in (F.lit(k), F.col(c))))
    e = b.select("time", F.lit(5157).alias("event_id"), F.lit("Security").alias("channel"), F.lit("Microsoft-Windows-Security-Auditing").alias("provider"), data.alias("data"))
    return radar.blocked(e, ["192.168.1.5"]).select("ts", "ip", "port", "remote_port")


LEVELED = {"record_id": "event_id", "channel": "CASE user_id % 3 WHEN 0 THEN 'System' WHEN 1 THEN 'Application' ELSE 'Security' END", "time": "ts", "level": "CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 ELSE 4 END", "provider": "'Prov' || CAST(user_id % 30 AS STRING)", "event_id": "user_id % 50", "category": "CASE WHEN value < 100 THEN 'other' ELSE 'disk' END", "message": "props"}
LEV = cte("e", "events", LEVELED)


@query(f"WITH {LEV} SELECT provider AS name, count(*) AS n FROM e WHERE level BETWEEN 1 AND 3 GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def event_sources(spark, sf_dir):
    return events.top_sources(select(spark, sf_dir, "events", LEVELED))


@query(f"WITH {LEV} SELECT record_id FROM e WHERE channel = 'System' AND record_id > 100 AND level BETWEEN 1 AND 3 AND time >= TIMESTAMP '2024-01-02' ORDER BY time DESC, record_id DESC LIMIT 2000")
def event_cursor(spark, sf_dir):
    return events.after(select(spark, sf_dir, "events", LEVELED), "System", F.expr("timestamp '2024-01-02'"), 2000, 3, 100).select("record_id")


@query(f"WITH {LEV} SELECT channel, max(record_id) AS after_record FROM e GROUP BY 1")
def channel_cursors(spark, sf_dir):
    return events.cursors(select(spark, sf_dir, "events", LEVELED))


@query(f"WITH {LEV} SELECT record_id FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY time DESC, record_id DESC) AS k FROM e) WHERE k <= 200")
def event_retention(spark, sf_dir):
    return events.retained(select(spark, sf_dir, "events", LEVELED), 200).select("record_id")


@query(f"WITH {LEV} SELECT record_id FROM e WHERE level <= 2 ORDER BY time DESC, record_id DESC LIMIT 25")
def latest_bad(spark, sf_dir):
    return events.latest_bad(select(spark, sf_dir, "events", LEVELED)).select("record_id")


@query(f"WITH {LEV} SELECT count(*) FILTER (WHERE level = 1) AS critical, count(*) FILTER (WHERE level = 2) AS errors FROM e")
def event_baseline(spark, sf_dir):
    return events.baseline(select(spark, sf_dir, "events", LEVELED))


@query(f"""WITH {LEV}, s AS (SELECT *, CASE WHEN level = 1 THEN 'critical' WHEN level = 2 AND category <> 'other' THEN 'warning' WHEN level = 2 THEN 'info' WHEN level = 3 AND category <> 'other' THEN 'info' END AS severity FROM e WHERE time > TIMESTAMP '2024-01-10')
SELECT record_id, severity, CASE category WHEN 'other' THEN 'system' ELSE 'reliability' END AS alert_category, 'ev:' || lower(provider) || ':' || event_id AS key, message AS detail FROM s WHERE severity IS NOT NULL""")
def fresh_alerts(spark, sf_dir):
    return events.fresh(select(spark, sf_dir, "events", LEVELED), F.expr("timestamp '2024-01-10'")).select("record_id", "severity", "alert_category", "key", "detail")


ALERTS = {"id": "event_id", "key": "CAST(user_id AS STRING)", "time": "ts", "updated": "ts", "severity": "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END", "category": "CASE user_id % 4 WHEN 0 THEN 'network' WHEN 1 THEN 'resource' ELSE 'system' END", "source": "event_type", "count": "CAST(user_id % 4 AS BIGINT)", "acked": "user_id % 5 = 0", "detail": "props"}
ALT = cte("a", "events", ALERTS)


def store(spark, sf_dir):
    a = select(spark, sf_dir, "events", ALERTS)
    text = lambda en: F.struct(en.alias("en"), F.lit("").alias("ar"))
    return a.withColumns({"title": text(F.concat(F.lit("="), "source")), "detail": text(F.col("detail")), "fields": F.create_map(F.lit("user"), F.col("key"), F.lit("a"), F.col("source"))})


@query(f"WITH {ALT} SELECT count(*) AS total, count(*) FILTER (WHERE NOT acked) AS unacked, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE updated > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS last24h FROM a")
def alert_totals(spark, sf_dir):
    return alerts.counts(select(spark, sf_dir, "events", ALERTS))


@query(f"WITH {ALT} SELECT category, count(*) AS n FROM a GROUP BY 1")
def alert_categories(spark, sf_dir):
    return alerts.by_category(select(spark, sf_dir, "events", ALERTS))


@query(f"WITH {ALT} SELECT id FROM a WHERE severity IN ('critical', 'warning') AND NOT acked AND updated >= TIMESTAMP '2024-01-05' AND category = 'system' AND contains(lower('=' || source || ' ' || detail || ' ' || source || ' ' || category || ' user ' || key || ' a ' || source), 'user 1') ORDER BY updated DESC, id LIMIT 500")
def alert_search(spark, sf_dir):
    return alerts.search(store(spark, sf_dir), "critical,warning", "user 1", "system", F.expr("timestamp '2024-01-05'"), True).select("id")


@query(f"""WITH {ALT} SELECT id, strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS time_first, severity, category, source, count, CASE WHEN acked THEN 'true' ELSE 'false' END AS acknowledged, '''=' || source AS title_en, detail AS detail_en, 'a=' || source || '; user=' || key AS fields FROM a""")
def alert_csv(spark, sf_dir):
    return alerts.csv_rows(store(spark, sf_dir)).select("id", "time_first", "severity", "category", "source", "count", "acknowledged", "title_en", "detail_en", "fields")


@query(f"""WITH {ALT}, s AS (SELECT *, sum(far) OVER (PARTITION BY key ORDER BY time, id) + 1 AS session FROM (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY key ORDER BY time, id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS far FROM a))
SELECT key, CAST(session AS BIGINT) AS session, CAST(sum(greatest(1, count)) AS BIGINT) AS count, bool_or(acked) AND count(*) = 1 AS acked FROM s GROUP BY key, session""")
def alert_fold_counts(spark, sf_dir):
    return alerts.fold(select(spark, sf_dir, "events", ALERTS), 12 * 3600).select("key", F.col("session").cast("long").alias("session"), "count", "acked")


RAW = {"app_id": "p_partkey", "display_name": "CASE p_partkey % 13 WHEN 0 THEN ' ' ELSE ' ' || p_name END", "version": "CAST(p_size AS STRING)", "publisher": "p_brand", "release_type": "CASE p_partkey % 7 WHEN 0 THEN 'Hotfix' ELSE '' END", "parent_key": "CASE p_partkey % 11 WHEN 0 THEN 'x' ELSE '' END", "system_component": "p_partkey % 5", "source": "CASE p_partkey % 17 WHEN 0 THEN 'dpkg' ELSE '' END", "windows_installer": "p_partkey % 3", "key_name": "p_type", "install_date": "CASE p_partkey % 2 WHEN 0 THEN '20240131' ELSE 'x' END"}


@query(f"""WITH {cte("r", "part", RAW)} SELECT app_id, trim(display_name) AS name, CASE WHEN source <> '' THEN 'package' WHEN release_type <> '' OR parent_key <> '' THEN 'update' WHEN system_component = 1 THEN 'system-component' ELSE 'app' END AS kind,
source = '' AND (release_type <> '' OR parent_key <> '' OR system_component = 1) AS hidden, CASE source WHEN '' THEN 'registry' ELSE source END AS source, windows_installer = 1 AS msi, CASE install_date WHEN 'x' THEN 'x' ELSE '2024-01-31' END AS install_date FROM r WHERE trim(display_name) <> ''""")
def app_catalogue(spark, sf_dir):
    return inventory.catalogued(select(spark, sf_dir, "part", RAW)).select("app_id", "name", "kind", "hidden", "source", "msi", "install_date")


@query("""SELECT spec, arg_min(CAST(p_size AS VARCHAR), p_partkey) AS installed FROM part JOIN (VALUES ('Red', 'red ', FALSE), ('Bolts', 'bolt', FALSE), ('Exact', 'small ring', TRUE)) v(spec, text, exact) ON CASE WHEN exact THEN p_name = text OR starts_with(p_name, text || ' version') ELSE contains(p_name, text) END GROUP BY spec""")
def manifest_apps(spark, sf_dir):
    apps = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"))
    return inventory.manifest_apps(apps, [("Red", "red ", False), ("Bolts", "bolt", False), ("Exact", "small ring", True)])


NEIGHBORS = "n AS (SELECT s_suppkey AS k, '10.0.' || (s_suppkey // 250) || '.' || (s_suppkey % 250) AS ip, lpad(to_hex(s_suppkey * 7919), 12, CASE s_suppkey % 3 WHEN 0 THEN '0' ELSE '1' END) AS mac, s_nationkey AS i FROM supplier)"


@query(f"""WITH {NEIGHBORS} SELECT k FROM n WHERE CAST('0x' || substr(mac, 1, 2) AS INTEGER) % 2 = 0""")
def device_filter(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    ip = F.concat_ws(".", F.lit("10.0"), F.floor(k / 250).cast("string"), (k % 250).cast("string"))
    mac = F.when(k % 3 == 0, F.lpad(F.hex(k * 7919), 12, "0")).otherwise(F.lpad(F.hex(k * 7919), 12, "1"))
    return inventory.eligible(s.select(k.alias("k"), ip.alias("ip"), mac.alias("mac"))).select("k")


@query("""WITH h AS (SELECT c_custkey AS ip, c_nationkey AS if_index FROM customer), n AS (SELECT s_suppkey AS ip, s_name AS mac FROM supplier), g AS (SELECT n_nationkey AS if_index, n_nationkey * 4 AS gateway FROM nation WHERE n_nationkey % 2 = 0)
SELECT h.ip, coalesce(n.mac, f.mac, 'seen ' || h.ip) AS mac, n.mac IS NOT NULL AS on_link FROM h LEFT JOIN n ON n.ip = h.ip LEFT JOIN g ON g.if_index = h.if_index LEFT JOIN n f ON f.ip = g.gateway""")
def attribution(spark, sf_dir):
    h = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ip"), F.col("c_nationkey").alias("if_index"), F.concat(F.lit("seen "), F.col("c_custkey").cast("string")).alias("incident_mac"))
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ip"), F.col("s_name").alias("mac"))
    g = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("if_index"), (F.col("n_nationkey") * 4).cast("long").alias("gateway"))
    return inventory.attributed(h, n, g).select("ip", "mac", "on_link")


@query("""WITH l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) SELECT user_id, round(avg(value), 6) AS mean, avg(value) >= 150 AS hot FROM l WHERE r <= 60 GROUP BY 1 HAVING avg(value) >= 0.05 ORDER BY avg(value) DESC, user_id LIMIT 10""")
def sustained_cpu(spark, sf_dir):
    return rates.sustained(table(spark, sf_dir, "events"), "user_id", "ts", "value", hot=150.0).withColumn("mean", F.round("mean", 6))


@query("SELECT DISTINCT p_brand FROM part")
def publishers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand").dropDuplicates()


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey % 100, p_partkey LIMIT 300")
def natural_page(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("label", F.concat(F.lit("Item"), (F.col("p_partkey") % 100).cast("string"), F.lit("x")))
    return p.orderBy(X.natural_key(F.col("label")), "p_partkey").limit(300).select("p_partkey", "p_name")


@query("""SELECT doc_id, md5(CASE WHEN octet_length(encode(t)) <= 200 THEN t ELSE decode(encode(t)[1 : CASE WHEN b(200) THEN 200 WHEN b(199) THEN 199 WHEN b(198) THEN 198 ELSE 197 END]) || '…' END) AS cut FROM (SELECT doc_id, text AS t FROM documents)""".replace("b(200)", "hex(encode(t)[201:201]) NOT BETWEEN '80' AND 'BF'").replace("b(199)", "hex(encode(t)[200:200]) NOT BETWEEN '80' AND 'BF'").replace("b(198)", "hex(encode(t)[199:199]) NOT BETWEEN '80' AND 'BF'"))
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.truncated(F.col("text"), 200).cast("binary")).alias("cut"))


VERSIONS = [("v1.2", "1.2", 0), ("< 2.0", "1.9", 1), ("1.1e5", "1.100000", 1), ("1..2", "1.2", 0), ("1_2", "1.2", 1), ("10.2", "9.9", 1), ("1.0.0", "1", 0), ("1.2", "1.2.1", -1), ("1.2-beta", "1.2-alpha", 1), ("2", "2.0.0.1", -1), ("1.a", "1", 1), ("007", "7", 0), ("99999999999999999999998", "99999999999999999999999", -1)]


@query("SELECT p_partkey, CASE p_partkey % " + str(len(VERSIONS)) + " " + " ".join(f"WHEN {k} THEN {c}" for k, (_, _, c) in enumerate(VERSIONS)) + " END AS cmp FROM part")
def version_cases(spark, sf_dir):
    pick = lambda j: F.element_at(F.array(*(F.lit(v[j]) for v in VERSIONS)), (F.col("p_partkey") % len(VERSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.compare_versions(pick(0), pick(1)).alias("cmp"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'ethernet' END WHEN 1 THEN 'wifi' WHEN 2 THEN 'loopback' ELSE 'other' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'LISTEN' WHEN 1 THEN 'ESTABLISHED' WHEN 2 THEN 'DELETE_TCB' ELSE 'UNKNOWN' END AS state,
CASE WHEN p_partkey % 4 = 0 THEN '-' WHEN p_partkey % 4 < 3 THEN array_to_string(['a', 'b'][1 : p_partkey % 4], ', ') ELSE 'a, b +1' END AS list FROM part""")
def code_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.interface_kind(pick(6, 71, 24, 99)).alias("kind"), X.tcp_state(pick(2, 5, 12, 77)).alias("state"), X.short_list(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), k.cast("int")), 2).alias("list"))



def _le(c):
    """Four bytes of a number, little-endian, in hexadecimal."""
    big = F.lpad(F.hex(c.cast("long")), 8, "0")
    return F.concat(*(F.substring(big, k, 2) for k in (7, 5, 3, 1)))


def _be(c, size: int):
    return F.lpad(F.hex(c.cast("long")), 2 * size, "0")


STATES = "[" + ", ".join(f"'{dims.TCP_STATES[k]}'" for k in range(1, 13)) + "]"


@query(f"""SELECT p_partkey, CAST(r AS INTEGER) AS row, coalesce({STATES}[(p_partkey + r) % 14], 'UNKNOWN') AS state, '10.0.' || p_partkey % 256 || '.' || r AS local_addr, (p_partkey * 7 + r) % 65536 AS local_port,
CASE WHEN (p_partkey + r) % 14 = 2 THEN '' ELSE '192.168.' || r || '.' || p_partkey % 256 END AS remote_addr, CASE WHEN (p_partkey + r) % 14 = 2 THEN 0 ELSE 443 + r END AS remote_port, p_partkey AS pid, NULL AS error
FROM (SELECT p_partkey, unnest(range(p_partkey % 3)) AS r FROM part WHERE p_partkey % 10 <> 9 OR p_partkey % 3 = 0)
UNION ALL SELECT p_partkey, 0, NULL, NULL, -1, NULL, -1, -1, 'table buffer truncated' FROM part WHERE p_partkey % 10 = 9 AND p_partkey % 3 > 0""")
def socket_table_rows(spark, sf_dir):
    k = F.col("p_partkey")
    row = lambda r: F.concat(_le((k + r) % 14), F.lit("0A00"), _be(k % 256, 1), _be(r, 1), _be((k * 7 + r) % 65536, 2), F.lit("0000C0A8"), _be(r, 1), _be(k % 256, 1), _be(443 + r, 2), F.lit("0000"), _le(k))
    rows = F.array_join(F.when(k % 3 > 0, F.transform(F.sequence(F.lit(0).cast("long"), k % 3 - 1), row)).otherwise(F.array().cast("array<string>")), "")
    whole = F.concat(_le(k % 3), rows)
    cut = F.when((k % 10 == 9) & (k % 3 > 0), F.substr(whole, F.lit(1), F.length(whole) - 4)).otherwise(whole)
    b = table(spark, sf_dir, "part").select("p_partkey", F.unhex(cut).alias("buf"))
    return binary.socket_rows(b, "TCP").drop("proto").na.fill(-1)


ADDRESSES = [("0" * 32, "::"), ("0" * 31 + "1", "::1"), ("20010DB8" + "0" * 16 + "00010000", "2001:db8::1:0"), ("FE80" + "0" * 12 + "0000000100020003", "fe80::1:2:3"), ("0001" + "0" * 12 + "0002" + "0" * 12, "1::2:0:0:0"), ("0" * 20 + "FFFF0A000001", "::ffff:10.0.0.1"), ("00010000000200000003000000040000", "1:0:2:0:3:0:4:0"), ("0" * 8 + "0001" + "0" * 4 + "0002" + "0" * 12, "0:0:1:0:2::"), ("20010DB800000000ABCD00000000000F", "2001:db8::abcd:0:0:f")]


@query(f"SELECT s_suppkey, 0 AS row, 'UDP6' AS proto, '-' AS state, [{', '.join(repr(t) for _, t in ADDRESSES)}][s_suppkey % {len(ADDRESSES)} + 1] AS local_addr, s_suppkey % 65536 AS local_port, '' AS remote_addr, 0 AS remote_port, s_suppkey * 3 AS pid, NULL AS error FROM supplier")
def address_texts(spark, sf_dir):
    k = F.col("s_suppkey")
    address = F.element_at(F.array(*(F.lit(h) for h, _ in ADDRESSES)), (k % len(ADDRESSES) + 1).cast("int"))
    b = table(spark, sf_dir, "supplier").select("s_suppkey", F.unhex(F.concat(F.lit("01000000"), address, F.lit("00000000"), _be(k % 65536, 2), F.lit("0000"), _le(k * 3))).alias("buf"))
    return binary.socket_rows(b, "UDP6")


@query("""SELECT p_partkey, 0 AS row, '10.9.0.' || p_partkey % 256 AS ip, CASE p_partkey % 7 WHEN 5 THEN 'AA-BB' ELSE 'AA-BB-CC-00-00-' || right('0' || hex(p_partkey % 256), 2) END AS mac, p_partkey % 20 AS if_index,
CASE p_partkey % 6 WHEN 3 THEN 'dynamic' WHEN 4 THEN 'static' ELSE 'other' END AS type, NULL AS error FROM part WHERE p_partkey % 6 <> 2 AND p_partkey % 7 NOT IN (0, 6)""")
def neighbor_table(spark, sf_dir):
    k = F.col("p_partkey")
    size = F.when(k % 7 == 0, 0).when(k % 7 == 5, 2).otherwise(6)
    mac = F.when(k % 7 == 6, "0" * 12).otherwise(F.concat(F.lit("AABBCC0000"), _be(k % 256, 1)))
    row = F.concat(_le(k % 20), _le(size), mac, F.lit("00000A0900"), _be(k % 256, 1), _le(k % 6))
    return binary.neighbor_rows(table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.concat(F.lit("01000000"), row)).alias("buf")))


@query("""SELECT event_id, '10.1.' || user_id % 256 || '.1' AS src, event_id % 65536 AS src_port, '10.0.0.1' AS dst, user_id % 1024 AS dst_port FROM events WHERE event_id % 8 < 2 AND event_id % 5 <> 4 AND event_id % 9 <> 8 AND event_id % 11 <> 10""")
def syn_packets(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id")
    flags = F.element_at(F.array(*map(F.lit, ["02", "C2", "12", "06", "10", "00", "01", "16"])), (k % 8 + 1).cast("int"))
    options = F.when(k % 2 == 0, "").otherwise("0" * 8)
    ip = F.concat(F.when(k % 2 == 0, "45").otherwise("46"), F.lit("0000280000"), F.when(k % 9 == 8, "0001").otherwise("4000"), F.lit("40"), F.when(k % 5 == 4, "11").otherwise("06"), F.lit("00000A01"), _be(u % 256, 1), F.lit("010A0000"), F.when(k % 11 == 10, "02").otherwise("01"), options)
    tcp = F.concat(_be(k % 65536, 2), _be(u % 1024, 2), F.lit("0" * 16 + "50"), flags)
    p = table(spark, sf_dir, "events").select("event_id", F.unhex(F.concat(ip, tcp)).alias("packet"))
    return binary.inbound_syns(p, F.lit("10.0.0.1"))


@query("""SELECT p_partkey, p_name AS name, 'Vendor.P' || p_partkey AS id, '1.' || p_partkey % 5 AS version, '1.' || p_partkey % 3 AS available, 'winget' AS source,
'winget upgrade --id Vendor.P' || p_partkey || ' --exact --silent --accept-package-agreements --accept-source-agreements --disable-interactivity' AS command FROM part WHERE p_partkey % 5 <> p_partkey % 3""")
def upgrade_tables(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    pad = lambda c, n: F.concat(c, F.repeat(F.lit(" "), F.greatest(n - F.length(c), F.lit(1))))
    line = lambda *c: F.concat(*(pad(x, n) for x, n in zip(c[:4], (14, 24, 9, 11), strict=True)), c[4])
    head = line(*map(F.lit, ("Name", "Id", "Version", "Available", "Source")))
    own = line(F.col("p_name"), F.concat(F.lit("Vendor.P"), k), F.concat(F.lit("1."), (F.col("p_partkey") % 5).cast("string")), F.concat(F.lit("1."), (F.col("p_partkey") % 3).cast("string")), F.lit("winget"))
    text = F.concat_ws("\r\n", F.lit("  - \r  \\ \r"), F.lit("████ 1 MB"), head, F.repeat(F.lit("-"), F.lit(60)), own, F.lit(""), F.lit("1 upgrades available."))
    return readers.table_upgrades(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'iPhone 14 Pro' WHEN 1 THEN 'Apple TV 4K (2nd generation)' ELSE 'iPhone15,9' END AS model, CASE WHEN s_suppkey % 4 = 0 THEN s_name WHEN s_suppkey % 5 = 0 THEN 'tv' || s_nationkey WHEN s_suppkey % 7 <> 0 THEN 'host' || s_suppkey END AS name,
CASE WHEN s_suppkey % 4 = 0 THEN 'netbios' WHEN s_suppkey % 5 = 0 THEN 'ssdp' WHEN s_suppkey % 7 <> 0 THEN 'dns' END AS source FROM supplier""")
def device_names(spark, sf_dir):
    k = F.col("s_suppkey")
    code = F.when(k % 3 == 0, "iPhone15,2").when(k % 3 == 1, "AppleTV11,1").otherwise("iPhone15,9")
    names = F.create_map(F.lit("dns"), F.when(k % 7 != 0, F.concat(F.lit("host"), k.cast("string"))), F.lit("ssdp"), F.when(k % 5 == 0, F.concat(F.lit("tv"), F.col("s_nationkey").cast("string"))).otherwise(""), F.lit("netbios"), F.when(k % 4 == 0, F.col("s_name")))
    return table(spark, sf_dir, "supplier").withColumn("p", X.preferred_name(names)).select("s_suppkey", X.model_name(code).alias("model"), "p.name", "p.source")


assert QUERIES and SQL
