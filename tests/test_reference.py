import glob
import json
import os
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from wardline.functions import scalars as X
from wardline.operators import alerts, audit, events, health, inventory, radar, rates, rules, snapshots, tree
from wardline.plans import host, queries
from wardline.sources import binary, readers
from wardline.streaming import stateful

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


assert host


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    a, b = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).fetchdf()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda x: sorted((tuple("" if pd.isna(v) else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in x[columns].itertuples(index=False)), key=str)
    assert rows(a) == rows(b)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def observed(spark, rows):
    return spark.createDataFrame(rows, "ip string, port int, ts timestamp")


def test_sweep_threshold(spark):
    ten = [("a", p, at(p / 10)) for p in range(1, 11)] + [("a", 5, at(1.15))]
    assert radar.incidents(observed(spark, ten)).count() == 0
    more = [*ten, ("a", 11, at(1.3)), ("a", 443, at(1.4))]
    (i,) = radar.incidents(observed(spark, more)).select("ports", "attempts", radar.port_text(F.col("port_list")).alias("text")).collect()
    assert (i.ports, i.attempts, i.text) == (12, 13, "1-11, 443")
    assert radar.incidents(observed(spark, [("a", p, at(p)) for p in range(1, 31)])).count() == 0


def test_sweep_cooldown(spark):
    rows = [("a", p, at(p / 10)) for p in range(20)] + [("a", p, at(14 + p / 10)) for p in range(15)]
    got = radar.incidents(observed(spark, rows), cooldown_seconds=10).orderBy("first_seen").collect()
    assert [i.attempts for i in got] == [20, 15]


def test_port_text(spark):
    text = lambda p, n=12: one(spark, radar.port_text(F.array(*map(F.lit, p)), n))
    assert text([21, 22, 23, 80, 443]) == "21-23, 80, 443"
    assert text([1, 3, 5, 7, 9], 3) == "1, 3, 5 (+2 more)"


def test_ignored_addresses(spark):
    got = {ip: one(spark, X.ignored_ip(F.lit(ip))) for ip in ("127.0.0.1", "::1", "0.0.0.0", "224.0.0.251", "192.168.1.200", "nonsense!")}
    assert got == {"127.0.0.1": True, "::1": True, "0.0.0.0": True, "224.0.0.251": True, "192.168.1.200": False, "nonsense!": True}


RULE = {"id": "r", "metric": "cpu", "op": ">", "threshold": 85.0, "for_sec": 30, "severity": "warning"}


def run(values, rule=RULE):
    rule, state, out = rules.validated(rule), (None, False), []
    for ts, v in values:
        state, event = rules.step(state, ts, v, rule)
        if event:
            out.append((ts, event))
    return out


def test_rule_sustain_and_hysteresis():
    assert run([(t, 95.0) for t in range(32)]) == [(30, "fired")]
    assert run([(t, 95.0) for t in range(31)] + [(31, 83.0), (32, 70.0)])[1:] == [(32, "resolved")]
    assert run([(0, 95.0), (1, None), (2, 95.0), (31, 95.0)]) == []
    for bad in ({"metric": "x"}, {"threshold": 150.0}, {"scope": "a"}, {"op": "="}, {"for_sec": 4000}):
        assert rules.validated(RULE | bad) is None
    assert len(rules.load("[]")) == 9


def test_globs(spark):
    for scope, name, want in (("", "x", True), ("C:\\", "c:\\", True), ("wi-fi,ethernet*", "Ethernet 2", True), ("svchost.exe", "chrome.exe", False), ("a*", "a/b", False), ("[ab]?", "b1", True), (" ", "x", False), ("a,,b", "", False), ("a[", "a[", True), ("x*,", "y", False)):
        assert one(spark, X.in_scope(F.lit(name), scope)) == want, scope


def firing_rows(spark):
    rows = [("proc_cpu", f"p{k}", at(t), 90.0 if (t // (5 + k)) % 2 == 0 else 10.0) for k in range(3) for t in range(40) if t != 17 or k]
    rule = [{"id": "hot", "metric": "proc_cpu", "op": ">", "threshold": 50.0, "for_sec": 3, "scope": "p*"}]
    return rows, rule


def test_batch_rules_equal_the_step(spark):
    rows, rule = firing_rows(spark)
    df = spark.createDataFrame(rows, "metric string, instance string, ts timestamp, value double")
    got = sorted((r.instance, r.ts, r.event) for r in rules.evaluate(df, rule).collect())
    want = []
    for k in range(3):
        own = {ts: v for m, i, ts, v in rows if i == f"p{k}"}
        want += [(f"p{k}", at(t), e) for t, e in run([(t, own.get(at(t))) for t in range(40)], rule[0])]
    assert got == sorted(want) and want


def test_streamed_rules_equal_batch(spark, tmp_path):
    rows, rule = firing_rows(spark)
    rows = [r for r in rows if r[1] != "p0"]
    df = spark.createDataFrame(rows, "metric string, instance string, ts timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.rule_events(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rule)
    q = stream.writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    q.stop()
    key = lambda d: sorted((r.instance, r.ts, r.event) for r in d.collect())
    assert key(spark.table("fired")) == key(rules.evaluate(df, rule)) != []


def test_streamed_rules_keep_to_their_scope(spark, tmp_path):
    rows, rule = firing_rows(spark)
    rule = [rule[0] | {"scope": "p1"}, rule[0] | {"id": "off", "enabled": False}]
    df = spark.createDataFrame([r for r in rows if r[1] != "p0"], "metric string, instance string, ts timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.rule_events(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rule)
    q = stream.writeStream.format("memory").queryName("scoped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    q.stop()
    got = spark.table("scoped").collect()
    assert {(r.rule_id, r.instance) for r in got} == {("hot", "p1")} and len(got) == rules.evaluate(df, rule).count()


def test_streamed_sweeps_equal_batch(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows, t = [], 0.0
    for _ in range(400):
        t += 70.0 if rng.random() < 0.03 else rng.choice([0.1, 0.2, 0.3, 0.9])
        rows.append((rng.choice("ab"), rng.randrange(40), at(round(t, 1))))
    df = spark.createDataFrame(rows, "ip string, port int, ts timestamp")
    half = len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:], [("z", 1, at(t + 5000))], [("z", 1, at(t + 5001))])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = stateful.sweep_incidents(source, threshold=5).writeStream.format("memory").queryName("sweeps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    q.stop()
    got = {(r.ip, r.first_seen, r.last_seen, r.attempts, r.ports, r.peak) for r in spark.table("sweeps").where("closed").collect()}
    want = {(r.ip, r.first_seen, r.last_seen, r.attempts, r.ports, r.peak) for r in radar.incidents(df, 5, 5).collect()}
    assert (got - want, want - got) == (set(), set()) and len(want) > 3


def test_streamed_folding(spark, tmp_path):
    rows = [("a", at(0), "info"), ("a", at(30), "critical"), ("a", at(2000), "info"), ("b", at(5), "warning"), ("z", at(90_000), "info")]
    df = spark.createDataFrame(rows, "key string, time timestamp, severity string")
    for k, r in enumerate(rows):
        spark.createDataFrame([r], df.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in/*"))
    q = stateful.folded_alerts(source).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    q.stop()
    got = sorted((r.key, r["count"], r["rank"]) for r in spark.table("folded").collect())
    assert got == [("a", 1, 2), ("a", 2, 0), ("b", 1, 1)]


def test_snapshot_diff_and_names(spark):
    a = spark.createDataFrame([("k1", "LISTEN"), ("k2", "SYN"), ("k3", "EST")], "k string, s string")
    b = spark.createDataFrame([("k1", "LISTEN"), ("k2", "EST"), ("k4", "EST"), ("k5", "EST")], "k string, s string")
    assert sorted(r.change for r in snapshots.diff(a, b, ["k"], "s").collect()) == ["added", "added", "changed", "removed"]
    sockets = spark.createDataFrame([(0,), (4,), (7,), (8,), (9,)], "pid long")
    names = spark.createDataFrame([(7, "x.exe", ""), (8, "", "C:\\d\\y.exe")], "pid long, name string, path string")
    assert {r.pid: r.process_name for r in snapshots.with_names(sockets, names).collect()} == {0: "System Idle", 4: "System", 7: "x.exe", 8: "y.exe", 9: "pid 9"}


def test_rates_and_scalars(spark):
    c = spark.createDataFrame([("e", at(0), 0), ("e", at(2), 2_000_000), ("e", at(4), 5)], "i string, ts timestamp, o long")
    assert [r.o_rate for r in rates.rates(c, ["i"], "ts", ["o"]).orderBy("ts").collect()] == [0.0, 1_000_000.0, 0.0]
    assert one(spark, X.utilisation(F.lit(1e6), F.lit(0.0), F.lit(8e6))) == 100
    assert one(spark, X.cpu_percent(F.lit(3.0), F.lit(6.0), F.lit(4.0))) == 70
    assert [one(spark, X.stop_code(F.lit(x))) for x in ("0x0000009f (…)", "159", "0x124", " 0x000000D1,", "", "0", "abc", "0x")] == [159, 159, 292, 209, None, None, None, None]
    assert one(spark, X.stop_name(F.lit(0x9F))) == "0x0000009F DRIVER_POWER_STATE_FAILURE"
    assert one(spark, X.truncated(F.lit("aéb"), 2)) == "a…"
    for a, b, want in (("1.2", "1.10", -1), ("2.0", "2", 0), ("1.0b", "1.0a", 1), ("10", "9.9", 1), ("v1.2", "1.2", 0), ("1.1e5", "1.100000", 1), ("1..2", "1.2", 0), ("1_2", "1.2", 1)):
        assert one(spark, X.compare_versions(F.lit(a), F.lit(b))) == want
    assert one(spark, X.csv_safe(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, X.looks_outbound(F.lit(50000), F.lit(443))) and not one(spark, X.looks_outbound(F.lit(445), F.lit(50000)))


def test_audits(spark, tmp_path):
    def ev(k, i, t, **data):
        return ("Security", k, i, 2, "p", at(t), "", data)

    rows = [ev(k, 4625, k * 20, TargetUserName="bob", IpAddress="10.0.0.9") for k in range(25)]
    rows += [ev(100 + k, 4625, 9000 + 700 * k, TargetUserName=f"u{k}", IpAddress="10.0.0.7") for k in range(6)]
    rows += [ev(200, 4625, 5, TargetUserName="me"), ev(201, 4740, 6, TargetUserName="me"), ev(202, 4672, 7, SubjectUserName="ann"), ev(203, 4672, 8, SubjectUserName="bob"), ev(204, 4672, 9, SubjectUserName="SYSTEM"), ev(205, 4672, 9, SubjectUserName="PC$")]
    df = spark.createDataFrame(rows, "channel string, record_id long, event_id long, level int, provider string, time timestamp, message string, data map<string,string>")
    findings = audit.authentication(df).orderBy("id").collect()
    got = [(r.id, r.kind, r.severity, r.subject, r["count"]) for r in findings]
    assert got[0] == ("AUT-001", "failed-logon", "critical", "bob", 25)
    assert findings[0].details["sourceIp"] == "10.0.0.9" and findings[0].details["burst10m"] == "25" and len(findings[0].samples) == 5
    assert findings[0].samples[0] == "2024-01-01 00:08:00Z — bob from 10.0.0.9 — no reason recorded"
    audit.write_csv(audit.authentication(df), f"{tmp_path}/audit.csv")
    text = open(f"{tmp_path}/audit.csv", "rb").read().decode()
    assert text.startswith("\ufeffid,severity,kind") and "AUT-001,critical,failed-logon,bob,4625,25," in text
    kinds = [(k, s) for _, k, s, _, _ in got]
    assert ("password-spray", "critical") in kinds and ("account-lockout", "warning") in kinds
    assert {(s, sub, n) for _, k, s, sub, n in got if k == "privileged-logon"} == {("warning", "bob", 1), ("info", "ann", 1), ("info", "built-in service accounts", 2)}

    def rel(k, provider, i, t, **data):
        return ("System", k, i, 2, provider, at(t), "", data)

    rows = [rel(k, "Service Control Manager", 7031, k, param1="Spooler") for k in range(3)]
    rows += [rel(10 + k, "Application Error", 1000, k, AppName="A.exe", ModuleName="ntdll.dll") for k in range(2)] + [rel(12, "Application Error", 1000, 1, AppName="B.exe"), rel(13, "Application Hang", 1002, 1, AppName="C.exe")]
    rows += [rel(20, "Microsoft-Windows-Kernel-Power", 41, 5, BugcheckCode="159"), rel(21, "BugCheck", 1001, 9, param1="0x0000009f (x)"), rel(22, "Microsoft-Windows-Kernel-Power", 41, 1000, BugcheckCode="0"), rel(23, "EventLog", 6008, 1100)]
    got = {(r.kind, r.severity, r.subject, r["count"]) for r in audit.reliability(spark.createDataFrame(rows, df.schema)).collect()}
    assert got == {("service-crash", "critical", "Spooler", 3), ("app-fault", "warning", "A.exe", 2), ("app-fault", "info", "B.exe", 1), ("app-hang", "info", "C.exe", 1), ("bugcheck", "critical", "0x0000009F DRIVER_POWER_STATE_FAILURE", 2), ("unexpected-shutdown", "warning", "System", 1)}


def test_event_xml_and_classes(spark):
    xml = "<Event xmlns='http://x'><System><Provider Name='Service Control Manager'/><EventID>7031</EventID><Level>2</Level><EventRecordID>5</EventRecordID><Channel>System</Channel><Computer>pc</Computer><TimeCreated SystemTime='2024-01-01T00:00:00.123456Z'/></System><EventData><Data Name='param1'>Print Spooler</Data><Data>1</Data></EventData></Event>"
    e = readers.events_from_xml(spark.createDataFrame([(xml,)], "xml string")).withColumn("c", events.category(F.col("provider"), F.col("event_id"), F.col("level"))).first()
    assert e.data == {"param1": "Print Spooler", "#0": "Print Spooler", "#1": "1"} and e.c == "service-crash" and e.event_id == 7031


def test_inventory_and_vendors(spark):
    registry = spark.createDataFrame([("AABBCC", "Apple, Inc."), ("8C1F64D0F", "Small Co.,Ltd."), ("C85CE27", "Mid GmbH"), ("8C1F64", "IEEE")], "prefix string, organisation string")
    macs = ["aa:bb:cc:00:00:01", "8C-1F-64-D0-F1-23", "C85C.E271.0000", "02:00:00:00:00:01", "FF:FF:FF:FF:FF:FF", "junk"]
    got = {r.mac: r.vendor for r in inventory.vendors(spark.createDataFrame([(m,) for m in macs], "mac string"), registry).collect()}
    assert got == {macs[0]: "Random", macs[1]: "Small Co.,Ltd.", macs[2]: "Mid GmbH", macs[3]: "Random", macs[4]: None, macs[5]: None}
    apps = spark.createDataFrame([(1, "Foo", "1", "user", False), (2, "foo", "1", "machine", True), (3, "Bar", "2", "user-x86", True), (4, "bar", "2", "machine", False)], "k int, name string, version string, scope string, hidden boolean")
    assert {(r.k, r.hidden) for r in inventory.deduplicated(apps, "k").collect()} == {(2, False), (3, True)}


def test_tree_and_health(spark):
    p = spark.createDataFrame([(5000, 1, 10), (5100, 5000, 20), (5200, 5100, 30), (9000, 5000, 5), (0, 0, 0)], "pid long, ppid long, started long")
    got = {r.pid: r.parent for r in tree.parents(p).collect()}
    assert got == {5000: None, 5100: 5000, 5200: 5100, 9000: None, 0: None}
    nodes = spark.createDataFrame([("a", None, 1.0), ("b", "a", 2.0), ("c", "b", 4.0)], "id string, parent string, value double")
    assert {(r.id, r.depth, r.subtree, r.descendants) for r in tree.rollup(nodes).collect()} == {("a", 0, 7.0, 2), ("b", 1, 6.0, 1), ("c", 2, 4.0, 0)}
    i = spark.createDataFrame([(95.0, 50.0, 0.0, 99.0, 1, 2, 0, 0)], [f[0] for f in health.FACTORS])
    assert health.score(i).first().score == 100 - 15 - 20 - 8 - 3


def test_alert_search_and_csv(spark, tmp_path):
    schema = "id long, key string, time timestamp, updated timestamp, severity string, category string, title struct<en:string,ar:string>, detail struct<en:string,ar:string>, source string, fields map<string,string>, count int, acked boolean"
    rows = [(1, "k", at(0), at(0), "critical", "network", ("Sweep", "مسح"), ("=x", ""), "radar", {"ip": "10.0.0.1", "a": "b"}, 1, False), (2, "k", at(1), at(1), "info", "system", ("Other", ""), ("d", ""), "s", {}, 1, True)]
    df = spark.createDataFrame(rows, schema)
    assert [r.id for r in alerts.search(df, "critical,warning", "10.0.0").collect()] == [1]
    assert [r.id for r in alerts.search(df, text="مسح").collect()] == [1] and alerts.search(df, unacked=True).count() == 1
    r = alerts.csv_rows(df).where("id = 1").first()
    assert (r.detail_en, r.fields, r.time_first) == ("'=x", "a=b; ip=10.0.0.1", "2024-01-01T00:00:00Z")
    alerts.write_csv(df, f"{tmp_path}/a.csv")
    lines = open(f"{tmp_path}/a.csv", encoding="utf-8").read().split("\n")
    assert lines[0] == "\ufeff" + ",".join(alerts.CSV_HEADER) and lines[1].startswith("2,2024-01-01T00:00:01Z") and len(lines) == 4
    made = json.loads(alerts.report(df, F.lit(at(5)), "pc").first().report)
    assert made["counts"]["unacked"] == 1 and [a["id"] for a in made["alerts"]] == [2, 1] and made["host"] == "pc"
    assert alerts.acknowledged(df, [1]).where("acked").count() == 2 and alerts.by_category(df).count() == 2
    change = spark.createDataFrame([("k", ("back", ""), {"resolved": "yes"})], "key string, detail struct<en:string,ar:string>, fields map<string,string>")
    got = {r.id: r.fields for r in alerts.updated(df, change).collect()}
    assert got == {1: {"ip": "10.0.0.1", "a": "b"}, 2: {"resolved": "yes"}}


def test_folding_keeps_what_alerts_bring(spark):
    schema = "id long, key string, time timestamp, severity string, detail string, title string, fields map<string,string>, count int, acked boolean"
    rows = [(1, "k", at(0), "info", "d1", "T", {"a": "1"}, 3, True), (2, "k", at(30), "critical", "d2", "", None, 0, True), (3, None, at(31), "info", "d3", "", None, None, True), (4, None, at(32), "info", "d4", "", None, 1, False), (5, "k", at(700), "info", "d5", "U", None, 1, True)]
    got = sorted((r.key or "", r.time, r["count"], r.severity, r.detail, r.title, r.fields, r.acked) for r in alerts.fold(spark.createDataFrame(rows, schema)).collect())
    assert got == [("", at(31), 1, "info", "d3", None, None, True), ("", at(32), 1, "info", "d4", None, None, False), ("k", at(0), 4, "critical", "d2", "T", {"a": "1"}, False), ("k", at(700), 1, "info", "d5", "U", None, True)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "dev").write_text("Inter-| x\n face |y\n  eth0: 9876543 10 1 2 0 0 0 0 1234567 20 3 4 0 0 0 0\n lo: 1 2\n")
    r = readers.interfaces(spark, str(tmp_path / "dev")).collect()
    assert [(x.name, x.in_octets, x.out_octets, x.errors, x.discards) for x in r] == [("eth0", 9876543, 1234567, 4, 6)]
    (tmp_path / "tcp").write_text("  sl local\n   0: 0100007F:1F90 00000000:0000 0A 0:0 0:0 0 0 0 123 1\n")
    (s,) = readers.sockets(spark, str(tmp_path / "tcp")).collect()
    assert (s.local_addr, s.local_port, s.remote_addr, s.state) == ("127.0.0.1", 8080, "0.0.0.0", 10)
    (tmp_path / "apt").write_text("Listing...\nvim/jammy 2:9.0 amd64 [upgradable from: 2:8.2]\n")
    assert [tuple(x) for x in readers.apt_upgrades(spark, str(tmp_path / "apt")).collect()] == [("vim", "2:9.0", "2:8.2")]
    (tmp_path / "j").write_text('{"__REALTIME_TIMESTAMP":"1704067200000000","PRIORITY":"3","SYSLOG_IDENTIFIER":"sshd","_PID":"123456","MESSAGE":"m"}\n')
    j = readers.journal(spark, str(tmp_path / "j")).first()
    assert (j.level, j.provider, j.event_id, j.time) == (2, "sshd", 23456, T0)


def test_table_sensor(spark):
    rows = [("TCP", "ESTABLISHED", "10.0.0.5", 445, "10.0.0.9", 50001, 4, "System"), ("TCP", "ESTABLISHED", "10.0.0.5", 3389, "10.0.0.9", 50002, 900, "svchost.exe"), ("TCP", "SYN_RECEIVED", "10.0.0.5", 7777, "10.0.0.9", 50003, 1, "x"), ("TCP", "ESTABLISHED", "10.0.0.5", 51500, "1.2.3.4", 443, 777, "app.exe"), ("TCP", "ESTABLISHED", "10.0.0.5", 445, "10.0.0.9", 50004, 4, "CHROME.exe"), ("UDP", "-", "10.0.0.5", 445, "10.0.0.9", 1, 4, ""), ("TCP", "LISTEN", "0.0.0.0", 445, "", 0, 4, "")]
    added = spark.createDataFrame(rows, "proto string, state string, local_addr string, local_port int, remote_addr string, remote_port int, pid long, process_name string")
    heard = spark.createDataFrame([("TCP", 445, "0.0.0.0", 4), ("TCP", 3389, "", 900), ("TCP", 51500, "127.0.0.1", 777), ("TCP", 9, "*", 1)], "proto string, port int, addr string, pid long")
    assert sorted(r.local_port for r in snapshots.table_observations(added, heard).collect()) == [445, 3389, 7777]


def test_deep_and_cyclic_trees(spark):
    rows = [(k, k - 1 if k else None, 1.0) for k in range(3000)] + [(10_000, 10_001, 1.0), (10_001, 10_000, 1.0), (10_002, 10_001, 1.0), (20_000, 77_777, 5.0)]
    got = {r.id: (r.depth, r.subtree, r.descendants) for r in tree.rollup(spark.createDataFrame(rows, "id long, parent long, value double")).collect()}
    assert got == {k: (k, 3000.0 - k, 2999 - k) for k in range(3000)} | {20_000: (0, 5.0, 0)}


def test_more_scalars(spark):
    good = ["1.2.3.4", "::", "::1", "fe80::1", "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1"]
    bad = ["1.2.3", "256.1.1.1", "1:2:3", ":::", "1::2::3", "g::1", "1:2:3:4:5:6:7:8:9", "", "12345::"]
    got = {r.ip: (r.v, r.k) for r in spark.createDataFrame([(x,) for x in good + bad], "ip string").select("ip", X.valid_ip(F.col("ip")).alias("v"), X.ip_key(F.col("ip")).alias("k")).collect()}
    assert all(got[x][0] for x in good) and not any(got[x][0] for x in bad)
    assert got["::ffff:10.0.0.1"][1] == "0" * 20 + "ffff0a000001" and got["fe80::1"][1] == "fe80" + "0" * 27 + "1"
    assert one(spark, X.ignored_ip(F.lit("10.0.0.1"), ["10.0.0.1"])) and not one(spark, X.ignored_ip(F.lit("10.0.0.1")))
    for q, text, want in (("", "x", 1.0), ("fire", "Firefox", 1200 - 0.07), ("fox", "Firefox", 1000 - 4 - 0.07), ("fx", "firefox", 4.0), ("zz", "firefox", 0.0), ("fir", "f.irx", 7.0)):
        assert one(spark, X.fuzzy_score(q, F.lit(text))) == pytest.approx(want), (q, text)
    assert one(spark, X.status_code(F.create_map(F.lit("SubStatus"), F.lit("0x0"), F.lit("Status"), F.lit("0xC000006A")))) == "0xc000006a"
    assert one(spark, X.mac_text(F.lit("AABBCCDDEEFF"))) == "AA-BB-CC-DD-EE-FF"
    assert one(spark, X.account(F.lit(""), F.lit("D"))) == "D\\(empty)" and one(spark, X.reverse_name(F.lit("1.2.3.4"))) == "4.3.2.1.in-addr.arpa"
    assert one(spark, X.later_version(F.lit("Version 1.9"), F.lit("v1.10.2"))) and not one(spark, X.later_version(F.lit("2.0"), F.lit("2.0.0")))
    assert one(spark, rules.plain_value(F.lit(85.0), F.lit("%"))) == "85%" and one(spark, rules.plain_value(F.lit(1.25), F.lit("MB"))) == "1.3 MB"
    assert events.xpath([41, 6008], window_ms=5) == "*[System[(EventID=41 or EventID=6008) and TimeCreated[timediff(@SystemTime) <= 5]]]"
    for size, want in ((1, "…"), (2, "…"), (3, "€…"), (4, "€…"), (6, "€€")):
        assert one(spark, X.truncated(F.lit("€€"), size)) == want


def test_rules_are_saved_whole(tmp_path):
    path = tmp_path / "rules.json"
    rules.save([RULE], str(path))
    assert rules.load(path.read_text()) == [rules.validated(RULE)] and [p.name for p in tmp_path.iterdir()] == ["rules.json"]


def test_self_test_is_seen(spark):
    found = radar.incidents(radar.self_test(spark, 5, start=F.lit(T0)))
    assert [(r.ip, r.ports) for r in found.collect()] == [("198.51.100.77", 24)]


def test_devices_expire_and_keep_when_their_mac_changed(spark):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    rows = [(1, "a", "m1", at(0)), (2, "a", "m2", at(20)), (3, "a", "m2", at(50)), (4, "b", "m3", at(1)), (5, "c", None, at(40)), (6, "c", None, at(45))]
    seen = spark.createDataFrame(rows, "id long, ip string, mac string, ts timestamp")
    found = {r.ip: (r.mac, r.first_seen, r.last_seen, r.mac_since) for r in inventory.devices(seen, F.lit(at(55)), 1800).collect()}
    assert found == {"a": ("m2", at(0), at(50), at(20)), "c": (None, at(40), at(45), at(40))}
    assert inventory.devices(seen.limit(0), F.lit(at(55))).count() == 0


def test_short_and_empty_buffers(spark):
    rows = [(1, b""), (2, None), (3, bytes(4)), (4, b"\x01\0\0\0" + bytes(11)), (5, b"\x01\0\0\0" + bytes([10, 0, 0, 1, 0, 53, 0, 0, 7, 0, 0, 0])), (6, b"\xff\xff\xff\xff" + bytes(40))]
    df = spark.createDataFrame(rows, "id int, buf binary")
    got = {r.id: r for r in binary.socket_rows(df, "UDP").collect()}
    assert sorted(got) == [1, 2, 4, 5, 6] and all(got[k].error and got[k].pid is None for k in (1, 2, 4, 6))
    assert (got[5].local_addr, got[5].local_port, got[5].pid, got[5].state, got[5].error) == ("10.0.0.1", 53, 7, "-", None)
    assert {r.id for r in binary.neighbor_rows(df).collect() if r.error} == {1, 2, 4, 5, 6}
    assert binary.inbound_syns(df.withColumnRenamed("buf", "packet")).count() == 0


def test_upgrade_tables_that_do_not_fit(spark):
    head = "Name       Id        Version  Available Source"
    lines = ["Ünïcode α  A.One     1.0      2.0       winget", "A name far too long for it B.Two 1.0 < 2 winget", "A name far too long for it B.Three 1.0 1.1 msstore", "Same       C.Four    3        3         winget", "Odd        D.Five    Unknown  4.1       winget", "Bad        -x        1        2         winget", "Else       E.Six     1        2         other"]
    texts = ["\n".join([head, "-" * 12, *lines, "2 upgrades available."]), "nothing here", "", None, "Name Id\n----------\na b", head.replace(" Source", "") + "\n" + "-" * 10 + "\nApp        F.Seven   1        2", "-" * 20]
    got = readers.table_upgrades(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()
    assert sorted((r.k, r.name, r.id, r.version, r.available, r.source) for r in got) == [(0, "A name far too long for it", "B.Three", "1.0", "1.1", "msstore"), (0, "Odd", "D.Five", "Unknown", "4.1", "winget"), (0, "Ünïcode α", "A.One", "1.0", "2.0", "winget"), (5, "App", "F.Seven", "1", "2", "")]
    assert all(r.command.startswith(f"winget upgrade --id {r.id} --exact --silent") for r in got)


def test_upgrade_tables_read_their_lines_once(spark):
    texts = spark.createDataFrame([(1, "Name  Id  Version  Available\n----------\nApp   A.One 1    2")], "k int, text string")
    plan = readers.table_upgrades(texts.select("k", F.concat_ws("", F.lit("\r"), "text").alias("text"))).where("k > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") == 1, plan.count("replace(")


def test_upgrade_columns_begin_at_words(spark):
    heads = ["Name Id Version Available Source", "  a  b\tc   Ünï 😀 e f g h", "a", "a  b ", "x" * 3000 + " " * 3000 + "y z", ""]
    begin = lambda h: [i + 1 for i in range(len(h)) if h[i] != " " and (i == 0 or h[i - 1] == " ")][:6]
    got = spark.createDataFrame(list(enumerate(heads)), "k int, h string").select("k", readers._starts(F.col("h")).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: begin(h) for k, h in enumerate(heads)}
    wide = "Name" + " " * 5000 + "Id" + " " * 5000 + "Version Available Source Other More"
    row = "App".ljust(5004) + "A.One".ljust(5002) + "1.0     2.0       winget what else"
    u = readers.table_upgrades(spark.createDataFrame([(wide + "\n" + "-" * 10 + "\n" + row,)], "text string")).collect()
    assert [tuple(r)[:5] for r in u] == [("App", "A.One", "1.0", "2.0", "winget")]
