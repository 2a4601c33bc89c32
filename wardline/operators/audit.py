"""Authentication and reliability audits: groups of events become findings with a severity."""

from __future__ import annotations

import csv
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import dims
from wardline.functions.scalars import account, csv_safe, detail_text, exception_text, first_field, logon_types, norm_hex, or_dash, reasons, severity_rank, status_code, stop_code, stop_name
from wardline.operators.lineage import cut
from wardline.operators.rates import max_burst, sessions

LOCAL_SOURCES = ["", "127.0.0.1", "::1", "-"]
SAMPLES = 5
COLUMNS = ["kind", "severity", "subject", "count", "first", "last", "event_ids", "details", "samples", "reason"]
CSV_HEADER = ["id", "severity", "kind", "subject", "event_ids", "count", "first_seen", "last_seen", "reason", "details"]


def builtin(user: Column, domain: Column) -> Column:
    u = F.upper(user)
    return u.isin(dims.BUILTIN_USERS) | u.endswith("$") | u.startswith("DWM-") | u.startswith("UMFD-") | F.upper(F.coalesce(domain, F.lit(""))).isin(dims.BUILTIN_DOMAINS)


def local_source(source: Column) -> Column:
    return F.coalesce(source, F.lit("")).isin(LOCAL_SOURCES)


def numbered(rows: DataFrame, order: list, name: str, prefix: str, digits: int) -> DataFrame:
    """``name``: prefix and place in the order. Places come from sorted ranges and the sizes of those before, not from one task."""
    # Ranges are sampled first, from a table, so that ``rows`` is made once.
    own = cut(cut(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = own.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_b"))
    out = own.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return out.withColumn(name, F.format_string(f"{prefix}%0{digits}d", inside + F.col("_b") + 1)).drop("_m", "_p", "_b")


def _group(rows: DataFrame, key: list[str], kind: str, subject: Column, notes: dict[str, Column], sample: Column | None = None) -> DataFrame:
    """Findings of ``rows`` by ``key``: count, first and last time, event ids, the subject as it came last, sorted distinct notes as
    arrays, and the newest samples."""
    newest = F.struct("time", "record_id")
    sets = [F.sort_array(F.collect_set(F.nullif(c, F.lit("")))).alias("n_" + k) for k, c in notes.items()]
    out = rows.groupBy(*key).agg(F.count("*").alias("count"), F.min("time").alias("first"), F.max("time").alias("last"), F.sort_array(F.collect_set("event_id")).alias("event_ids"), F.max_by(subject, newest).alias("subject"), *sets)
    if sample is None:
        out = out.withColumn("samples", F.array().cast("array<string>"))
    else:
        text = F.concat(F.date_format("time", "yyyy-MM-dd HH:mm:ss'Z'"), F.lit(" — "), sample)
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("time"), F.desc("record_id")))
        few = rows.withColumn("_t", text).where(sample != "").withColumn("_k", place).where(F.col("_k") <= SAMPLES)
        few = few.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_t"))), lambda x: x["_t"]).alias("samples"))
        out = out.join(few, key, "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), detail_text(F.col("n_" + k)).alias("value")) for k in notes)) if notes else F.array().cast("array<struct<key:string,value:string>>")
    return out.withColumns({"kind": F.lit(kind), "details": F.map_from_entries(F.filter(pairs, lambda p: p["value"] != "")), "reason": F.lit("")})


def finalised(parts: list[DataFrame], prefix: str) -> DataFrame:
    """Findings by severity, count, last, subject and kind, numbered."""
    all_ = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])
    return numbered(all_, [severity_rank(F.col("severity")), F.desc("count"), F.desc("last"), "subject", "kind"], "id", prefix + "-", 3)


def report(events: DataFrame, findings: DataFrame, ids: list[int]) -> DataFrame:
    """(part, name, n): the events scanned, by event id, and findings by severity, none missing."""
    own = events.where(F.col("event_id").isin(ids))
    scanned = own.agg(F.lit("scanned").alias("part"), F.lit("").alias("name"), F.count("*").alias("n"))
    by_id = own.groupBy(F.lit("event_id").alias("part"), F.col("event_id").cast("string").alias("name")).agg(F.count("*").alias("n"))
    by_severity = findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES)).select(F.explode(F.create_map(*(x for s in dims.SEVERITIES for x in (F.lit(s), F.col(s))))).alias("name", "n"))
    return scanned.union(by_id).union(by_severity.select(F.lit("severity"), "name", "n"))


AUTH_IDS = [4625, 4740, 4672]
RELIABILITY_IDS = [7031, 7034, 1000, 1002, 1001, 41, 6008]


def authentication(events: DataFrame) -> DataFrame:
    """Findings of failed logons, password spraying, lockouts and privileged logons."""
    own, data = events.where(F.col("event_id").isin(AUTH_IDS)), F.col("data")
    text = lambda *k: F.coalesce(first_field(data, *k), F.lit(""))
    failed = own.where("event_id = 4625").withColumns({"user": text("TargetUserName"), "source": text("IpAddress"), "account": account(text("TargetUserName"), text("TargetDomainName")), "status": status_code(data), "type": text("LogonType")})
    failed = failed.withColumn("who", F.lower("account"))
    burst = max_burst(failed, ["who", "source"], "time", 600).select("who", "source", "burst")
    notes = {"sourceIp": F.col("source"), "workstation": text("WorkstationName"), "statusCode": F.col("status"), "logonType": F.col("type"), "process": text("ProcessName")}
    sample = F.concat(F.col("account"), F.lit(" from "), or_dash(F.col("source")), F.lit(" — "), reasons(F.array("status")))
    f = _group(failed, ["who", "source"], "failed-logon", F.col("account"), notes, sample).join(burst, ["who", "source"])
    f = f.withColumn("severity", F.when((F.col("count") >= 20) | (F.col("burst") >= 10), "critical").when((F.col("count") >= 5) | (F.col("burst") >= 5), "warning").otherwise("info"))
    f = f.withColumn("details", F.map_concat("details", F.create_map(F.lit("burst10m"), F.col("burst").cast("string")))).withColumn("reason", F.concat(logon_types(F.col("n_logonType")), F.lit(": "), reasons(F.col("n_statusCode"))))
    remote = failed.where(~local_source(F.col("source")))
    spray = _group(remote, ["source"], "password-spray", F.col("source"), {"accounts": F.col("account")}, F.col("account")).where(F.size("n_accounts") >= 5).withColumn("severity", F.lit("critical"))
    locked = own.where("event_id = 4740").withColumn("account", account(text("TargetUserName"), F.lit(""))).withColumn("who", F.lower("account"))
    caller = text("TargetDomainName", "#1")
    lock = _group(locked, ["who"], "account-lockout", F.col("account"), {"caller": caller}, F.concat(F.col("account"), F.lit(" locked out (caller: "), or_dash(caller), F.lit(")")))
    lock = lock.withColumn("severity", F.when(F.col("count") >= 3, "critical").otherwise("warning"))
    user, domain = text("SubjectUserName"), text("SubjectDomainName")
    privileged = own.where("event_id = 4672").withColumns({"own": builtin(user, domain), "account": account(user, domain), "name": F.lower(user)}).withColumn("who", F.lower("account"))
    tried = failed.groupBy(F.lower("user").alias("name")).agg(F.count("*").alias("tries"))
    people = privileged.where(~F.col("own"))
    p = _group(people.withColumn("privilege", F.explode_outer(F.split(text("PrivilegeList"), r"\s+"))), ["who", "name"], "privileged-logon", F.col("account"), {"privileges": F.col("privilege")}).select("who", "name", "details")
    counted = _group(people, ["who", "name"], "privileged-logon", F.col("account"), {}, F.concat(F.col("account"), F.lit(" received special privileges"))).drop("details")
    p = counted.join(p, ["who", "name"]).join(tried, "name", "left")
    admin = (F.col("who") == "administrator") | F.col("who").endswith("\\administrator")
    p = p.withColumn("severity", F.when((F.coalesce("tries", F.lit(0)) > 0) | admin, "warning").otherwise("info"))
    system = _group(privileged.where("own").withColumn("all", F.lit(0)), ["all"], "privileged-logon", F.lit("built-in service accounts"), {"accounts": F.col("account")})
    return finalised([f, spray, lock, p, system.withColumn("severity", F.lit("info"))], "AUT")


def reliability(events: DataFrame) -> DataFrame:
    """Findings of service crashes, application faults and hangs, stop errors and unexpected shutdowns."""
    data, provider, number = F.col("data"), F.lower(F.coalesce("provider", F.lit(""))), F.col("event_id")
    text = lambda *k: F.coalesce(first_field(data, *k), F.lit(""))
    whose = lambda part: (provider == "") | provider.contains(part)
    filled = lambda value, other: F.coalesce(F.nullif(value, F.lit("")), F.lit(other))
    crash = events.where(number.isin(7031, 7034) & whose("service control manager")).withColumn("name", filled(text("param1", "#0"), "(unknown service)")).withColumn("key", F.lower("name"))
    action = F.when(number == 7031, text("param5", "#4")).otherwise("")
    s = _group(crash, ["key"], "service-crash", F.col("name"), {"recoveryAction": action}, F.coalesce("message", F.lit(""))).withColumn("severity", F.when(F.col("count") >= 3, "critical").otherwise("warning"))
    apps = events.where(((number == 1000) & whose("application error")) | ((number == 1002) & whose("application hang"))).withColumn("name", filled(text("AppName", "#0"), "(unknown application)")).withColumn("key", F.lower("name"))
    faults = apps.where("event_id = 1000").withColumns({"module": text("ModuleName", "#3"), "exception": norm_hex(text("ExceptionCode", "#6"))})
    code = F.when(F.col("exception") != "", F.concat(F.lit("0x"), F.col("exception"))).otherwise("")
    notes = {"faultingModule": F.col("module"), "exceptionCode": code, "version": text("AppVersion", "#1"), "path": text("AppPath", "#10")}
    a = _group(faults, ["key"], "app-fault", F.col("name"), notes, F.concat(F.col("name"), F.lit(" crashed in "), or_dash(F.col("module")), F.lit(" (0x"), F.col("exception"), F.lit(")")))
    a = a.withColumn("severity", F.when(F.col("count") >= 5, "critical").when(F.col("count") == 1, "info").otherwise("warning"))
    module = F.lower(F.coalesce(F.get("n_faultingModule", F.lit(0)), F.lit("")))
    place = F.when((module != "") & (module == F.lower("subject")), "own").when(module.isin(dims.SYSTEM_MODULES), "system library").otherwise("third party")
    a = a.withColumn("reason", F.concat(place, F.lit(": "), exception_text(F.transform("n_exceptionCode", lambda c: F.substring(c, 3, 99)))))
    h = _group(apps.where("event_id = 1002"), ["key"], "app-hang", F.col("name"), {"version": text("AppVersion", "#1")}, F.concat(F.col("name"), F.lit(" stopped responding"))).withColumn("severity", F.when(F.col("count") >= 3, "warning").otherwise("info"))
    power = (number == 41) & provider.contains("kernel-power")
    stop = (number == 1001) & (provider.contains("systemerrorreporting") | provider.contains("bugcheck"))
    said = stop_code(F.regexp_extract(F.lower(F.coalesce("message", F.lit(""))), r"bugcheck was: (.*)", 1))
    code = F.when(stop, F.coalesce(stop_code(text("param1", "#0")), said)).otherwise(stop_code(text("BugcheckCode")))
    stops = events.where(power | stop).withColumn("code", code)
    dump = F.when(stop, text("param2", "#1")).otherwise("")
    b = _group(stops.where("code is not null"), ["code"], "bugcheck", stop_name(F.col("code")), {"dumpFile": dump}, F.when(stop, F.concat(F.lit("Bugcheck "), text("param1", "#0"))).otherwise(F.concat(F.lit("Kernel-Power 41 with bugcheck "), stop_name(F.col("code"))))).withColumn("severity", F.lit("critical"))
    down = stops.where(power & F.col("code").isNull()).drop("code").unionByName(events.where((number == 6008) & ((provider == "") | (provider == "eventlog")))).withColumn("all", F.lit(0))
    reboots = sessions(down, ["all"], "time", 300)
    pressed = F.when(number == 41, text("PowerButtonTimestamp")).otherwise("")
    d = _group(down, ["all"], "unexpected-shutdown", F.lit("System"), {"power": pressed}, F.coalesce("message", F.lit(""))).drop("count").join(reboots.groupBy("all").agg(F.max("session").cast("long").alias("count")), "all")
    d = d.withColumn("reason", F.when(F.size(F.filter("n_power", lambda x: x != "0")) > 0, "power button").otherwise("")).withColumn("details", F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
    return finalised([s, a, h, b, d.withColumn("severity", F.when(F.col("count") >= 3, "critical").otherwise("warning"))], "REL")


def csv_rows(findings: DataFrame) -> DataFrame:
    """Findings as spreadsheet cells: ids joined by blanks, times in UTC, details sorted as `k=v; ...`."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    details = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    return findings.select("id", "severity", "kind", csv_safe(F.col("subject")).alias("subject"), F.array_join(F.transform("event_ids", lambda i: i.cast("string")), " ").alias("event_ids"), F.col("count").cast("string").alias("count"), at("first").alias("first_seen"), at("last").alias("last_seen"), csv_safe(F.col("reason")).alias("reason"), csv_safe(details).alias("details"))


def write_csv(findings: DataFrame, path: str, limit: int = 20_000) -> None:
    """A report for a person: at most ``limit`` findings, as UTF-8 CSV with a byte order mark, in order of their ids."""
    rows = csv_rows(findings).orderBy("id").limit(limit).collect()
    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(CSV_HEADER)
        out.writerows([[r[c] for c in CSV_HEADER] for r in rows])
