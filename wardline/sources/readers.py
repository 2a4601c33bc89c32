"""Readers of text, JSON and XML sources into normalised tables. Acquisition itself is left to whatever writes the files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import dims
from wardline.functions import scalars as X

EVENT_XML = "System STRUCT<Provider: STRUCT<_Name: STRING>, EventID: STRING, Level: INT, EventRecordID: BIGINT, Channel: STRING, Computer: STRING, TimeCreated: STRUCT<_SystemTime: STRING>>, EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>"
JOURNAL = "__REALTIME_TIMESTAMP STRING, PRIORITY STRING, SYSLOG_IDENTIFIER STRING, _SYSTEMD_UNIT STRING, _TRANSPORT STRING, _PID STRING, MESSAGE STRING"


def events_from_xml(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Event rows from XML text; the data map has names and positional `#i` keys."""
    e = rows.select(F.from_xml(xml, EVENT_XML).alias("e"))
    data = F.coalesce(F.col("e.EventData.Data"), F.array())
    named = F.filter(F.transform(data, lambda d: F.struct(d["_Name"].alias("k"), F.coalesce(d["_VALUE"], F.lit("")).alias("v"))), lambda x: x["k"].isNotNull())
    placed = F.transform(data, lambda d, i: F.struct(F.concat(F.lit("#"), i.cast("string")).alias("k"), F.coalesce(d["_VALUE"], F.lit("")).alias("v")))
    return e.select(
        F.col("e.System.Channel").alias("channel"), F.col("e.System.EventRecordID").alias("record_id"), F.col("e.System.EventID").cast("long").alias("event_id"), F.col("e.System.Level").alias("level"), F.col("e.System.Provider._Name").alias("provider"), F.to_timestamp("e.System.TimeCreated._SystemTime").alias("time"), F.col("e.System.Computer").alias("computer"), F.map_from_entries(F.array_distinct(F.concat(named, placed))).alias("data")
    )


def journal(spark: SparkSession, path: str) -> DataFrame:
    """journald JSON lines as events; the event id is the pid below 100,000 and means nothing else."""
    j = spark.read.schema(JOURNAL).json(path)
    p = F.coalesce(F.col("PRIORITY").cast("int"), F.lit(6))
    level = F.when(p <= 2, 1).when(p == 3, 2).when(p == 4, 3).otherwise(4)
    return j.select(F.timestamp_micros(F.col("__REALTIME_TIMESTAMP").cast("long")).alias("time"), level.alias("level"), F.coalesce("SYSLOG_IDENTIFIER", "_SYSTEMD_UNIT", F.lit("journal")).alias("provider"), (F.col("_PID").cast("long") % 100_000).alias("event_id"), F.col("MESSAGE").alias("message"))


def interfaces(spark: SparkSession, path: str) -> DataFrame:
    """/proc/net/dev; lines of fewer than sixteen numbers are skipped."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^\s*([^:]+):(.*)$", 1).alias("name"), F.split(F.trim(F.regexp_extract("value", r"^\s*([^:]+):(.*)$", 2)), r"\s+").alias("f"))
    n = lambda k: F.col("f")[k].cast("long")
    return lines.where("name != '' and size(f) >= 16").select("name", n(0).alias("in_octets"), n(1).alias("in_pkts"), n(8).alias("out_octets"), n(9).alias("out_pkts"), (n(2) + n(10)).alias("errors"), (n(3) + n(11)).alias("discards"))


def services(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of `systemctl show`, one service each."""
    m = spark.read.option("lineSep", "\n\n").text(path).select(F.expr("str_to_map(value, '\\n', '=')").alias("m"))
    return m.select(F.try_element_at("m", F.lit("Id")).alias("name"), F.try_element_at("m", F.lit("Description")).alias("display"), F.try_element_at("m", F.lit("ActiveState")).alias("state"), F.try_element_at("m", F.lit("UnitFileState")).alias("start_type"), F.try_element_at("m", F.lit("MainPID")).cast("long").alias("pid")).where("name is not null")


def sockets(spark: SparkSession, path: str) -> DataFrame:
    """/proc/net/tcp and udp: IPv4 addresses and ports from hexadecimal."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where("f[0] like '%:' and size(f) >= 10")

    def ip(c):
        h = F.split(c, ":")[0]
        return F.concat_ws(".", *(F.conv(F.substring(h, k, 2), 16, 10) for k in (7, 5, 3, 1)))

    port = lambda c: F.conv(F.split(c, ":")[1], 16, 10).cast("int")
    return f.select(ip(F.col("f")[1]).alias("local_addr"), port(F.col("f")[1]).alias("local_port"), ip(F.col("f")[2]).alias("remote_addr"), port(F.col("f")[2]).alias("remote_port"), F.conv(F.col("f")[3], 16, 10).cast("int").alias("state"), F.col("f")[9].alias("inode"))


def vendor_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated prefixes of 6, 7 or 9 hexadecimal digits, gzip or plain."""
    return spark.read.csv(path, sep="\t", schema="prefix string, organisation string").withColumn("prefix", F.upper("prefix")).where("length(prefix) in (6, 7, 9)")


def packages(spark: SparkSession, path: str) -> DataFrame:
    """dpkg status blocks of installed packages."""
    m = spark.read.option("lineSep", "\n\n").text(path).select(F.expr("str_to_map(regexp_replace(value, '\\n ', ' '), '\\n', ': ')").alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return m.where(get("Status").contains("installed") & ~get("Status").contains("not-installed")).select(get("Package").alias("name"), get("Version").alias("version"), get("Maintainer").alias("publisher"))


def apt_upgrades(spark: SparkSession, path: str) -> DataFrame:
    pattern = r"^([^/\s]+)/\S+ (\S+) \S+ \[upgradable from: ([^\]]+)\]"
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(*(F.regexp_extract("value", pattern, k).alias(n) for k, n in ((1, "name"), (2, "available"), (3, "current"))))


def _versionlike(text: Column) -> Column:
    return (text != "") & ~text.rlike(r"[ \t]") & ((F.lower(text) == "unknown") | text.rlike("[0-9]"))


def _upgrade(name: Column, id_: Column, version: Column, available: Column, source: Column) -> Column:
    return F.struct(name.alias("name"), id_.alias("id"), version.alias("version"), available.alias("available"), source.alias("source"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(head: Column) -> Column:
    """Where the words of ``head`` begin, counted from 1: the first six, which bound five columns."""
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))
    new = lambda a, w: (w != "") & (F.size(a["found"]) < 6)
    step = lambda a, w: F.struct((a["at"] + F.length(w) + 1).alias("at"), F.when(new(a, w), F.array_append(a["found"], a["at"])).otherwise(a["found"]).alias("found"))
    return F.aggregate(F.split(head, " "), zero, step, lambda a: a["found"])


def table_upgrades(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows of the fixed-width upgrade tables in ``text``, one whole output each, with its other columns. The words of the line above the dashes say where
    columns begin, counted in characters: name, id, version, available and, if there is a fifth, source. A row that doesn't fit them is
    split at blanks from its right; one that still doesn't, or brings no other version, is left out, as are tables of fewer columns.
    All is one expression of bound values: as columns with filters between, the optimizer would repeat the lines for each character of the heading."""
    trim = lambda c: F.trim(c, F.lit(" \t\n\v\f\r"))
    shown = F.transform(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.rtrim(F.substring_index(x, "\r", -1)))
    lines = F.filter(shown, lambda x: ~trim(x).rlike(r"^[-\\|/]?$") & ~x.rlike("[█▒]"))

    def parsed(line: Column, s: Column) -> Column:
        sourced = F.size(s) > 4

        def cell(k: int) -> Column:
            begin, end = F.get(s, F.lit(k)), F.coalesce(F.get(s, F.lit(k + 1)), F.lit(1 << 30))
            return F.coalesce(trim(F.substr(line, begin, end - begin)), F.lit(""))

        def valid(u: Column) -> Column:
            return X.package_id(u["id"]) & _versionlike(u["version"]) & _versionlike(u["available"]) & (~sourced | F.lower(u["source"]).isin(dims.UPGRADE_SOURCES))

        def split(f: Column) -> Column:
            n = F.size(f) - sourced.cast("int")
            word = lambda k: F.coalesce(F.get(f, n - k), F.lit(""))
            u = _upgrade(F.array_join(F.slice(f, 1, F.greatest(n - 3, F.lit(0))), " "), word(3), word(2), word(1), F.when(sourced, F.element_at(f, -1)).otherwise(F.lit("")))
            return F.when(n >= 4, _bound(u, lambda b: F.when(valid(b), b)))

        return _bound(_upgrade(*map(cell, range(5))), lambda a: F.when(valid(a), a).otherwise(_bound(F.split(trim(line), r"\s+"), split)))

    def below(lines: Column, at: Column, s: Column) -> Column:
        rows = F.filter(F.slice(lines, (at + 1).cast("int"), F.size(lines)), lambda x: F.length(x) >= F.get(s, F.lit(3)) - 1)
        return F.filter(F.transform(rows, lambda x: parsed(x, s)), lambda u: u["available"] != u["version"])

    def table(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: trim(x).rlike("^-{10,}$")), True)
        head = lambda at: F.get(lines, (at - 2).cast("int"))
        return _bound(at, lambda at: F.when(at > 1, _bound(_starts(head(at)), lambda s: F.when(F.size(s) >= 4, below(lines, at, s)))))

    others = texts.drop(text).columns
    out = texts.select(*others, F.explode(_bound(lines, table)).alias("_u"))
    return out.select(*others, "_u.*").withColumn("command", X.upgrade_command(F.col("id")))
