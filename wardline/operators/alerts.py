"""Alert folding, filters, counts and exports."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalars import csv_safe, severity_rank
from wardline.operators.rates import sessions


CAP = 2000
CSV_HEADER = ["id", "time_first", "time_last", "severity", "category", "source", "count", "acknowledged", "title_en", "title_ar", "detail_en", "detail_ar", "fields"]


def fold(alerts: DataFrame, fold_seconds: int = 600) -> DataFrame:
    """One row for each session of a key: alerts (id, key, time, severity, detail) fold while the gap is ``fold_seconds`` at most; an empty
    or missing key folds with nothing. Counts add up, at least 1 each; severity only rises; the detail is the last one, the title and
    the fields the last that are there; a folded alert is open again."""
    for name, kind in (("count", "long"), ("title", "string"), ("fields", "map<string,string>"), ("acked", "boolean")):
        if name not in alerts.columns:
            alerts = alerts.withColumn(name, F.lit(None).cast(kind))
    key = F.when(F.coalesce("key", F.lit("")) == "", F.concat(F.lit("\0"), F.col("id").cast("string"))).otherwise(F.col("key"))
    own = sessions(alerts.withColumn("_k", key), ["_k"], "time", fold_seconds, ["id"])
    at = F.struct("time", "id")
    english = F.col("title")["en"] if alerts.schema["title"].dataType.typeName() == "struct" else F.col("title")
    last = lambda value, there: F.max_by(value, F.when(there, at)).alias(value)
    out = own.groupBy("_k", "session").agg(
        F.min("time").alias("time"), F.max("time").alias("updated"), F.sum(F.greatest(F.lit(1), F.coalesce("count", F.lit(1)))).alias("count"), F.min(severity_rank(F.col("severity"))).alias("rank"), F.max_by("detail", at).alias("detail"),
        last("title", F.coalesce(english, F.lit("")) != ""), last("fields", F.col("fields").isNotNull()), (F.coalesce(F.max("acked"), F.lit(False)) & (F.count("*") == 1)).alias("acked"), F.first("key").alias("key")
    )
    return out.select("key", "session", "time", "updated", "count", F.element_at(F.array(F.lit("critical"), F.lit("warning"), F.lit("info")), F.col("rank") + 1).alias("severity"), "detail", "title", "fields", "acked")


def counts(alerts: DataFrame, now: Column | None = None) -> DataFrame:
    """The total, by severity, open ones, and those updated in the 24 hours before ``now`` (the last update, unless given)."""
    own = alerts
    if now is None:
        own = alerts.crossJoin(F.broadcast(alerts.agg(F.max("updated").alias("_now"))))
        now = F.col("_now")
    opened = F.count_if(~F.coalesce("acked", F.lit(False))) if "acked" in alerts.columns else F.count("*")
    return own.agg(F.count("*").alias("total"), opened.alias("unacked"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")), F.count_if(F.col("updated") > now - F.expr("interval 24 hours")).alias("last24h"))


def by_category(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("category").agg(F.count("*").alias("n"))


def acknowledged(alerts: DataFrame, ids: list | None = None) -> DataFrame:
    """``alerts`` with those of ``ids``, or all, acknowledged."""
    return alerts.withColumn("acked", F.lit(True) if not ids else F.coalesce("acked", F.lit(False)) | F.col("id").isin(ids))


def updated(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """``alerts`` with the detail and further fields of ``changes`` (key, detail, fields) on the newest alert of each key."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("time"), F.desc("id"))) == 1
    own = alerts.withColumn("_n", newest).join(changes.select(F.col("key").alias("_k"), F.col("detail").alias("_d"), F.col("fields").alias("_f")), (F.col("key") == F.col("_k")) & F.col("_n"), "left")
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries("fields"), lambda e: ~F.map_contains_key(F.col("_f"), e["key"])), F.map_entries("_f")))
    fields = F.when(F.col("_f").isNull(), F.col("fields")).when(F.col("fields").isNull(), F.col("_f")).otherwise(merged)
    return own.withColumns({"detail": F.coalesce("_d", "detail"), "fields": fields}).drop("_n", "_k", "_d", "_f")


def search(alerts: DataFrame, severities: str = "", text: str = "", category: str = "", since: Column | None = None, unacked: bool = False, limit: int = 500) -> DataFrame:
    out = alerts
    if severities:
        out = out.where(F.col("severity").isin(severities.split(",")))
    if category:
        out = out.where(F.col("category") == category)
    if unacked:
        out = out.where(~F.col("acked"))
    if since is not None:
        out = out.where(F.col("updated") >= since)
    if text:
        pairs = F.transform(F.map_entries("fields"), lambda e: F.concat_ws(" ", e["key"], e["value"]))
        all_ = F.concat_ws(" ", "title.en", "title.ar", "detail.en", "detail.ar", "source", "category", F.array_join(pairs, " "))
        out = out.where(F.contains(F.lower(all_), F.lit(text.lower())))
    return out.orderBy(F.desc("updated"), "id").limit(limit)


def csv_rows(alerts: DataFrame) -> DataFrame:
    """Text columns safe for spreadsheets; fields sorted as `k=v; ...`, times in UTC."""
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    texts = [csv_safe(F.col(f"{a}.{b}")).alias(f"{a}_{b}") for a in ("title", "detail") for b in ("en", "ar")]
    return alerts.select(F.col("id"), at("time").alias("time_first"), at("updated").alias("time_last"), "severity", "category", "source", "count", F.col("acked").cast("string").alias("acknowledged"), *texts, csv_safe(F.coalesce(fields, F.lit(""))).alias("fields"))


def write_csv(alerts: DataFrame, path: str) -> None:
    """The newest alerts, as many as a store keeps (CAP), as UTF-8 CSV with a byte order mark."""
    rows = csv_rows(alerts.orderBy(F.desc("updated"), "id").limit(CAP)).collect()
    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(CSV_HEADER)
        out.writerows([[r[c] for c in CSV_HEADER] for r in rows])


def report(alerts: DataFrame, now: Column, host: str = "", version: str = "") -> DataFrame:
    """One row: the report as JSON, with when it was made, counts and the newest alerts (CAP at most)."""
    few = alerts.orderBy(F.desc("updated"), "id").limit(CAP).agg(F.collect_list(F.struct(*alerts.columns)).alias("alerts"))
    return counts(alerts, now).select(F.struct("*").alias("counts")).crossJoin(few).select(F.to_json(F.struct(now.alias("generated"), F.lit(host).alias("host"), F.lit(version).alias("version"), "counts", "alerts")).alias("report"))
