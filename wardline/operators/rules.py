"""Threshold rules with sustain and hysteresis: by windows in batch, by the same state machine step by step in streaming."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import dims
from wardline.functions.scalars import cleared, glob_regex, micros, violates

OUT = "rule_id string, instance string, ts timestamp, value double, event string"


def defaults() -> list[dict]:
    return [{"id": i, "metric": m, "op": op, "threshold": float(t), "for_sec": s, "severity": sev, "scope": "", "hysteresis": 0.0, "enabled": True} for i, m, op, t, s, sev in dims.DEFAULT_RULES]


def validated(rule: dict) -> dict | None:
    """The rule with trimmed and filled fields, or None if it isn't valid."""
    r = {"id": "", "scope": "", "hysteresis": 0.0, "for_sec": 0, "severity": "warning", "enabled": True} | rule
    metric = dims.METRICS.get(r.get("metric"))
    if metric is None or r.get("op") not in (">", ">=", "<", "<=") or r["severity"] not in dims.SEVERITIES:
        return None
    _, scoped, most, hysteresis, _ = metric
    scope = str(r["scope"]).strip()
    scope = "" if scope == "*" else scope
    if not 0 <= r.get("threshold", -1) <= most or not 0 <= r["for_sec"] <= 3600 or not 0 <= r["hysteresis"] <= most or (scope and not scoped) or len(scope) > 200:
        return None
    return r | {"scope": scope, "hysteresis": r["hysteresis"] or hysteresis}


def load(text: str) -> list[dict]:
    """Valid rules of a JSON array; the default ones if there are none."""
    return [v for r in json.loads(text) if (v := validated(r))] or [validated(r) for r in defaults()]


def step(state: tuple, ts: float, value: float | None, rule: dict) -> tuple[tuple, str | None]:
    """state: (since or None, firing). value None: the instance is absent. Times in seconds. Returns the new state and `fired`, `resolved` or None."""
    since, firing = state
    if value is None:
        return (None, False), "resolved" if firing else None
    op, threshold = rule["op"], rule["threshold"]
    bad = {">": value > threshold, ">=": value >= threshold, "<": value < threshold, "<=": value <= threshold}[op]
    if bad:
        since = ts if since is None else since
        if not firing and ts - since >= rule["for_sec"]:
            return (since, True), "fired"
        return (since, firing), None
    over = value < threshold - rule["hysteresis"] if op[0] == ">" else value > threshold + rule["hysteresis"]
    return (None, firing and not over), "resolved" if firing and over else None


def save(rules: list[dict], path: str) -> None:
    """The rules as a JSON array, put in place by a rename so that no reader meets half a file."""
    folder = Path(path).parent
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(rules, f, ensure_ascii=False, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def matched(observations: DataFrame, rules: list[dict]) -> DataFrame:
    """Observations (metric, instance, ts, value) with the fields of each enabled and valid rule whose metric and scope they fit."""
    own = [v for r in rules if r.get("enabled", True) and (v := validated(r))]
    rows = [(r["id"], r["metric"], r["op"], float(r["threshold"]), int(r["for_sec"]), float(r["hysteresis"]), glob_regex(r["scope"])) for r in own]
    table = F.broadcast(observations.sparkSession.createDataFrame(rows, "rule_id string, metric string, op string, threshold double, for_sec int, hysteresis double, pattern string"))
    return observations.join(table, "metric").where(F.rlike(F.translate(F.lower("instance"), "\\", "/"), F.col("pattern"))).drop("pattern")


def _states(observations: DataFrame, rules: list[dict]) -> DataFrame:
    """Each matched observation with its place among the metric's ticks, since when its condition has held, and whether the rule fires after it."""
    ticks = observations.select("metric", "ts").distinct()
    by = Window.partitionBy("metric").orderBy("ts")
    # Ticks are few beside observations: one for each metric and sample time.
    ticks = ticks.withColumn("tick", F.row_number().over(by)).withColumn("next_ts", F.lead("ts").over(by))
    rows = matched(observations, rules).join(ticks, ["metric", "ts"])
    own = Window.partitionBy("rule_id", "instance").orderBy("tick")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    held = violates(F.col("value"), F.col("op"), F.col("threshold"))
    rows = rows.withColumn("held", held).withColumn("gone", F.coalesce(F.col("tick") - F.lag("tick").over(own) > 1, F.lit(False)))
    # A stretch ends where the instance was absent at a tick; there all state is dropped.
    rows = rows.withColumn("stretch", F.sum(F.col("gone").cast("int")).over(upto))
    inside = Window.partitionBy("rule_id", "instance", "stretch").orderBy("tick")
    broken = F.max(F.when(~F.col("held"), F.col("tick"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", F.coalesce(broken, F.lit(0)))
    since = F.min(F.when(F.col("held"), micros("ts"))).over(Window.partitionBy("rule_id", "instance", "stretch", "run"))
    rows = rows.withColumn("since", F.when(F.col("held"), since))
    mark = F.when(F.col("held") & (micros("ts") - F.col("since") >= F.col("for_sec").cast("long") * 1_000_000), True).when(~F.col("held") & cleared(F.col("value"), F.col("op"), F.col("threshold"), F.col("hysteresis")), False)
    rows = rows.withColumn("mark", mark)
    last = F.last("mark", ignorenulls=True)
    return rows.withColumns({"was": F.coalesce(last.over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)), "firing": F.coalesce(last.over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)), "next_tick": F.lead("tick").over(own)})


def evaluate(observations: DataFrame, rules: list[dict]) -> DataFrame:
    """Firings and resolutions of (metric, instance, ts, value). An instance that is absent at the metric's next tick resolves there,
    without a value. All by windows over an instance's own observations."""
    rows = _states(observations, rules)
    turned = rows.where("firing != was").select("rule_id", "instance", "ts", "value", F.when(F.col("firing"), "fired").otherwise("resolved").alias("event"))
    left = rows.where("firing and next_ts is not null and (next_tick is null or next_tick > tick + 1)").select("rule_id", "instance", F.col("next_ts").alias("ts"), F.lit(None).cast("double").alias("value"), F.lit("resolved").alias("event"))
    return turned.unionByName(left)


def runtime(observations: DataFrame, rules: list[dict], now: Column) -> DataFrame:
    """For each rule: instances firing and pending at the last tick, the worst value there, how often it fired, and its ten most relevant
    instances, firing ones first and higher values first, as sorted text. ``now`` is the metric's last tick."""
    rows = _states(observations, rules)
    fired = rows.where("firing and not was").groupBy("rule_id").agg(F.count("*").alias("fired"))
    here = rows.where(F.col("ts") == now)
    worst = F.when(F.first("op").isin(">", ">="), F.max("value")).otherwise(F.min("value"))
    counts = here.groupBy("rule_id").agg(F.count_if("firing").alias("firing"), F.count_if(~F.col("firing") & F.col("since").isNotNull()).alias("pending"), worst.alias("worst"))
    place = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("firing"), F.desc("value"), "instance"))
    best = here.where("firing or since is not null").withColumn("place", place).where("place <= 10")
    named = F.transform(F.sort_array(F.collect_list(F.struct("place", "instance"))), lambda x: x["instance"])
    best = best.groupBy("rule_id").agg(F.array_join(named, ",").alias("instances"))
    return counts.join(fired, "rule_id", "left").join(best, "rule_id", "left").na.fill(0, ["fired"]).na.fill("", ["instances"])


def firing_rules(states: DataFrame, rules: DataFrame) -> DataFrame:
    """The firing instances of rule states (id, instances array<struct<instance, firing>>) with their rule's fields."""
    one = states.select("id", F.explode("instances").alias("i")).where("i.firing")
    return one.select("id", F.col("i.instance").alias("instance")).join(rules, "id", "left")


def plain_value(value: Column, unit: Column) -> Column:
    """A value with one digit behind the point, none for .0, and its unit."""
    text = F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")
    return F.when(unit == "%", F.concat(text, F.lit("%"))).when(unit.isin("count", "state", "score"), text).otherwise(F.concat_ws(" ", text, unit))
