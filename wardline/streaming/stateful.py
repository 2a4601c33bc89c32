"""Structured Streaming twins of the stateful operators. State is keyed, bounded by timeouts, and event time has a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.operators.rules import OUT, matched, step, validated

RULE_STATE = "since double, firing boolean, last timestamp"


def rule_events(observations: DataFrame, rules: list[dict], delay: str = "10 seconds", idle_ms: int = 900_000) -> DataFrame:
    """Firings and resolutions of a stream (metric, instance, ts, value) by the same state machine as in batch, for enabled rules and the
    instances in their scope. An instance without observations for ``idle_ms`` is gone: it resolves, and its state is dropped."""
    own = {r["id"]: v for r in rules if r.get("enabled", True) and (v := validated(r))}
    keyed = matched(observations.withWatermark("ts", delay), rules).select("rule_id", "instance", "ts", "value")
    columns = ["rule_id", "instance", "ts", "value", "event"]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, firing, last = state.get if state.exists else (None, False, None)
        if state.hasTimedOut:
            state.remove()
            if firing:
                yield pd.DataFrame([(key[0], key[1], last, None, "resolved")], columns=columns)
            return
        own_state = (None if since is None or pd.isna(since) else since, bool(firing))
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            own_state, event = step(own_state, row.ts.timestamp(), row.value, own[key[0]])
            last = row.ts
            if event:
                out.append((key[0], key[1], row.ts, row.value, event))
        state.update((*own_state, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    return keyed.groupBy("rule_id", "instance").applyInPandasWithState(run, OUT, RULE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


SWEEP_STATE = "times array<long>, ports array<int>, opened boolean, first long, last long, attempts long, seen array<int>, peak int"
SWEEP = "ip string, first_seen timestamp, last_seen timestamp, attempts long, ports int, peak int, closed boolean"


def sweep_incidents(observations: DataFrame, window_seconds: int = 5, threshold: int = 10, cooldown_seconds: int = 60, delay: str = "10 seconds") -> DataFrame:
    """Incidents of a stream (ip, port, ts): each as it stands after a batch that touched it, and once closed. An observation counts the
    distinct ports of its address in the ``window_seconds`` that end with it; more than ``threshold`` open an incident, seeded with
    them; it takes what follows until a gap of more than ``cooldown_seconds``, by the next observation or the watermark."""
    window, cool = window_seconds * 1_000_000, cooldown_seconds * 1_000_000

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ports, opened, first, last, attempts, seen, peak = state.get if state.exists else ([], [], False, 0, 0, 0, [], 0)
        times, ports, seen, out = list(times), list(ports), set(seen), []

        def row(closed: bool):
            return (str(key[0]), pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), attempts, len(seen), peak, closed)

        if state.hasTimedOut:
            state.remove()
            if opened:
                yield pd.DataFrame([row(True)], columns=[c.split()[0] for c in SWEEP.split(", ")])
            return
        touched = False
        for r in pd.concat(list(batches)).sort_values("ts").itertuples():
            t, port = r.ts.value // 1000, int(r.port)
            if opened and t - last > cool:
                out.append(row(True))
                opened = touched = False
            times.append(t)
            ports.append(port)
            while times[0] < t - window:
                del times[0], ports[0]
            inside = len(set(ports))
            if opened:
                attempts, peak, touched = attempts + 1, max(peak, inside), True
                seen.add(port)
            elif inside > threshold:
                opened, touched, first, attempts, seen, peak = True, True, times[0], len(times), set(ports), inside
            last = t
        if touched:
            out.append(row(False))
        state.update((times, ports, opened, first, last, attempts, sorted(seen) if opened else [], peak))
        state.setTimeoutTimestamp(max(last // 1000 + cooldown_seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SWEEP.split(", ")])

    return observations.withWatermark("ts", delay).groupBy("ip").applyInPandasWithState(run, SWEEP, SWEEP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def folded_alerts(alerts: DataFrame, fold: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """Sessions of alerts of one key with gaps of ``fold`` at most, closed by the watermark."""
    rank = F.min(F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2))
    return alerts.withWatermark("time", delay).groupBy("key", F.session_window("time", fold)).agg(F.count("*").alias("count"), F.max("time").alias("updated"), rank.alias("rank"))


def per_second(observations: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return observations.withWatermark("ts", delay).groupBy(F.window("ts", "1 second")).agg(F.count("*").alias("n"))
