"""Debounced alerts over ordered probes: a pure step, a batch fold and a keyed streaming operator around it."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {"server_down": "critical", "queue_saturation": "warning", "error_surge": "warning"}


def rule(key: str, firing: bool, active: dict, now: float, cooldown: float, recovers: bool) -> tuple[list[dict], dict | None]:
    """What to send and the rule's new entry: fires at once, again after the cooldown, tells of recovery if asked."""
    was = active.get(key)
    if not firing:
        return ([{"key": key, "level": "recovery"}] if was and recovers else []), None
    if was and now - was["last_notified"] < cooldown:
        return [], was
    return [{"key": key, "level": LEVELS[key]}], {"since": was["since"] if was else now, "last_notified": now}


def step(probe: dict, state: dict, now: float, cooldown: float = 900, saturation: float = 0.8, surge: float = 5) -> tuple[list[dict], dict]:
    """One probe (reachable, health, queue_size, queue_max, errors_total; the last three null without metrics).

    Without metrics the saturation entry stays and the surge entry goes; a counter that falls is a new baseline.
    """
    active = state.get("active", {})
    new: dict = {}
    sent: list[dict] = []
    measured = probe.get("errors_total") is not None

    def judge(key: str, firing: bool, recovers: bool = True) -> None:
        alerts, entry = rule(key, firing, active, now, cooldown, recovers)
        sent.extend(alerts)
        if entry:
            new[key] = entry

    judge("server_down", not probe["reachable"] or probe.get("health") != "healthy")
    seen = state.get("error_total_seen")
    if measured:
        size, most = probe.get("queue_size"), probe.get("queue_max")
        judge("queue_saturation", size is not None and most is not None and most > 0 and size / most >= saturation)
        if seen is not None:
            judge("error_surge", probe["errors_total"] - seen >= surge, False)
        seen = probe["errors_total"]
    elif "queue_saturation" in active:
        new["queue_saturation"] = active["queue_saturation"]
    return sent, {"active": new} | ({} if seen is None else {"error_total_seen": seen})


def _probe(row) -> dict:  # noqa: ANN001
    value = lambda x: None if pd.isna(x) else float(x)
    return {"reachable": bool(row.reachable), "health": row.health, "queue_size": value(row.queue_size), "queue_max": value(row.queue_max), "errors_total": value(row.errors_total)}


def _run(rows: Iterable, state: dict, **limits: float) -> tuple[list[tuple], dict]:
    out = []
    for row in rows:
        sent, state = step(_probe(row), state, float(row.at_s), **limits)
        out.extend((row.service, int(row.at_s), a["key"], a["level"]) for a in sent)
    return out, state


ALERTS = "service long, at_s long, key string, level string"
COLUMNS = ("service", "at_s", "reachable", "health", "queue_size", "queue_max", "errors_total")


def batch_alerts(probes: DataFrame, **limits: float) -> DataFrame:
    """Alerts of each service's probes in order of time (columns COLUMNS)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found, _ = _run(rows.sort_values("at_s").itertuples(), {}, **limits)
        return pd.DataFrame(found, columns=["service", "at_s", "key", "level"])

    return probes.select(*COLUMNS).groupBy("service").applyInPandas(run, ALERTS)


def stream_alerts(probes: DataFrame, **limits: float) -> DataFrame:
    """The same on a stream: each service's state is kept between batches; a batch's probes are taken in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("at_s")
        found, held = _run(rows.itertuples(), held, **limits)
        state.update((json.dumps(held),))
        yield pd.DataFrame(found, columns=["service", "at_s", "key", "level"])

    return probes.select(*COLUMNS).groupBy("service").applyInPandasWithState(run, ALERTS, "state string", "append", "NoTimeout")


def probes_of(events: DataFrame) -> DataFrame:
    """Synthetic probes of ten services from the events table."""
    k = F.col("event_id")
    metrics = k % 13 != 0
    return events.select(
        (k % 10).alias("service"), (k * 60).alias("at_s"), (k % 17 != 0).alias("reachable"), F.when(k % 11 == 0, "degraded").otherwise("healthy").alias("health"),
        F.when(metrics, (k * 7 % 20).cast("double")).alias("queue_size"), F.when(metrics, F.lit(20.0)).alias("queue_max"), F.when(metrics, F.floor(k / 10) + F.when(k % 9 == 0, 6).otherwise(0)).cast("double").alias("errors_total"),
    )
