"""The task state machine on a stream of events: a state for each task, kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lifecycle import MOST_RETRIES, TERMINAL, classify_error, retryable

OUT = "task_id long, status string, retries int"


def advance(state: tuple[str, int], status: str, again: bool) -> tuple[str, int]:
    """A terminal state is final; a failure that may be retried goes back to pending, MOST_RETRIES times at most."""
    now, retries = state
    if now in TERMINAL:
        return state
    if status == "failed" and again and retries < MOST_RETRIES:
        return "pending", retries + 1
    return status, retries


def stream_states(events: DataFrame) -> DataFrame:
    """After each batch the state of the tasks that it touched. events: task_id, event_id, ts, status, message."""
    judged = events.select("task_id", "event_id", "ts", "status", retryable(classify_error(F.col("message"))).alias("again"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        now = tuple(state.get) if state.exists else ("pending", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for status, again in zip(rows["status"], rows["again"]):
            now = advance(now, status, bool(again))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["task_id", "status", "retries"])

    return judged.groupBy("task_id").applyInPandasWithState(run, OUT, "status string, retries int", "update", "NoTimeout")
