"""Task lifecycle: error kinds, states, counters, moving averages, eviction, status lookup."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import shipped

# The markers and patterns of error kinds.
NON_RETRYABLE = ("音频时长过短", "文件不存在", "不支持的文件格式", "文件太大", "认证失败")
MODEL_ERROR = r"(?i)VAD algorithm|index .* out of bounds|list index out of range|window size|dimension"
RESOURCE_ERRORS = ("BFCArena", "CUBLAS", "cublas", "cudaMalloc", "CUDA failure", "cudaErrorMemoryAllocation", "out of memory")
TERMINAL = ("completed", "failed", "cancelled", "timed_out")
MOST_RETRIES = 2
EMA_ALPHA, EMA_DEFAULT = 0.3, 90.0
STATUS_BATCH = 50


def _any(message: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | message.contains(m)
    return out


def classify_error(message: Column, queue_full: Column | None = None) -> Column:
    kind = F.when(_any(message, NON_RETRYABLE), "non_retryable_input").when(message.rlike(MODEL_ERROR), "model_error").otherwise("engine_error")
    return kind if queue_full is None else F.when(queue_full, "queue_full").otherwise(kind)


def retryable(kind: Column) -> Column:
    return kind.isin("model_error", "engine_error")


def is_resource_error(message: Column) -> Column:
    return _any(message, RESOURCE_ERRORS)


def progress_error_type(status: Column, message: Column) -> Column:
    named = F.when(message.contains("VAD"), "vad_error").when(message.contains("索引") | message.contains("index"), "index_error").when(message.contains("音频"), "audio_error").when(message.contains("模型"), "model_error").otherwise("unknown_error")
    return F.when((status == "failed") & (F.length(message) > 0), named)


def allowed_file(name: Column, size: Column, suffixes: tuple[str, ...], most_mb: int) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*suffixes) & (size <= most_mb * 1048576)


def has_headroom(free_mib: Column, required_mib: Column) -> Column:
    """Unknown free memory passes."""
    return F.coalesce(free_mib >= required_mib, F.lit(True))


def latest_states(events: DataFrame) -> DataFrame:
    """Each task's last event: task_id, status, ts, value. events: task_id, event_id, ts, status, value."""
    last = events.groupBy("task_id").agg(F.max_by(F.struct("status", "ts", "value", "event_id"), F.struct("ts", "event_id")).alias("_l"))
    return last.select("task_id", "_l.status", "_l.ts", "_l.value", "_l.event_id")


def snapshot(tasks: DataFrame) -> DataFrame:
    """Counts by status in one row."""
    return tasks.agg(F.count(F.lit(1)).alias("n_tasks"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", *TERMINAL)])


def terminal_counters(events: DataFrame) -> DataFrame:
    """Monotone counts of terminal events by status and error kind (null: no error), over the whole log."""
    kind = F.when(F.col("status") == "timed_out", "timeout").when(F.col("status") == "failed", classify_error(F.col("message")))
    return events.where(F.col("status").isin(*TERMINAL)).groupBy("status", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def moving_average(events: DataFrame, key: str, value: str, order: list[str], alpha: float = EMA_ALPHA) -> DataFrame:
    """Exponential average of the positive values in order, seeded by the first; without any the default."""
    samples = F.transform(F.array_sort(F.collect_list(F.when(F.col(value) > 0, F.struct(*order, value)))), lambda x: x[value])
    fold = F.aggregate(samples, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(alpha * x + (1 - alpha) * acc))
    return events.groupBy(key).agg(F.coalesce(F.round(fold, 6), F.lit(EMA_DEFAULT)).alias("ema"))


def retry_after(ema: Column, concurrency: int) -> Column:
    return F.greatest(F.lit(1), F.floor(ema / concurrency).cast("int"))


def estimated_wait(position: Column, ema: Column, concurrency: int) -> Column:
    return F.floor((position - 1) / concurrency * ema).cast("int")


def fold_states(events: DataFrame) -> DataFrame:
    """The state of each task after its events, in order: a terminal state is final; a failure of a retryable kind goes
    back to pending at most MOST_RETRIES times. task_id, status, retries, n_terminal."""
    kind = classify_error(F.col("message"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "status", retryable(kind).alias("again"))))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("retries"), F.lit(0).alias("n_terminal"))

    def step(s: Column, e: Column) -> Column:
        final = s["status"].isin(*TERMINAL)
        retry = (e["status"] == "failed") & e["again"] & (s["retries"] < MOST_RETRIES)
        ends = e["status"].isin(*TERMINAL) & ~retry
        return F.when(final, s).otherwise(F.struct(F.when(retry, "pending").otherwise(e["status"]).alias("status"), (s["retries"] + retry.cast("int")).alias("retries"), (s["n_terminal"] + ends.cast("int")).alias("n_terminal")))

    return events.groupBy("task_id").agg(F.aggregate(ordered, start, step).alias("_s")).select("task_id", "_s.*")


def timed_out(tasks: DataFrame, now: Column, limit_s: int) -> DataFrame:
    """Tasks in processing for strictly longer than the limit."""
    return tasks.where((F.col("status") == "processing") & (F.unix_timestamp(now) - F.unix_timestamp("ts") > limit_s))


def evict_terminal(tasks: DataFrame, now: Column, ttl_s: int, most: int) -> DataFrame:
    """Task ids to forget: terminal ones older than the TTL, then the oldest terminal ones while more than `most` stay."""
    done = tasks.withColumn("_age", F.unix_timestamp(now) - F.unix_timestamp("ts")).withColumn("_final", F.col("status").isin(*TERMINAL))
    expired = F.col("_final") & (F.col("_age") > ttl_s)
    kept = done.where(~expired)
    # Others hold their places: of the terminal ones as many stay as they leave. Times are counted first, so that only
    # tasks of the time at which the cap falls are ranked.
    final = kept.where("_final")
    others = kept.where("not _final").agg(F.count(F.lit(1)).alias("_others"))
    times = final.groupBy("ts").agg(F.count(F.lit(1)).alias("_n"))
    newer = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = times.withColumn("_newer", newer).crossJoin(F.broadcast(others)).select("ts", (most - F.col("_others") - F.col("_newer")).alias("_room"))
    place = F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("task_id")))
    oldest = final.join(room, "ts").withColumn("_place", place).where(F.col("_place") > F.col("_room"))
    return done.where(expired).select("task_id", F.lit("ttl").alias("reason")).unionByName(oldest.select("task_id", F.lit("cap").alias("reason")))


def status_lookup(asked: DataFrame, tasks: DataFrame, evicted: DataFrame) -> DataFrame:
    """Of the first STATUS_BATCH ids (position, task_id): the status, task_expired for forgotten ones, else
    task_not_found; the value only of completed ones."""
    first = asked.where(F.col("position") < STATUS_BATCH)
    joined = first.join(tasks.select("task_id", "status", "value"), "task_id", "left").join(evicted.select("task_id").distinct().withColumn("_gone", F.lit(True)), "task_id", "left")
    state = F.coalesce("status", F.when(F.col("_gone"), "task_expired").otherwise("task_not_found"))
    return joined.select("position", "task_id", state.alias("status"), F.when(F.col("status") == "completed", F.col("value")).alias("result"))


def orphans(files: DataFrame, live: DataFrame, now_s: int, grace_s: int) -> DataFrame:
    """Files (file_hash, mtime_s) older than the grace period that no live task refers to."""
    return files.where(now_s - F.col("mtime_s") > grace_s).join(live.select("file_hash").distinct(), "file_hash", "left_anti")


def shared_files(tasks: DataFrame) -> DataFrame:
    """Tasks whose file another pending or processing task needs too."""
    live = tasks.where(F.col("status").isin("pending", "processing")).select("file_hash", F.col("task_id").alias("_other"))
    return tasks.join(live, (tasks["file_hash"] == live["file_hash"]) & (tasks["task_id"] != live["_other"]), "left_semi")


def admission_steps(events: Iterable[tuple[int, int, str]], most: int) -> list[tuple[int, int, bool]]:
    """(event_id, waiting, admitted) of the pending events among (event_id, task_id, status) in order. A task that comes
    to a full queue is rolled back: it does not wait, and its later start takes nobody out."""
    waiting: list[int] = []
    out = []
    for event, task, status in events:
        if status == "pending":
            out.append((event, len(waiting), len(waiting) < most))
            if len(waiting) < most:
                waiting.append(task)
        elif status == "processing" and task in waiting:
            waiting.remove(task)
    return out


def admitted(events: DataFrame, most: int) -> DataFrame:
    """Pending events with the number waiting before each in its queue, and whether the queue takes it: a fold over each
    queue's log. events: queue, event_id, ts, task_id, status."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        found = admission_steps(zip(rows["event_id"], rows["task_id"], rows["status"]), most)
        out = pd.DataFrame(found, columns=["event_id", "waiting", "admitted"])
        out.insert(0, "queue", key[0])
        return out

    log = shipped(events).where(F.col("status").isin("pending", "processing")).select("queue", "event_id", "ts", "task_id", "status")
    return log.groupBy("queue").applyInPandas(run, "queue long, event_id long, waiting long, admitted boolean")


def heartbeat(ticks: Column) -> Column:
    return F.least(5 + 3 * ticks, F.lit(95))


def health(loop_alive: Column, running: Column) -> Column:
    """200 only if the loop is alive and the service runs; unknown counts as no."""
    return F.when(F.coalesce(loop_alive & running, F.lit(False)), 200).otherwise(503)


def live_sessions(chunks: DataFrame, now_s: int, ttl_s: int) -> DataFrame:
    """Sessions not older than the time to live, and their different chunks. chunks: session, chunk_index, created_s."""
    live = chunks.where(now_s - F.col("created_s") <= ttl_s)
    return live.select("session", "chunk_index").distinct().groupBy("session").agg(F.count(F.lit(1)).alias("n_chunks"))
