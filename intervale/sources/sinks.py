"""Renderers of results: subtitles in three variants, RTTM, JSON; and a webhook sink for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import srt_time, srt_time_truncated


def to_srt(segments: DataFrame, variant: str = "A", with_speaker: bool = True) -> DataFrame:
    """One subtitle text a file; blank segments are left out. A: whole milliseconds, numbered without blanks; B: the
    same with milliseconds cut from a double; C: as B, but numbered with blanks."""
    if variant not in ("A", "B", "C"):
        raise ValueError(f"no such subtitle variant: {variant}")
    time = srt_time if variant == "A" else srt_time_truncated
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("seg_idx"))
    rows = segments.withColumn("_k", number).where(filled) if variant == "C" else segments.where(filled).withColumn("_k", number)
    who = F.concat(F.lit("Speaker"), (F.col("speaker") + 1).cast("string"), F.lit(":")) if with_speaker else F.lit("")
    block = F.concat(F.col("_k").cast("string"), F.lit("\n"), time(F.col("start_ms")), F.lit(" --> "), time(F.col("end_ms")), F.lit("\n"), who, F.trim("text"), F.lit("\n"))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", block.alias("b")))), lambda x: x["b"]), "\n").alias("srt"))


def _seconds(ms: Column) -> Column:
    return F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)


def to_rttm(turns: DataFrame) -> DataFrame:
    """A line for each turn: SPEAKER file 1 start duration <NA> <NA> name <NA> <NA>, three decimals."""
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col("file_id").cast("string"), F.lit("1"), _seconds(F.col("start_ms")), _seconds(F.col("end_ms") - F.col("start_ms")), F.lit("<NA> <NA>"), F.concat(F.lit("Speaker"), (F.col("speaker") + 1).cast("string")), F.lit("<NA> <NA>"))
    return turns.select("file_id", "turn_idx", line.alias("line"))


def to_result_json(segments: DataFrame) -> DataFrame:
    """One JSON document a file: segments in order with times in seconds, and the sorted speakers."""
    name = F.concat(F.lit("Speaker"), (F.col("speaker") + 1).cast("string"))
    item = F.struct("seg_idx", (F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"), "text", name.alias("speaker"))
    return segments.groupBy("file_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("segments"), F.array_sort(F.collect_set(name)).alias("speakers"))).alias("json"))


def post_each_batch(stream: DataFrame, send: Callable[[list[dict]], None], checkpoint: str, rows: int = 1000):  # noqa: ANN201
    """A stream whose rows are handed to `send` from the executors in lists of at most `rows`; failed tasks are retried
    by Spark, so `send` may see a list again."""

    def part(batch: DataFrame, _: int) -> None:
        def run(items):  # noqa: ANN001, ANN202
            held: list[dict] = []
            for row in items:
                held.append(row.asDict(True))
                if len(held) == rows:
                    send(held)
                    held = []
            if held:
                send(held)

        batch.foreachPartition(run)

    return stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint)
