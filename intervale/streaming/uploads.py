"""Streaming forms of ingest and task tracking: chunk deduplication, session expiry, running counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lifecycle import TERMINAL


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time for watermarks: a timestamp with time zone semantics."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def distinct_chunks(chunks: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """The first arrival of each (session, chunk_index); state goes when the session's time to live has passed."""
    return chunks.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["session", "chunk_index"])


def terminal_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Terminal events by status and window of event time."""
    final = events.where(F.col("status").isin(*TERMINAL))
    return final.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("n"))


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The first arrival of each chunk, and how often it was sent; later ones are acknowledged, not written. chunks:
    session, chunk_index, arrival, data (binary)."""
    return chunks.groupBy("session", "chunk_index").agg(F.count(F.lit(1)).alias("n_sent"), F.min_by("data", "arrival").alias("data"))


def assembled(chunks: DataFrame) -> DataFrame:
    """Each session's file: its chunks at their places. session, n_chunks, size, md5, data. A file is put together in one
    row, so its size is bounded by what a row may hold."""
    first = first_chunks(chunks)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "data"))), lambda x: F.hex(x["data"]))
    whole = first.groupBy("session").agg(F.count(F.lit(1)).alias("n_chunks"), F.unhex(F.array_join(parts, "")).alias("data"))
    return whole.select("session", "n_chunks", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("md5"), "data")


def checked(files: DataFrame, told: DataFrame) -> DataFrame:
    """files with complete (all chunks that the client told of are there) and accepted (also its size and md5, the latter
    in any case of letters). told: session, chunks, size, md5."""
    t = told.select("session", F.col("chunks").alias("_c"), F.col("size").alias("_s"), F.lower("md5").alias("_m"))
    j = files.join(t, "session", "left").withColumn("complete", F.coalesce(F.col("n_chunks") == F.col("_c"), F.lit(False)))
    return j.withColumn("accepted", F.col("complete") & F.coalesce((F.col("size") == F.col("_s")) & (F.col("md5") == F.col("_m")), F.lit(False))).drop("_c", "_s", "_m")
