"""Nested JSON results as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_sentences(raw: DataFrame) -> DataFrame:
    """Sentences of raw engine results (file_id, raw): seconds rounded half even to 2 digits, trimmed text, blank ones
    dropped, SpeakerN from a whole-number spk, else Speaker1."""
    schema = "sentence_info array<struct<seg_idx:bigint,start:bigint,`end`:bigint,text:string,spk:bigint>>"
    s = raw.select("file_id", F.inline(F.from_json("raw", schema)["sentence_info"]))
    seconds = lambda c: F.bround(F.col(c).cast("decimal(18,3)") / 1000, 2).cast("decimal(18,2)")
    return s.where(F.trim("text") != "").select("file_id", "seg_idx", seconds("start").alias("start_s"), seconds("end").alias("end_s"), F.trim("text").alias("text"), F.concat(F.lit("Speaker"), F.coalesce(F.col("spk") + 1, F.lit(1)).cast("string")).alias("speaker"))


def parse_turns(payloads: DataFrame) -> DataFrame:
    """Turns of payloads (file_id, json): diarization_turns, else segments; SpeakerN becomes N - 1; ordered by start."""
    item = "array<struct<start:double,`end`:double,speaker:string>>"
    p = F.from_json("json", f"diarization_turns {item}, segments {item}")
    rows = payloads.select("file_id", F.posexplode(F.coalesce(p["diarization_turns"], p["segments"])).alias("_pos", "_t"))
    ms = lambda c: F.round(F.col(f"_t.{c}") * 1000).cast("long")
    speaker = F.when(F.col("_t.speaker").startswith("Speaker"), F.expr("cast(substring(_t.speaker, 8) as bigint)") - 1).otherwise(F.expr("try_cast(_t.speaker as bigint)"))
    t = rows.select("file_id", "_pos", ms("start").alias("start_ms"), ms("end").alias("end_ms"), speaker.alias("speaker"))
    return t.withColumn("turn_idx", F.row_number().over(Window.partitionBy("file_id").orderBy("start_ms", "_pos")) - 1).drop("_pos")


def restored_name(original: Column, stored: Column) -> Column:
    """The name under which a file came in, where it is known, in place of that of its stored copy."""
    return F.coalesce(original, stored)
