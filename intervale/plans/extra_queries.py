"""Further queries: runs of items, set differences, window speech shares, session sweeps, result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import sequences as sq
from ..operators.lifecycle import live_sessions
from ..sources.results import restored_name
from ..sources.sinks import to_result_json
from ..sources.substrate import derived
from .registry import query, with_tables


@query("wn23_item_runs", with_tables("segments") + """, m as (select *, case when speaker = lag(speaker) over w then 0 else 1 end as new from segments window w as (partition by file_id order by seg_idx)), i as (select *, sum(new) over (partition by file_id order by seg_idx) as isl from m)
select file_id, min(seg_idx) as seg_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, any_value(speaker) as speaker, string_agg(text, '' order by seg_idx) as text, count(*) as n_merged from i group by file_id, isl""")
def item_runs(spark: SparkSession, d: str) -> DataFrame:
    return sq.merge_same_speaker(derived(spark, d, "segments"), 1 << 40)


@query("se2_main_and_minor_speakers", with_tables("vectors") + ", t as (select file_id, speaker, sum(dur_ms) as dur from vectors group by all), s as (select *, dur / sum(dur) over (partition by file_id) as share from t) select file_id, speaker, case when share >= 0.05 then 'main' else 'minor' end as kind from s")
def main_and_minor(spark: SparkSession, d: str) -> DataFrame:
    s = cl.speaker_shares(derived(spark, d, "vectors"))
    main = s.where("share >= 0.05").select("file_id", "speaker")
    minor = s.select("file_id", "speaker").join(main, ["file_id", "speaker"], "left_anti")
    return main.withColumn("kind", F.lit("main")).unionByName(minor.withColumn("kind", F.lit("minor")))


@query("ag18_window_speech_shares", with_tables("turns") + """, t as (select file_id, start_ms // 10000 as window_idx, speaker, sum(end_ms - start_ms)::bigint as ms from turns group by all)
select file_id, window_idx, count(*) as n_speakers, (min(ms) * 1000 // sum(ms))::bigint as least_milli, max(ms) as most_ms from t group by all""")
def speech_shares(spark: SparkSession, d: str) -> DataFrame:
    t = derived(spark, d, "turns").groupBy("file_id", F.floor(F.col("start_ms") / 10_000).alias("window_idx"), "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return t.groupBy("file_id", "window_idx").agg(F.count(F.lit(1)).alias("n_speakers"), F.floor(F.min("ms") * 1000 / F.sum("ms")).alias("least_milli"), F.max("ms").alias("most_ms"))


@query("st6_session_sweep", "select conv_id as session, count(distinct turn % 3) as n_chunks from conversations where 100000 - conv_id * 700 <= 86400 group by conv_id")
def sweep(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("session"), (F.col("turn") % 3).alias("chunk_index"), (F.col("conv_id") * 700).alias("created_s"))
    return live_sessions(c, 100_000, 86_400)


@query("snk4_result_json", with_tables("segments") + " select file_id, count(*)::int as n_segments, array_to_string(list_sort(list(distinct 'Speaker' || (speaker + 1)::varchar)), ',') as speakers, min(start_ms) as first_ms from segments group by file_id")
def result_json(spark: SparkSession, d: str) -> DataFrame:
    j = F.from_json("json", "segments array<struct<start_time:double,text:string>>, speakers array<string>")
    r = to_result_json(derived(spark, d, "segments")).select("file_id", j.alias("j"))
    return r.select("file_id", F.size("j.segments").alias("n_segments"), F.array_join("j.speakers", ",").alias("speakers"), F.round(F.array_min(F.transform("j.segments", lambda s: s["start_time"])) * 1000).cast("long").alias("first_ms"))


@query("prj10_restore_file_name", "select doc_id, case when doc_id % 3 = 0 then 'upload_' || doc_id::varchar || '.wav' else source end as file_name from documents")
def restore_name(spark: SparkSession, d: str) -> DataFrame:
    kept = F.concat(F.lit("upload_"), F.col("doc_id").cast("string"), F.lit(".wav"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", restored_name(F.when(F.col("doc_id") % 3 > 0, F.col("source")), kept).alias("file_name"))
