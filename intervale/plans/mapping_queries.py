"""Queries that map one labelling to another, review chunks, and sum up runs and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache as ca
from ..operators import clusters as cl
from ..operators import evaluation as ev
from ..operators import folds as fo
from ..operators import intervals as iv
from ..sources.substrate import derived
from .fold_queries import _CENTROID, spoken
from .registry import query, with_tables
from .service_queries import _REQ, requests

#: The greedy choice, cluster by cluster: c has file_id, k (rank by duration), speaker and ranked (labels, best first).
_GREEDY = """, g as (select file_id, 0::bigint as k, null::bigint as speaker, null::varchar as label, []::varchar[] as used from names
 union all select c.file_id, c.k, c.speaker, coalesce(list_filter(c.ranked, lambda x: not list_contains(g.used, x))[1], list_filter(n.names, lambda x: not list_contains(g.used, x))[1], n.names[1]),
 list_append(g.used, coalesce(list_filter(c.ranked, lambda x: not list_contains(g.used, x))[1], list_filter(n.names, lambda x: not list_contains(g.used, x))[1], n.names[1]))
 from g join c on c.file_id = g.file_id and c.k = g.k + 1 join names n on n.file_id = c.file_id)"""
_KNOWN = ", known as (select file_id, start_ms, end_ms, case when file_id % 4 = 0 then 'Speaker1' else 'Speaker' || (speaker % 2 + 1)::varchar end as label from segments), names as (select distinct file_id, case when file_id % 3 = 0 then ['Speaker2', 'Speaker1'] else ['Speaker1', 'Speaker2'] end as names from segments)"


def known_intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labelled intervals, of one speaker only in every fourth file, and the two names of each file."""
    s = derived(spark, d, "segments")
    label = F.when(F.col("file_id") % 4 == 0, "Speaker1").otherwise(F.concat(F.lit("Speaker"), (F.col("speaker") % 2 + 1).cast("string")))
    names = s.select("file_id").distinct().withColumn("names", F.when(F.col("file_id") % 3 == 0, F.array(F.lit("Speaker2"), F.lit("Speaker1"))).otherwise(F.array(F.lit("Speaker1"), F.lit("Speaker2"))))
    return s.select("file_id", F.col("start_ms").alias("k_start"), F.col("end_ms").alias("k_end"), label.alias("label")), names


@query("jn6_map_by_overlap", with_tables("segments", "turns") + _KNOWN + """, t as (select file_id, speaker, sum(end_ms - start_ms) as dur from turns group by all),
s as (select t.file_id, t.speaker, k.label, sum(least(t.end_ms, k.end_ms) - greatest(t.start_ms, k.start_ms)) as score from turns t join known k on t.file_id = k.file_id and t.start_ms < k.end_ms and k.start_ms < t.end_ms group by all),
r as (select file_id, speaker, list(label order by score desc, label) as ranked from s group by all),
c as (select t.file_id, t.speaker, coalesce(r.ranked, []) as ranked, row_number() over (partition by t.file_id order by dur desc, t.speaker) as k from t left join r using (file_id, speaker)),
one as (select file_id, min(label) as only from known group by file_id having count(distinct label) = 1)""" + _GREEDY + """
select g.file_id, g.speaker, case when o.only is null then g.label when g.k = 1 then o.only else list_filter(n.names, lambda x: x <> o.only)[1] end as label from g join names n using (file_id) left join one o using (file_id) where g.k > 0""")
def map_by_overlap(spark: SparkSession, d: str) -> DataFrame:
    return cl.map_by_overlap(derived(spark, d, "turns"), *known_intervals(spark, d))


@query("jn7_map_by_centroid", with_tables("vectors") + _CENTROID + """, names as (select distinct file_id, ['s0', 's2'] as names from vectors), known as (select file_id, 's' || speaker::varchar as label, c from unit where speaker % 4 = 0),
t as (select file_id, speaker, sum(dur_ms) as dur from vectors where speaker % 4 < 3 group by all),
s as (select u.file_id, u.speaker, l.label, list_sum(list_transform(list_zip(u.c, l.c), lambda x: x[1] * x[2])) as score from unit u join known l using (file_id) where u.speaker % 4 < 3),
r as (select file_id, speaker, list(label order by score desc, label) as ranked, list(score order by score desc, label) as scores from s group by all),
c as (select t.file_id, t.speaker, coalesce(r.ranked, []) as ranked, r.scores, row_number() over (partition by t.file_id order by dur desc, t.speaker) as k from t left join r using (file_id, speaker))""" + _GREEDY + """
select g.file_id, g.speaker, g.label, round(c.scores[1], 4) as best_score, c.ranked[1] as best_label, round(c.scores[1] - c.scores[2], 4) as margin from g join c using (file_id, k) where g.k > 0""")
def map_by_centroid(spark: SparkSession, d: str) -> DataFrame:
    v = derived(spark, d, "vectors")
    c = cl.centroids(v)
    local = cl.speaker_shares(v).where("speaker % 4 < 3").join(c, ["file_id", "speaker"], "left")
    known = c.where("speaker % 4 = 0").select("file_id", F.concat(F.lit("s"), F.col("speaker").cast("string")).alias("label"), "centroid")
    names = v.select("file_id").distinct().withColumn("names", F.array(F.lit("s0"), F.lit("s2")))
    found = cl.map_by_centroid(local, known, names)
    return found.select("file_id", "speaker", "label", F.get("scores", F.lit(0))["score"].alias("best_score"), F.get("scores", F.lit(0))["label"].alias("best_label"), "margin")


def spoken_and_heard(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation as a reference of sentences with alternating speakers, and as a hypothesis of the same
    sentences with small errors, whose speaker is wrong in every fifth."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("file_id"), F.split("text", r"(?<=[.])").alias("parts"))
    name = lambda k: F.concat(F.lit("S"), (k % 2).cast("string"))
    ref = F.transform("parts", lambda x, k: F.struct(name(k).alias("speaker"), x.alias("text")))
    hyp = F.transform("parts", lambda x, k: F.struct(k.cast("long").alias("seg_idx"), F.when(k % 5 == 4, "S9").otherwise(name(k)).alias("speaker"), F.regexp_replace(x, "the", "teh").alias("text")))
    return c.select("file_id", ref.alias("reference"), hyp.alias("hypothesis"))


@query("jn14_equal_characters")
def equal_characters(spark: SparkSession, d: str) -> DataFrame:
    return ev.equal_characters(spoken_and_heard(spark, d))


@query("ag10_text_confusion")
def text_confusion(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion_of(equal_characters(spark, d))


@query("ag11_text_majority")
def text_majority(spark: SparkSession, d: str) -> DataFrame:
    return ev.segment_majorities(equal_characters(spark, d))


@query("jn16_match_speakers", with_tables("segments", "turns") + """, a as (select file_id, speaker as l, sum(end_ms - start_ms) as la from segments group by all), b as (select file_id, speaker as r, sum(end_ms - start_ms) as lb from turns group by all),
x as (select s.file_id, s.speaker as l, t.speaker as r, sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms))::bigint as both_ms from segments s join turns t on s.file_id = t.file_id and s.start_ms < t.end_ms and t.start_ms < s.end_ms group by all),
p as (select a.file_id, l, r, coalesce(both_ms, 0)::double / (la + lb - coalesce(both_ms, 0)) as iou from a join b using (file_id) left join x using (file_id, l, r)),
k as (select file_id, l, list(r order by iou desc, r) as ranked, row_number() over (partition by file_id order by l) as k from p group by file_id, l),
g as (select distinct file_id, 0::bigint as k, null::bigint as l, null::bigint as r, []::bigint[] as used from k
 union all select k.file_id, k.k, k.l, list_filter(k.ranked, lambda y: not list_contains(g.used, y))[1], list_append(g.used, list_filter(k.ranked, lambda y: not list_contains(g.used, y))[1]) from g join k on k.file_id = g.file_id and k.k = g.k + 1)
select g.file_id, g.l, g.r, round(p.iou, 9) as iou from g join p on p.file_id = g.file_id and p.l = g.l and p.r = g.r""")
def match_speakers(spark: SparkSession, d: str) -> DataFrame:
    return ev.match_speakers(derived(spark, d, "segments"), derived(spark, d, "turns")).withColumn("iou", F.round("iou", 9))


_LONG = ", s as (select file_id, seg_idx, start_ms * 12 as start_ms, end_ms * 12 as end_ms, case when file_id % 3 = 0 then 1 else speaker end as speaker from segments), q as (select file_id, start_ms * 12 as start_ms, end_ms * 12 as end_ms from silences where file_id % 2 = 0)"


@query("ds4_classify_chunks", with_tables("segments", "silences") + _LONG + """, c as (select file_id, start_ms // 40000 as chunk_idx, min(start_ms) as c_start, max(end_ms) as c_end, count(distinct speaker) as n_speakers, count(*) as n_segments from s group by all),
h as (select file_id, chunk_idx, count(*) as n, max(least(c_end - 5000, end_ms) - greatest(c_start + 5000, start_ms)) as longest from c join q using (file_id) where c_end - c_start > 11000 and least(c_end - 5000, end_ms) - greatest(c_start + 5000, start_ms) >= 500 group by all)
select c.file_id, c.chunk_idx, case when n_speakers >= 2 then 'trigger_cross' when c_end - c_start >= 25000 and h.n > 0 then 'trigger_silence' else 'skip' end as label,
 case when n_speakers >= 2 then 'in_chunk_speakers=' || n_speakers::varchar when c_end - c_start < 25000 then 'single_speaker_short' when h.n > 0 then printf('silences=%d longest=%.2fs', h.n, longest / 1000.0::double) else 'single_speaker_no_silence' end as reason, n_speakers, n_segments, c_end - c_start as duration_ms
from c left join h using (file_id, chunk_idx)""")
def chunk_classes(spark: SparkSession, d: str) -> DataFrame:
    far = lambda name: iv_scaled(derived(spark, d, name))
    s = far("segments").withColumn("speaker", F.when(F.col("file_id") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("speaker"))).withColumn("chunk_idx", F.expr("start_ms div 40000"))
    chunks = s.groupBy("file_id", "chunk_idx").agg(F.min("start_ms").alias("c_start"), F.max("end_ms").alias("c_end"))
    return iv.classify_chunks(chunks, s, far("silences").where("file_id % 2 = 0"))


def iv_scaled(rows: DataFrame, factor: int = 12) -> DataFrame:
    """Rows on a slower clock, so that windows of 40 s hold few segments."""
    return rows.withColumn("start_ms", F.col("start_ms") * factor).withColumn("end_ms", F.col("end_ms") * factor)


@query("ag24_run_summary", """with r as (select user_id as run_id, count(*) * 100 as audio_s, sum(event_id % 90) as total_s, sum(event_id % 60) as asr_s, sum(event_id % 7) as diarize_s from events group by all), w as (select user_id as run_id, sum(event_id % 120)::bigint as processed_s, count(*) as n_windows, count(*) filter (event_id % 4 = 0) as n_warnings from events where event_type = 'view' group by all),
s as (select user_id as run_id, max(event_id * 7 % 900) as rss_peak_mb, max(event_id * 11 % 400) as cpu_pct_peak from events where event_type = 'click' group by all)
select run_id, coalesce(processed_s, 0) as processed_s, round(total_s::double / audio_s, 6) as rtf_full, coalesce(round(total_s::double / nullif(processed_s, 0), 6), 0) as rtf_processed, round(asr_s::double / audio_s, 6) as asr_rtf_full, coalesce(round(asr_s::double / nullif(processed_s, 0), 6), 0) as asr_rtf_processed, round(diarize_s::double / audio_s, 6) as diarize_rtf,
 coalesce(n_windows, 0) as n_windows, coalesce(n_warnings, 0) as n_warnings, coalesce(rss_peak_mb, 0) as rss_peak_mb, coalesce(cpu_pct_peak, 0) as cpu_pct_peak from r left join w using (run_id) left join s using (run_id)""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("user_id", "run_id")
    k = F.col("event_id")
    runs = e.groupBy("run_id").agg((F.count(F.lit(1)) * 100).alias("audio_s"), F.sum(k % 90).alias("total_s"), F.sum(k % 60).alias("asr_s"), F.sum(k % 7).alias("diarize_s"))
    windows = e.where("event_type = 'view'").select("run_id", (k % 120).alias("duration_s"), (k % 4 == 0).cast("long").alias("warnings"))
    samples = e.where("event_type = 'click'").select("run_id", (k * 7 % 900).alias("rss_mb"), (k * 11 % 400).alias("cpu_pct"))
    return ev.run_summary(runs, windows, samples)


_RESULTS = "(select user_id % 20 as client_id, event_id % 3 = 0 as cached, event_id % 700 / 10.0::double as seconds, event_id % 500 / 10.0::double as server_seconds from events)"
_SPREAD = "round(avg(seconds), 3) as mean, min(seconds) as least, max(seconds) as most, round(coalesce(stddev_samp(seconds), 0), 3) as stdev"


def results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 20).alias("client_id"), (k % 3 == 0).alias("cached"), (k % 700 / 10).alias("seconds"), (k % 500 / 10).alias("server_seconds"))


@query("ag15_concurrency_report", f"select count(*) as n, count(*) filter (cached) as n_cached, round(count(*) filter (cached) * 100.0::double / count(*), 3) as hit_percent, {_SPREAD}, round(avg(server_seconds) filter (not cached), 3) as server_mean from {_RESULTS}")
def concurrency(spark: SparkSession, d: str) -> DataFrame:
    return ev.concurrency_report(results(spark, d))


@query("ag15_client_report", f"select client_id, count(*) as n, {_SPREAD} from {_RESULTS} group by client_id")
def clients(spark: SparkSession, d: str) -> DataFrame:
    return ev.client_report(results(spark, d))


@query("ag15_errors_by_phase", "select coalesce(case event_id % 4 when 0 then 'connect' when 1 then 'upload' when 2 then 'wait' end, 'unknown') as phase, count(*) as n from events where event_id % 5 = 0 group by 1")
def phases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    failed = spark.read.parquet(f"{d}/events.parquet").where(k % 5 == 0)
    return ev.errors_by_phase(failed.select(F.when(k % 4 == 0, "connect").when(k % 4 == 1, "upload").when(k % 4 == 2, "wait").alias("phase")))


@query("prj8_effective_word_align", "select doc_id, coalesce(case doc_id % 3 when 0 then true when 1 then false end, true) as by_true, coalesce(case doc_id % 3 when 0 then true when 1 then false end, false) as by_false from documents")
def effective(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    asked = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", ca.effective_word_align(asked, True).alias("by_true"), ca.effective_word_align(asked, False).alias("by_false"))


@query("prj3_hit_metadata", "with" + _REQ[1:] + """, h as (select *, case doc_id % 8 when 1 then 'srt' when 5 then null else 'json' end as row_format, case when doc_id % 10 < 7 then doc_id % 10 < 4 end as row_projected from req), u as (select *, fmt <> 'srt' or coalesce(row_format = 'srt', false) as usable from h)
select doc_id, usable, usable and coalesce(row_projected, false) as projected, case when usable then engine end as engine, case when usable then diarize end as diarize, case when usable then engine = 'qwen3' and wa and fmt = 'json' end as word_align,
 case when usable then case when engine = 'qwen3' and wa and fmt = 'json' then coalesce(nullif(trim(lang), ''), 'zh') else nullif(trim(lang), '') end end as language from u""")
def hits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    row_format = F.when(k % 8 == 1, "srt").when(k % 8 != 5, "json")
    row_projected = F.when(k % 10 < 7, k % 10 < 4)
    h = requests(spark, d).select("doc_id", ca.hit_metadata(F.col("engine"), F.col("wa"), F.col("lang"), F.col("diarize"), F.col("fmt"), row_format, row_projected).alias("h"))
    return h.select("doc_id", "h.usable", "h.projected", *[F.col(f"h.metadata.{c}").alias(c) for c in ("engine", "diarize", "word_align", "language")])


@query("wn8_guard_stats")
def guard_stats(spark: SparkSession, d: str) -> DataFrame:
    return fo.guard_stats(spoken(spark, d))


@query("ag25_ablation_switches")
def ablation_switches(spark: SparkSession, d: str) -> DataFrame:
    s = spoken(spark, d)
    merged = s.select("file_id", "speaker").distinct().where("speaker = 2").select("file_id", "speaker", F.lit(0).cast("long").alias("merged_into"))
    truth = s.select("file_id").distinct().select("file_id", (F.col("file_id") % 3 + 1).alias("expected"))
    return ev.ablation(s, merged, derived(spark, d, "silences"), truth)


def review_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Windows of 10 s, local turns in them, vectors as pieces with roles, and silences."""
    k = F.col("seg_idx")
    w = F.floor(F.col("start_ms") / 10_000).alias("window_idx")
    turns = derived(spark, d, "turns").select("file_id", w, "turn_idx", "start_ms", "end_ms", "speaker")
    windows = turns.select("file_id", "window_idx").distinct().select("file_id", "window_idx", (F.col("window_idx") * 10_000).alias("win_start"), ((F.col("window_idx") + 1) * 10_000).alias("win_end"))
    v = derived(spark, d, "vectors").select((F.col("file_id") + 1).alias("file_id"), (k % 4).alias("window_idx"), "seg_idx", F.expr("case seg_idx div 60 % 3 when 0 then 'minority' when 1 then 'dominant' else 'other' end").alias("role"), (k % 101 / 100).alias("to_dominant"), F.when(k % 10 > 0, k % 97 / 100).alias("to_minority"), "embedding")
    return windows, turns, v, derived(spark, d, "silences")


@query("ag18_audio_features")
def audio(spark: SparkSession, d: str) -> DataFrame:
    return ev.audio_features(*review_windows(spark, d))


_N = ("sure_minority", "sure_dominant", "disagreements", "far_pairs", "local_switches", "switches", "speakers", "local_speakers", "qa_mixed", "mixed_hints", "tight", "very_short", "long_cross", "odd_rate", "question_cues", "answer_cues")
_FEATURES_OF = ", ".join(f"event_id // {k + 1} % {k % 4 + 2} as {n}" for k, n in enumerate(_N))


@query("ag19_risk_score_audio", f"""with f as (select event_id as window_idx, {_FEATURES_OF}, case when event_id % 4 > 0 then event_id % 71 / 100.0::double end as dominant_least, event_id % 37 / 100.0::double as minority_share, event_id * 13 % 9000 as silence_ms, event_id % 6 = 0 as single_qa, event_id % 7 = 0 as aba from events),
s as (select *, speakers <= 1 and local_speakers >= 2 and minority_share >= 0.25 and silence_ms < 6000 as strict from f)
select window_idx, (least(sure_minority, 3) * 400 + least(sure_dominant, 3) * 400 + case when sure_minority + sure_dominant = 0 then least(disagreements, 3) * 100 else 0 end + least(far_pairs, 3) * 300
 + case when local_switches - switches >= 3 then 300 when local_switches - switches = 2 then 150 else 0 end + case when dominant_least < 0.40 then 200 when dominant_least < 0.55 then 100 else 0 end
 + case when strict then 300 when speakers <= 1 and local_speakers >= 2 and minority_share >= 0.15 then 100 else 0 end + case when single_qa then 150 else 0 end + least(qa_mixed, 2) * 150 + least(mixed_hints, 3) * 100 + least(tight, 4) * 75 + least(very_short, 4) * 50
 + case when aba then 150 else 0 end + long_cross * 100 + least(odd_rate, 3) * 50 + case when question_cues > 0 and answer_cues > 0 and speakers <= 2 then 30 else 0 end + case when silence_ms < 500 and local_speakers >= 2 and speakers >= 2 then 50 else 0 end)::bigint as score from s""")
def risk_audio(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    counts = [F.expr(f"event_id div {k + 1} % {k % 4 + 2}").alias(n) for k, n in enumerate(_N)]
    f = spark.read.parquet(f"{d}/events.parquet").select(e.alias("window_idx"), *counts, F.when(e % 4 > 0, e % 71 / 100).alias("dominant_least"), (e % 37 / 100).alias("minority_share"), (e * 13 % 9000).alias("silence_ms"), (e % 6 == 0).alias("single_qa"), (e % 7 == 0).alias("aba"))
    return ev.risk_score_audio(f).select("window_idx", "score")
