"""Queries of the folds, clusters, evaluation and alert operators over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import evaluation as ev
from ..operators import folds as fo
from ..operators import intervals as iv
from ..sources.audio import embedding_windows
from ..sources.substrate import derived
from ..streaming import alerts as al
from .interval_queries import normal_regions, words_of_segments
from .registry import query, with_tables


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Segments with short texts and fillers in place of some, so that the short-segment rules act."""
    k = F.col("seg_idx")
    text = F.when(k % 4 == 1, "对").when(k % 4 == 2, "yes well").otherwise(F.col("text"))
    return derived(spark, d, "segments").withColumn("text", text)


@query("wn6_absorb_tiny")
def absorb(spark: SparkSession, d: str) -> DataFrame:
    return fo.per_file(spoken(spark, d), lambda s: fo.absorb_tiny(s, 1500))


_ABA = with_tables("segments") + """, t as (select file_id, seg_idx, row_number() over (partition by file_id order by seg_idx) as rn, start_ms, end_ms, speaker, case when seg_idx % 4 = 1 then '对' when seg_idx % 4 = 2 then 'yes well' else text end as text from segments),
f as (select file_id, rn, speaker as now, null::bigint as before from t where rn = 1
 union all select t.file_id, t.rn, case when n.speaker is not null and f.now = n.speaker and f.now <> t.speaker and t.end_ms - t.start_ms <= 1500 and (trim(t.text) in ('对', '嗯嗯', '好的', '是的') or trim(t.text) = '' or (t.end_ms - t.start_ms <= 1000 and length(trim(t.text)) * 1000 >= 5 * (t.end_ms - t.start_ms))) then f.now else t.speaker end, f.now
 from f join t on t.file_id = f.file_id and t.rn = f.rn + 1 left join t n on n.file_id = t.file_id and n.rn = t.rn + 1)
select t.file_id, t.rn - 1 as seg_idx, t.start_ms, t.end_ms, f.now as speaker, t.text from t join f using (file_id, rn)"""


@query("wn7_smooth_aba", _ABA)
def aba(spark: SparkSession, d: str) -> DataFrame:
    return fo.per_file(spoken(spark, d), lambda s: fo.smooth_aba(s, 1500))


@query("wn8_short_guard")
def guard(spark: SparkSession, d: str) -> DataFrame:
    return fo.per_file(spoken(spark, d), fo.short_guard)


@query("wn16_role_smoothing")
def role_smoothing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seg_idx")
    s = derived(spark, d, "segments").withColumn("speaker", F.col("speaker") % 2).withColumn("text", F.when(k % 3 == 0, "你觉得是什么？").when(k % 3 == 1, "我觉得我的公司在我看来").otherwise(F.col("text")))
    return fo.per_file(s, lambda x: fo.smooth_roles(x, True))


@query("wn17_unique_boundaries", with_tables("segments", "files") + """, raw as (select file_id, unnest([start_ms, end_ms]) as t from segments), r as (select file_id, t, row_number() over (partition by file_id order by t) as rn from raw join files using (file_id) where t > 60 and t < duration_ms - 60),
f as (select file_id, rn, t, t as kept, true as k from r where rn = 1 union all select r.file_id, r.rn, r.t, case when r.t - f.kept > 60 then r.t else f.kept end, r.t - f.kept > 60 from f join r on r.file_id = f.file_id and r.rn = f.rn + 1)
select file_id, t as boundary_ms from f where k""")
def unique_boundaries(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    s = derived(spark, d, "segments").join(derived(spark, d, "files"), "file_id").select("file_id", "start_ms", "end_ms", "duration_ms")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept = fo.unique_boundaries(rows[["start_ms", "end_ms"]].to_dict("records"), int(rows["duration_ms"].iloc[0]), 60)
        return pd.DataFrame({"file_id": key[0], "boundary_ms": kept}, columns=["file_id", "boundary_ms"])

    return s.groupBy("file_id").applyInPandas(run, "file_id long, boundary_ms long")


@query("wn18_similar_runs")
def similar(spark: SparkSession, d: str) -> DataFrame:
    s = derived(spark, d, "segments").withColumn("text", F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("the same words again and again number "), (F.col("seg_idx") % 2).cast("string"))).otherwise(F.col("text")))
    return ev.similar_runs(s)


@query("jn2_wn20_merge_chunks_and_turns")
def merge_chunks(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    k = F.col("seg_idx")
    chunks = derived(spark, d, "segments").where(k % 2 == 0).select("file_id", F.lit(0).alias("kind"), k.alias("idx"), "start_ms", (F.col("end_ms") + 1500).alias("end_ms"), F.lit(0).cast("long").alias("speaker"), F.regexp_replace("text", r"\.", "。").alias("text"))
    turns = derived(spark, d, "turns").select("file_id", F.lit(1).alias("kind"), F.col("turn_idx").alias("idx"), "start_ms", "end_ms", "speaker", F.lit("").alias("text"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_ms", "idx"])
        sides = [rows[rows["kind"] == j].to_dict("records") for j in (0, 1)]
        found = fo.merge_chunks_and_turns(*sides)
        return pd.DataFrame([{"file_id": key[0], "seg_idx": j, **s} for j, s in enumerate(found)], columns=["file_id", "seg_idx", "start_ms", "end_ms", "speaker", "text"])

    return chunks.unionByName(turns).groupBy("file_id").applyInPandas(run, fo.FOLDED)


@query("wn21_plan_windows")
def plan(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    files = derived(spark, d, "files")
    gaps = iv.complement(normal_regions(spark, d), files, 400).select("file_id", "start_ms", "end_ms")
    both = files.join(gaps, "file_id", "left")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        have = rows.dropna().sort_values("start_ms")
        found = fo.plan_windows(list(zip(have["start_ms"].astype(int), have["end_ms"].astype(int))), int(rows["duration_ms"].iloc[0]), 4000, 5000, 7000, 1500, 300, 1500)
        return pd.DataFrame([{"file_id": key[0], **w} for w in found], columns=["file_id", "idx", "start_ms", "end_ms", "asr_start_ms", "asr_end_ms"])

    return both.groupBy("file_id").applyInPandas(run, "file_id long, idx long, start_ms long, end_ms long, asr_start_ms long, asr_end_ms long")


@query("wn22_split_long")
def split_long(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    s = derived(spark, d, "segments")
    listed = iv.attach_word_lists(s, words_of_segments(s)).withColumn("words", F.when(F.col("seg_idx") % 2 == 0, F.col("words")))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = fo.split_long(rows.sort_values("seg_idx")[["start_ms", "end_ms", "speaker", "text", "words"]].to_dict("records"), [], 1500, 200)
        return pd.DataFrame([{"file_id": key[0], "seg_idx": j, **{c: x[c] for c in ("start_ms", "end_ms", "speaker", "text")}} for j, x in enumerate(found)], columns=["file_id", "seg_idx", "start_ms", "end_ms", "speaker", "text"])

    return listed.groupBy("file_id").applyInPandas(run, fo.FOLDED)


_SHARES = with_tables("vectors") + ", t as (select file_id, speaker, sum(dur_ms)::bigint as dur_ms from vectors group by all)"


@query("ag1_speaker_shares", _SHARES + " select file_id, speaker, dur_ms, (dur_ms * 1000000 // sum(dur_ms) over (partition by file_id))::bigint as share_ppm from t")
def shares(spark: SparkSession, d: str) -> DataFrame:
    return cl.speaker_shares(derived(spark, d, "vectors")).select("file_id", "speaker", "dur_ms", F.floor(F.round(F.col("share") * 1_000_000, 6)).alias("share_ppm"))


_CENTROID = ", chosen as (select * from vectors qualify row_number() over (partition by file_id, speaker order by dur_ms desc, seg_idx) <= 30), dims as (select file_id, speaker, k, avg(embedding[k]::double) as m from chosen, (select unnest(range(1, 65)) as k) group by all), cen as (select file_id, speaker, list(m order by k) as v from dims group by all), unit as (select file_id, speaker, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as c from cen)"


@query("ag2_centroids", with_tables("vectors") + _CENTROID + " select file_id, speaker, round(c[1], 5) as c0, round(c[64], 5) as c63, len(c)::int as n from unit")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    c = cl.centroids(derived(spark, d, "vectors"))
    return c.select("file_id", "speaker", F.round(F.get("centroid", F.lit(0)), 5).alias("c0"), F.round(F.get("centroid", F.lit(63)), 5).alias("c63"), F.size("centroid").alias("n"))


@query("jn12_minor_to_main", with_tables("vectors") + ", t0 as (select file_id, speaker, sum(dur_ms) as dur from vectors group by all), t as (select *, dur / sum(dur) over (partition by file_id) as share from t0)" + _CENTROID + """, p as (select a.file_id, a.speaker as minor, b.speaker as main, tb.share, list_sum(list_transform(list_zip(a.c, b.c), lambda x: x[1] * x[2])) as sim from unit a join t ta using (file_id, speaker) join unit b on a.file_id = b.file_id join t tb on tb.file_id = b.file_id and tb.speaker = b.speaker where ta.share < 0.05 and tb.share >= 0.05)
select file_id, minor, main, round(sim, 4) as similarity, case when sim >= 0.3 then 'minor_to_main' else 'minor_kept_isolated' end as action from p qualify row_number() over (partition by file_id, minor order by sim desc, share desc, main) = 1""")
def minor_to_main(spark: SparkSession, d: str) -> DataFrame:
    return cl.minor_to_main(derived(spark, d, "vectors"), 0.05, 0.3)


@query("cl1_jn13_merge_clusters")
def merge_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cl.merge_clusters(derived(spark, d, "vectors"), least_share=0.05, minor_at=0.3, main_at=0.5)


@query("cl1_merge_log")
def merge_log(spark: SparkSession, d: str) -> DataFrame:
    return cl.merge_log(derived(spark, d, "vectors"), least_share=0.05, minor_at=0.3, main_at=0.5)


@query("cl3_merge_without_folds")
def merge_without_folds(spark: SparkSession, d: str) -> DataFrame:
    """The variant that never folds minor speakers into a dominant one: no similarity reaches its threshold."""
    return cl.merge_clusters(derived(spark, d, "vectors"), least_share=0.05, minor_at=0.3, main_at=0.5, dominant_minor_at=2.0)


@query("cl2_complete_linkage")
def linkage(spark: SparkSession, d: str) -> DataFrame:
    return cl.cluster_vectors(derived(spark, d, "vectors"), 0.9)


@query("wn24_consecutive_distances", with_tables("vectors") + """, p as (select file_id, seg_idx, speaker, embedding, lag(embedding) over w as e, lag(speaker) over w as s from vectors window w as (partition by file_id order by seg_idx)),
q as (select *, case when e is not null then round(1 - list_sum(list_transform(list_zip(e, embedding), lambda x: x[1]::double * x[2]::double)) / (sqrt(list_sum(list_transform(e, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 4) end as distance from p)
select file_id, seg_idx, distance, coalesce(distance > 0.4 and s = speaker, false) as far_pair from q""")
def distances(spark: SparkSession, d: str) -> DataFrame:
    return cl.consecutive_distances(derived(spark, d, "vectors"))


@query("ag9_edit_stats")
def edits(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return ev.edit_stats(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("reference"), F.regexp_replace(F.expr("substring(text, 3)"), "the", "teh").alias("hypothesis")))


_CHARS = with_tables("segments", "turns") + ", chars as (select s.file_id, s.seg_idx, 'h' || s.speaker::varchar as hyp, 'r' || t.speaker::varchar as ref from segments s join turns t on s.file_id = t.file_id and s.start_ms < t.end_ms and t.start_ms < s.end_ms)"


def char_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = derived(spark, d, "turns").select("file_id", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"), F.concat(F.lit("r"), F.col("speaker").cast("string")).alias("ref"))
    j = iv.overlap_join(derived(spark, d, "segments"), t, "start_ms", "end_ms", "s2", "e2").where("start_ms < e2 and s2 < end_ms")
    return j.select("file_id", "seg_idx", F.concat(F.lit("h"), F.col("speaker").cast("string")).alias("hyp"), "ref")


@query("ag10_confusion", _CHARS + " select file_id, hyp, ref, count(*) as n from chars group by all")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion_of(char_pairs(spark, d))


_BEST = _CHARS + """, n as (select file_id, hyp, ref, count(*) as n from chars group by all), h as (select file_id, hyp, row_number() over (partition by file_id order by hyp) as k, count(*) over (partition by file_id) as hyps from (select distinct file_id, hyp from n)), r as (select file_id, ref, count(*) over (partition by file_id) as refs from (select distinct file_id, ref from n)),
m as (select file_id, 0::bigint as k, []::varchar[] as used, 0::bigint as score from (select distinct file_id from n)
 union all select m.file_id, h.k, list_append(m.used, r.ref), m.score + coalesce(n.n, 0) from m join h on h.file_id = m.file_id and h.k = m.k + 1 join r on r.file_id = m.file_id left join n on n.file_id = m.file_id and n.hyp = h.hyp and n.ref = r.ref where h.hyps > r.refs or not list_contains(m.used, r.ref)),
best as (select m.* from m join (select distinct file_id, hyps from h) x on x.file_id = m.file_id and x.hyps = m.k qualify row_number() over (partition by m.file_id order by score desc, used) = 1)
select h.file_id, h.hyp, best.used[h.k] as mapped, best.score as correct, t.total from h join best on best.file_id = h.file_id join (select file_id, sum(n)::bigint as total from n group by all) t on t.file_id = h.file_id"""


@query("ag10_best_mapping", _BEST)
def mapping(spark: SparkSession, d: str) -> DataFrame:
    return ev.speaker_accuracy(ev.confusion_of(char_pairs(spark, d)))


_MAJ = _CHARS + ", n as (select file_id, seg_idx, ref, count(*) as n from chars group by all), m as (select file_id, seg_idx, arg_min(ref, (-n, ref)) as majority, max(n) as n_majority, sum(n)::bigint as n_chars from n group by all)"


@query("ag11_segment_majority", _MAJ + " select *, n_majority < 0.9 * n_chars as mixed from m")
def majority(spark: SparkSession, d: str) -> DataFrame:
    return ev.segment_majorities(char_pairs(spark, d))


@query("so6_top_mixed_segments", _MAJ + " select file_id, seg_idx, n_chars from m where n_majority < 0.9 * n_chars order by n_chars desc, file_id, seg_idx limit 12")
def top_mixed(spark: SparkSession, d: str) -> DataFrame:
    return ev.segment_majorities(char_pairs(spark, d)).where("mixed").orderBy(F.desc("n_chars"), "file_id", "seg_idx").limit(12).select("file_id", "seg_idx", "n_chars")


@query("jn15_paired_characters", "with s as (select conv_id * 1000 + turn as id, turn % 7 as k from conversations), l as (select id, unnest(range(k)) as pos, k from s) select id, pos::int as pos, substr('一二三四五六七', pos + 1, 1) as a, substr('一二四四六六七', pos + 1, 1) as b, substr('一二三四五六七', pos + 1, 1) = substr('一二四四六六七', pos + 1, 1) as same from l")
def paired(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    side = lambda text: c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws(" a,", F.split(F.expr(f"substring('{text}', 1, cast(turn % 7 as int))"), "")).alias("text"))
    return ev.paired_characters(side("一二三四五六七"), side("一二四四六六七"))


@query("jn16_interval_iou", with_tables("segments", "turns") + """, a as (select file_id, speaker as l, sum(end_ms - start_ms) as la from segments group by all), b as (select file_id, speaker as r, sum(end_ms - start_ms) as lb from turns group by all),
x as (select s.file_id, s.speaker as l, t.speaker as r, sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms))::bigint as both_ms from segments s join turns t on s.file_id = t.file_id and s.start_ms < t.end_ms and t.start_ms < s.end_ms group by all)
select file_id, l, r, both_ms, (la + lb - both_ms)::bigint as either_ms from x join a using (file_id, l) join b using (file_id, r)""")
def iou(spark: SparkSession, d: str) -> DataFrame:
    return ev.interval_iou(derived(spark, d, "segments"), derived(spark, d, "turns"))


_Q, _A = ("|".join(("你觉得", "是什么", "吗")), "我觉得")
_TEXTED = ", s as (select file_id, seg_idx, start_ms * 4 as start_ms, end_ms * 4 as end_ms, speaker, case seg_idx % 5 when 0 then '你觉得 ' when 1 then '我觉得 ' when 2 then '我觉得 是什么 ' else '' end || text as text from segments)"


def cued(spark: SparkSession, d: str) -> DataFrame:
    """Segments with a cue before some of the texts."""
    k = F.col("seg_idx") % 5
    cue = F.when(k == 0, "你觉得 ").when(k == 1, "我觉得 ").when(k == 2, "我觉得 是什么 ").otherwise("")
    return derived(spark, d, "segments").select("file_id", "seg_idx", (F.col("start_ms") * 4).alias("start_ms"), (F.col("end_ms") * 4).alias("end_ms"), "speaker", F.concat(cue, F.col("text")).alias("text"))


_FEATURES = with_tables("segments") + _TEXTED + f""", w as (select *, start_ms // 40000 as window_idx, max(end_ms) over (partition by file_id) as last, end_ms - start_ms as dur, length(text) as chars, (case when contains(text, '你觉得') then 1 else 0 end + case when contains(text, '是什么') then 1 else 0 end) as q, (case when contains(text, '我觉得') then 1 else 0 end) as a from s),
r as (select *, lag(speaker) over z as p, lead(speaker) over z as n, lag(end_ms) over z as pe, least((window_idx + 1) * 40000, last) as bound from w window z as (partition by file_id, window_idx order by seg_idx)),
f as (select file_id, window_idx, count(*) as segments, sum(chars)::bigint as chars, count(distinct speaker) as speakers, count(*) filter (p <> speaker) as switches, sum(q)::bigint as question_cues, sum(a)::bigint as answer_cues, count(*) filter (q > 0 and a > 0) as qa_mixed,
 bool_or(coalesce(p = n and p <> speaker and dur <= 1500, false)) as aba, count(*) filter (dur <= 1000) as very_short, count(*) filter (p <> speaker and abs(start_ms - pe) <= 250) as tight, count(*) filter (start_ms < bound - 5000 and end_ms > bound and dur >= 12000) as long_cross, count(*) filter (chars * 1000 < dur or chars * 1000 > 8 * dur) as odd_rate from r group by all),
g as (select *, speakers = 1 and question_cues > 0 and answer_cues > 0 as single_qa from f)"""


@query("ag17_window_features", _FEATURES + " select * from g")
def features(spark: SparkSession, d: str) -> DataFrame:
    return ev.window_features(cued(spark, d))


_RISK = _FEATURES + """, risk as (select file_id, window_idx, (case when single_qa then 500 else 0 end + least(qa_mixed, 2) * 350 + least(tight, 4) * 150 + least(very_short, 4) * 100 + case when aba then 300 else 0 end + long_cross * 250
 + case when segments <= 1 and chars >= 120 and question_cues + answer_cues > 0 then 300 else 0 end + case when segments >= 5 then 150 else 0 end + case when switches >= 3 then 150 else 0 end + least(odd_rate, 3) * 75 + case when question_cues > 0 and answer_cues > 0 and speakers <= 2 then 100 else 0 end)::bigint as score from g)"""


@query("ag19_risk_score", _RISK + " select * from risk")
def risk(spark: SparkSession, d: str) -> DataFrame:
    return ev.risk_score(features(spark, d)).select("file_id", "window_idx", "score")


@query("so3_top_risks", _RISK + " select * from risk where score >= 1 order by score desc, file_id, window_idx limit 20")
def top_risks(spark: SparkSession, d: str) -> DataFrame:
    return ev.top_risks(ev.risk_score(features(spark, d)), 20).select("file_id", "window_idx", "score")


@query("flt9_quality_gate", """with g as (select event_id as window_id, event_id % 11 as items, event_id % 5 as low_conf, event_id % 4 as src_switches, event_id % 13 as out_switches, event_id % 6 as src_segments, event_id % 31 as out_segments, event_id % 5 as very_short, (event_id % 20) / 10.0 as drift, event_id % 2 = 0 as both_two,
 case when event_id % 3 > 0 then (event_id % 10) / 10.0 end as max_sim, case when event_id % 7 > 0 then (event_id % 9) / 100.0 end as max_margin from events),
r as (select window_id, case when out_segments = 0 then ['empty_aligned_output'] else list_filter([case when low_conf / greatest(items, 1) > 0.35 then 'low_conf_ratio' end, case when out_switches > greatest(8, src_switches + 5) then 'too_many_switches' end, case when out_segments > greatest(10, 4 * src_segments + 4) then 'too_many_output_segments' end,
 case when very_short >= 4 then 'too_many_very_short_segments' end, case when both_two and drift > 1.25 and src_switches <= 1 then 'speaker_duration_drift' end, case when max_sim < 0.25 then 'low_centroid_similarity' end, case when max_margin < 0.03 then 'low_centroid_margin' end], lambda x: x is not null) end as reasons from g)
select window_id, len(reasons) = 0 as accepted, array_to_string(reasons, ',') as reasons from r""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    g = spark.read.parquet(f"{d}/events.parquet").select(
        k.alias("window_id"), (k % 11).alias("items"), (k % 5).alias("low_conf"), (k % 4).alias("src_switches"), (k % 13).alias("out_switches"), (k % 6).alias("src_segments"), (k % 31).alias("out_segments"), (k % 5).alias("very_short"),
        ((k % 20) / 10).alias("drift"), (k % 2 == 0).alias("both_two"), F.when(k % 3 > 0, (k % 10) / 10).alias("max_sim"), F.when(k % 7 > 0, (k % 9) / 100).alias("max_margin"),
    )
    return ev.gate(g).select("window_id", "accepted", F.array_join("reasons", ",").alias("reasons"))


@query("ag16_stage_timing", "select user_id % 4 as tag, event_type as stage, count(*) as n, round(sum(value), 3) as total, round(avg(value), 3) as mean, min(value) as least, max(value) as most, round(coalesce(stddev_samp(value), 0), 3) as stdev from events group by all")
def timing(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return ev.timing_report(e.select((F.col("user_id") % 4).alias("tag"), F.col("event_type").alias("stage"), F.col("value").alias("seconds")))


@query("ag3_embedding_windows", with_tables("segments") + ", p as (select file_id, seg_idx, start_ms, end_ms - start_ms as dur, greatest(1, ceil((end_ms - start_ms) / 1200.0))::bigint as parts from segments), e as (select *, unnest(range(parts)) as part from p) select file_id, seg_idx, part, parts, start_ms + part * dur // parts as part_start, start_ms + (part + 1) * dur // parts as part_end from e")
def part_windows(spark: SparkSession, d: str) -> DataFrame:
    return embedding_windows(derived(spark, d, "segments"), 1200).select("file_id", "seg_idx", "part", "parts", "part_start", "part_end")


@query("ag25_ablation", with_tables("segments") + """, g as (select unnest([0, 50, 300, 3000]) as gap_ms), m as (select gap_ms, file_id, case when speaker = lag(speaker) over w and start_ms - lag(end_ms) over w < gap_ms then 0 else 1 end as new from segments, g window w as (partition by gap_ms, file_id order by seg_idx))
select gap_ms, file_id, sum(new)::bigint as n_segments from m group by all""")
def ablation(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sequences import merge_consecutive

    s, out = derived(spark, d, "segments"), None
    for gap in (0, 50, 300, 3000):
        part = merge_consecutive(s, gap).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_segments")).withColumn("gap_ms", F.lit(gap))
        out = part if out is None else out.unionByName(part)
    return out


@query("st7_alerts")
def alerts(spark: SparkSession, d: str) -> DataFrame:
    return al.batch_alerts(al.probes_of(spark.read.parquet(f"{d}/events.parquet")))
