"""Queries of the interval and sequence operators over the derived transcript tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import intervals as iv
from ..operators import sequences as sq
from ..sources.substrate import derived
from .registry import query, with_tables


def words_of_segments(segments: DataFrame) -> DataFrame:
    """Words of the segments' text spread evenly over their time, with a small fixed jitter of the ends."""
    w = segments.select("file_id", F.col("seg_idx").alias("_seg"), "start_ms", "end_ms", F.size(F.split("text", " ")).alias("_n"), F.posexplode(F.split("text", " ")).alias("_k", "word"))
    at = lambda k: F.col("start_ms") + F.floor(k * (F.col("end_ms") - F.col("start_ms")) / F.col("_n"))
    return w.select("file_id", (F.col("_seg") * 1000 + F.col("_k")).alias("word_idx"), at(F.col("_k")).alias("w_start"), (at(F.col("_k") + 1) + (F.col("_k") % 4) * 15 - 15).alias("w_end"), "word")


_OVER = "least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)"


@query("ag1_wn9_talk_time_ranking", with_tables("segments") + """, t as (select file_id, speaker, sum(end_ms - start_ms)::bigint as total_ms, count(*) as n_segments from segments group by file_id, speaker)
select file_id, speaker, total_ms, n_segments, (total_ms * 1000000 // sum(total_ms) over (partition by file_id))::bigint as share_ppm,
  (row_number() over (partition by file_id order by total_ms desc, speaker) - 1)::int as new_speaker from t""")
def talk_time(spark: SparkSession, d: str) -> DataFrame:
    return sq.ranked_speakers(derived(spark, d, "segments"))


@query("wn9_relabel_by_duration", with_tables("segments") + """, t as (select file_id, speaker, row_number() over (partition by file_id order by sum(end_ms - start_ms) desc, speaker) - 1 as new from segments group by file_id, speaker)
select file_id, seg_idx, start_ms, end_ms, new::bigint as speaker from segments join t using (file_id, speaker)""")
def relabel(spark: SparkSession, d: str) -> DataFrame:
    return sq.relabel_by_duration(derived(spark, d, "segments")).drop("text")


@query("wn1_merge_same_speaker", with_tables("segments") + """, o as (select *, row_number() over (partition by file_id order by seg_idx) as rn from segments), f as (
  select file_id, rn, seg_idx, speaker, end_ms as top, 1 as isl from o where rn = 1
  union all
  select o.file_id, o.rn, o.seg_idx, o.speaker, case when o.speaker = f.speaker and o.start_ms - f.top <= 50 then greatest(f.top, o.end_ms) else o.end_ms end,
    case when o.speaker = f.speaker and o.start_ms - f.top <= 50 then f.isl else f.isl + 1 end from f join o on o.file_id = f.file_id and o.rn = f.rn + 1)
select s.file_id, min(s.seg_idx) as seg_idx, min(s.start_ms) as start_ms, max(s.end_ms) as end_ms, any_value(s.speaker) as speaker, string_agg(s.text, '' order by s.seg_idx) as text, count(*) as n_merged
from segments s join f using (file_id, seg_idx) group by s.file_id, f.isl""")
def merge_same(spark: SparkSession, d: str) -> DataFrame:
    return sq.merge_same_speaker(derived(spark, d, "segments"))


@query("wn2_merge_consecutive", with_tables("segments") + """, m as (select *, case when speaker = lag(speaker) over w and start_ms - lag(end_ms) over w < 3000 then 0 else 1 end as new from segments window w as (partition by file_id order by seg_idx)),
i as (select *, sum(new) over (partition by file_id order by seg_idx) as isl from m)
select file_id, min(seg_idx) as seg_idx, min(start_ms) as start_ms, arg_max(end_ms, seg_idx) as end_ms, any_value(speaker) as speaker, string_agg(text, '' order by seg_idx) as text, count(*) as n_merged from i group by file_id, isl""")
def merge_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return sq.merge_consecutive(derived(spark, d, "segments"))


_NORM = """, c as (select r.file_id, greatest(0, least(start_ms, duration_ms)) as start_ms, greatest(0, least(end_ms, duration_ms)) as end_ms from regions r join files using (file_id)),
k as (select *, max(end_ms) over (partition by file_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as before from c where end_ms - start_ms >= 100),
i as (select *, sum(case when start_ms - before <= 500 then 0 else 1 end) over (partition by file_id order by start_ms, end_ms) as isl from k),
normal as (select file_id, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by file_id, isl)"""


def normal_regions(spark: SparkSession, d: str) -> DataFrame:
    return iv.normalize_regions(derived(spark, d, "regions"), derived(spark, d, "files"))


@query("wn3_normalize_regions", with_tables("regions", "files") + _NORM + " select * from normal")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return normal_regions(spark, d)


@query("wn4_silences_from_speech", with_tables("regions", "files") + _NORM + """, e as (select file_id, start_ms, end_ms from normal union all select file_id, duration_ms, duration_ms from files),
g as (select file_id, coalesce(max(end_ms) over (partition by file_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding), 0) as a, start_ms as b from e)
select file_id, a as start_ms, b as end_ms from g where b > a""")
def silences(spark: SparkSession, d: str) -> DataFrame:
    return iv.complement(normal_regions(spark, d), derived(spark, d, "files"))


@query("wn5_silence_boundaries", with_tables("regions", "files") + _NORM + """, e as (select file_id, start_ms, end_ms from normal union all select file_id, duration_ms, duration_ms from files where file_id in (select file_id from normal)),
g as (select file_id, coalesce(max(end_ms) over (partition by file_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding), 0) as a, start_ms as b from e)
select file_id, a + b as boundary2, a as start_ms, b as end_ms from g where b - a >= 800""")
def boundaries(spark: SparkSession, d: str) -> DataFrame:
    return iv.silence_boundaries(normal_regions(spark, d), derived(spark, d, "files"))


_ATTACH = """, p as (select w.*, s.seg_idx, least(w_end, end_ms) - greatest(w_start, start_ms) as o from words w join segments s on w.file_id = s.file_id and w_start < end_ms and start_ms < w_end),
best as (select * from p where o > 0 qualify row_number() over (partition by file_id, word_idx order by o desc, seg_idx) = 1)"""


@query("jn1_attach_words", with_tables("segments", "words") + _ATTACH + " select file_id, word_idx, w_start, w_end, word, seg_idx from best")
def attach(spark: SparkSession, d: str) -> DataFrame:
    s = derived(spark, d, "segments")
    return iv.attach_words(s, words_of_segments(s))


@query("jn1_word_lists", with_tables("segments", "words") + _ATTACH + """ select s.file_id, s.seg_idx, b.n_words, b.first_word, b.last_end from segments s left join
(select file_id, seg_idx, count(*)::int as n_words, arg_min(word, word_idx) as first_word, arg_max(w_end, word_idx) as last_end from best group by all) b using (file_id, seg_idx)""")
def word_lists(spark: SparkSession, d: str) -> DataFrame:
    s = derived(spark, d, "segments")
    lists = iv.attach_word_lists(s, words_of_segments(s))
    return lists.select("file_id", "seg_idx", F.when(F.col("words").isNotNull(), F.size("words")).alias("n_words"), F.get("words", F.lit(0))["text"].alias("first_word"), F.element_at("words", -1)["end_ms"].alias("last_end"))


_CHUNKS = ", chunks as (select file_id, seg_idx as chunk_idx, start_ms + 300 as c_start, end_ms + 700 as c_end, text from segments where seg_idx % 2 = 0)"


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    s = derived(spark, d, "segments").where("seg_idx % 2 = 0")
    return s.select("file_id", F.col("seg_idx").alias("chunk_idx"), (F.col("start_ms") + 300).alias("c_start"), (F.col("end_ms") + 700).alias("c_end"), "text")


@query("jn2_clip_chunks_to_turns", with_tables("segments", "turns") + _CHUNKS + """, p as (select c.file_id, chunk_idx, turn_idx, greatest(c_start, start_ms) as part_start, least(c_end, end_ms) as part_end, speaker from chunks c join turns t on c.file_id = t.file_id and least(c_end, end_ms) - greatest(c_start, start_ms) > 30),
n as (select c.file_id, chunk_idx, -1 as turn_idx, c_start, c_end, speaker from chunks c join turns t on c.file_id = t.file_id where (c.file_id, chunk_idx) not in (select (file_id, chunk_idx) from p)
  qualify row_number() over (partition by c.file_id, chunk_idx order by least(abs(2 * start_ms - c_start - c_end), abs(2 * end_ms - c_start - c_end)), start_ms, turn_idx) = 1)
select * from p union all select * from n""")
def clip_chunks(spark: SparkSession, d: str) -> DataFrame:
    return iv.clip_chunks_to_turns(chunk_table(spark, d).drop("text"), derived(spark, d, "turns"))


@query("jn3_filter_spurious_speakers", with_tables("turns", "files") + """, t as (select file_id, speaker, sum(end_ms - start_ms) as total from turns group by all),
k as (select u.*, t.total < greatest(2000, 0.01 * duration_ms) as bad from turns u join t using (file_id, speaker) join files using (file_id)),
n as (select a.file_id, a.turn_idx, b.speaker from k a join k b on a.file_id = b.file_id and a.bad and not b.bad qualify row_number() over (partition by a.file_id, a.turn_idx order by abs(a.start_ms + a.end_ms - b.start_ms - b.end_ms), b.turn_idx) = 1)
select k.file_id, k.turn_idx, k.start_ms, k.end_ms, coalesce(n.speaker, k.speaker) as speaker from k left join n using (file_id, turn_idx)""")
def spurious(spark: SparkSession, d: str) -> DataFrame:
    return iv.filter_spurious_speakers(derived(spark, d, "turns"), derived(spark, d, "files"))


@query("jn4_speaker_by_total_overlap", with_tables("segments", "turns") + f""", p as (select a.file_id, a.seg_idx, 'Speaker' || (b.speaker + 1) as label, sum({_OVER}) as ms from segments a join turns b on a.file_id = b.file_id and {_OVER} > 0 group by all),
best as (select file_id, seg_idx, label from p qualify row_number() over (partition by file_id, seg_idx order by ms desc, label desc) = 1),
n as (select a.file_id, a.seg_idx, 'Speaker' || (b.speaker + 1) as label from segments a join turns b on a.file_id = b.file_id where (a.file_id, a.seg_idx) not in (select (file_id, seg_idx) from best)
  qualify row_number() over (partition by a.file_id, a.seg_idx order by abs(a.start_ms + a.end_ms - b.start_ms - b.end_ms), b.turn_idx) = 1)
select * from best union all select * from n""")
def by_total(spark: SparkSession, d: str) -> DataFrame:
    return iv.speaker_by_total_overlap(derived(spark, d, "segments"), derived(spark, d, "turns"))


@query("jn5_assign_items", with_tables("segments", "silences", "turns") + """, items as (select file_id, start_ms as item_idx, start_ms as i_start, end_ms as i_end from silences qualify row_number() over (partition by file_id, start_ms order by end_ms) = 1),
p as (select i.*, t.*, least(i_end, end_ms) - greatest(i_start, start_ms) as o, start_ms <= i_start and end_ms >= i_end as c from items i join turns t on i.file_id = t.file_id)
select file_id, item_idx, speaker, case when o > 0 then least(1000, o * 1000 // greatest(i_end - i_start, 1)) when c then 500 else 0 end::bigint as confidence_milli from p
qualify row_number() over (partition by file_id, item_idx order by case when o > 0 then 0 when c then 1 else 2 end, case when o > 0 then -o when c then end_ms - start_ms else least(abs(i_start - end_ms), abs(start_ms - i_end)) end, turn_idx) = 1""")
def assign(spark: SparkSession, d: str) -> DataFrame:
    items = derived(spark, d, "silences").groupBy("file_id", "start_ms").agg(F.min("end_ms").alias("i_end")).select("file_id", F.col("start_ms").alias("item_idx"), F.col("start_ms").alias("i_start"), "i_end")
    return iv.assign_items(items, derived(spark, d, "turns"))


def even(x: str) -> str:
    """SQL: half of x, a half rounded to even."""
    return f"(case when {x} % 2 = 0 then {x} // 2 when ({x} // 2) % 2 = 0 then {x} // 2 else {x} // 2 + 1 end)"


@query("jn8_snap_to_silence", with_tables("segments", "silences") + f""", s as (select *, row_number() over (partition by file_id order by seg_idx) = 1 as f, row_number() over (partition by file_id order by seg_idx desc) = 1 as l from segments),
pts as (select file_id, seg_idx, 's' as k, start_ms as ts from s where not f union all select file_id, seg_idx, 'e', end_ms from s where not l),
c as (select p.file_id, p.seg_idx, p.k, p.ts, x.start_ms + x.end_ms as m2, p.ts between x.start_ms and x.end_ms as inside, x.start_ms, x.end_ms from pts p join silences x on p.file_id = x.file_id),
near as (select file_id, seg_idx, k, m2 from c where abs(2 * ts - m2) < 4000 qualify row_number() over (partition by file_id, seg_idx, k order by abs(2 * ts - m2), start_ms, end_ms) = 1),
ins as (select distinct file_id, seg_idx, k from c where inside),
t as (select p.file_id, p.seg_idx, p.k, case when i.k is not null then 2 * p.ts else n.m2 end as t2 from pts p left join near n using (file_id, seg_idx, k) left join ins i using (file_id, seg_idx, k)),
b as (select s.*, a.t2 as s2, e.t2 as e2 from s left join t a on a.file_id = s.file_id and a.seg_idx = s.seg_idx and a.k = 's' left join t e on e.file_id = s.file_id and e.seg_idx = s.seg_idx and e.k = 'e'),
n as (select *, case when s2 is not null and s2 <> 2 * start_ms and 2 * end_ms - s2 >= 200 then {even('s2')} else start_ms end as new_start from b)
select file_id, seg_idx, new_start, case when e2 is not null and e2 <> 2 * end_ms and e2 - 2 * new_start >= 200 then {even('e2')} else end_ms end as new_end from n""")
def snap(spark: SparkSession, d: str) -> DataFrame:
    return iv.snap_segments(derived(spark, d, "segments"), derived(spark, d, "silences"))


def windows_of(spark: SparkSession, d: str, size: int) -> DataFrame:
    w = derived(spark, d, "files").select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("duration_ms"), F.lit(0)) / size))).alias("window_idx"), F.col("duration_ms"))
    return w.select("file_id", F.col("window_idx"), (F.col("window_idx") * size).alias("win_start"), (F.col("window_idx") * size + size).alias("win_end"))


def _windows(size: int) -> str:
    return f", windows as (select file_id, k as window_idx, k * {size} as win_start, k * {size} + {size} as win_end from (select file_id, unnest(range(greatest(duration_ms, 0) // {size} + 1)) as k from files))"


@query("jn9_window_silences", with_tables("segments", "silences", "files") + _windows(5000) + """ select w.file_id, w.window_idx, count(x.start_ms) as n, coalesce(sum(least(x.end_ms, win_end) - greatest(x.start_ms, win_start)) filter (x.start_ms is not null), 0)::bigint as overlap_ms
from windows w left join silences x on w.file_id = x.file_id and least(x.end_ms, win_end) > greatest(x.start_ms, win_start) group by all""")
def window_silences(spark: SparkSession, d: str) -> DataFrame:
    return iv.window_overlaps(windows_of(spark, d, 5000), derived(spark, d, "silences"))


@query("jn10_words_to_pieces", with_tables("segments", "files", "words") + _windows(2500) + """ select word.file_id, word_idx, window_idx as piece_idx from words word join (select *, lead(window_idx) over (partition by file_id order by window_idx) is null as l from windows) w
on word.file_id = w.file_id and w_start + w_end >= 2 * win_start and (w_start + w_end < 2 * win_end or (l and w_start + w_end = 2 * win_end))""")
def pieces(spark: SparkSession, d: str) -> DataFrame:
    p = windows_of(spark, d, 2500).select("file_id", F.col("window_idx").alias("piece_idx"), F.col("win_start").alias("p_start"), F.col("win_end").alias("p_end"))
    return iv.words_to_pieces(words_of_segments(derived(spark, d, "segments")), p)


@query("jn11_first_container", with_tables("segments", "files") + _windows(6000) + """, p as (select s.file_id, seg_idx, window_idx, greatest(start_ms - win_start, 0) // 40000 as chunk_idx from segments s join windows w on s.file_id = w.file_id and start_ms + 1 between win_start - 500 and win_end + 500)
select * from p qualify row_number() over (partition by file_id, seg_idx order by window_idx) = 1""")
def container(spark: SparkSession, d: str) -> DataFrame:
    return iv.first_container(derived(spark, d, "segments"), windows_of(spark, d, 6000))


@query("jn22_nearest_edges", with_tables("segments", "turns") + """ select s.file_id, s.seg_idx as point_id, bool_or(s.end_ms > t.start_ms and s.end_ms < t.end_ms) as inside, min(least(abs(s.end_ms - t.start_ms), abs(s.end_ms - t.end_ms))) as edge_ms
from segments s join turns t on s.file_id = t.file_id group by all""")
def edges(spark: SparkSession, d: str) -> DataFrame:
    return iv.nearest_edges(derived(spark, d, "segments").select("file_id", F.col("seg_idx").alias("point_id"), F.col("end_ms").alias("at_ms")), derived(spark, d, "turns"))


@query("prj6_prj7_clip_turns", with_tables("turns") + """ select file_id, turn_idx, greatest(start_ms, 3000) - 3000 as start_ms, least(end_ms, 9000) - 3000 as end_ms, speaker from turns where least(end_ms, 9000) - greatest(start_ms, 3000) >= 50""")
def clip(spark: SparkSession, d: str) -> DataFrame:
    return iv.clip_to_window(derived(spark, d, "turns"), 3000, 9000)


@query("wn10_switches", with_tables("segments") + """, m as (select *, lag(speaker) over w as p, lead(speaker) over w as n from segments window w as (partition by file_id order by seg_idx))
select file_id, count(*) filter (p <> speaker) as n_switches, coalesce(bool_or(p = n and p <> speaker and end_ms - start_ms <= 1500), false) as has_aba from m group by file_id""")
def switch_counts(spark: SparkSession, d: str) -> DataFrame:
    return sq.switches(derived(spark, d, "segments"))


@query("wn15_tight_boundaries", with_tables("segments") + """ select file_id, seg_idx, coalesce(abs(start_ms - lag(end_ms) over w) <= 250, false) as tight_left, coalesce(abs(lead(start_ms) over w - end_ms) <= 250, false) as tight_right, end_ms - start_ms <= 1000 as very_short
from segments window w as (partition by file_id order by seg_idx)""")
def tight(spark: SparkSession, d: str) -> DataFrame:
    return sq.tight_boundaries(derived(spark, d, "segments"))


@query("wn19_linear_text_cuts", with_tables("segments", "turns") + """, txt as (select file_id, string_agg(text, '' order by seg_idx) as text from segments group by file_id),
c as (select t.*, text, length(text) as n, sum(end_ms - start_ms) over w as upto, sum(end_ms - start_ms) over (partition by t.file_id) as total, lead(turn_idx) over w is null as l from turns t join txt using (file_id) window w as (partition by t.file_id order by start_ms, turn_idx)),
r as (select *, case when l then n else least(round_even(upto::double * n / total, 0)::bigint, n) end as cut from c),
m as (select *, max(cut) over (partition by file_id order by start_ms, turn_idx) as ce from r), z as (select *, coalesce(lag(ce) over (partition by file_id order by start_ms, turn_idx), 0) as cs from m)
select file_id, turn_idx, start_ms, end_ms, speaker, substr(text, cs + 1, ce - cs) as piece from z""")
def linear_cuts(spark: SparkSession, d: str) -> DataFrame:
    s = derived(spark, d, "segments")
    text = s.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), "").alias("text"))
    return sq.linear_text_cuts(derived(spark, d, "turns"), text)


_FRAMES = ", fr as (select distinct file_id, speaker, frame from (select file_id, speaker, unnest(range((start_ms // 100)::bigint, (end_ms // 100)::bigint)) as frame from turns))"


def frames_of(spark: SparkSession, d: str) -> DataFrame:
    t = derived(spark, d, "turns").select("file_id", "speaker", F.floor(F.col("start_ms") / 100).alias("a"), (F.floor(F.col("end_ms") / 100) - 1).alias("b")).where("b >= a")
    return t.select("file_id", "speaker", F.explode(F.sequence("a", "b")).alias("frame")).distinct()


@query("wn11_frames_to_turns", with_tables("turns") + _FRAMES + """, r as (select file_id, speaker, min(frame) * 100 as start_ms, max(frame) * 100 + 100 as end_ms from (select *, frame - row_number() over (partition by file_id, speaker order by frame) as g from fr) group by file_id, speaker, g),
i as (select *, sum(case when d <= 300 then 0 else 1 end) over (partition by file_id, speaker order by start_ms) as isl from (select *, start_ms - lag(end_ms) over (partition by file_id, speaker order by start_ms) as d from r))
select file_id, speaker, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by file_id, speaker, isl having max(end_ms) - min(start_ms) > 500""")
def frames_to_turns(spark: SparkSession, d: str) -> DataFrame:
    return sq.runs_to_turns(frames_of(spark, d), 100, 500, 300)


@query("wn12_sample_ranges", with_tables("turns") + _FRAMES + """, one as (select file_id, frame, min(speaker) as speaker from fr group by file_id, frame having count(*) = 1),
r as (select file_id, speaker, min(frame) * 1600 as first_sample, max(frame) * 1600 + 1600 as end_sample, count(*) as n from (select *, frame - row_number() over (partition by file_id, speaker order by frame) as g from one) group by file_id, speaker, g)
select file_id, speaker, first_sample, end_sample from r where n >= 10""")
def sample_ranges(spark: SparkSession, d: str) -> DataFrame:
    return sq.sample_ranges(frames_of(spark, d))


_ACTIVITY = """, act as (select file_id, (start_ms // 1000)::bigint as frame, speaker, sum(end_ms - start_ms)::bigint as score from turns group by all),
cnt as (select file_id, frame, floor(avg(score) / 1000.0 + 0.5)::int as k from act group by all)"""


@query("ag20_wn13_top_speakers_per_frame", with_tables("turns") + _ACTIVITY + """ select file_id, frame, speaker, score, k from act join cnt using (file_id, frame) qualify row_number() over (partition by file_id, frame order by score desc, speaker) <= k""")
def top_per_frame(spark: SparkSession, d: str) -> DataFrame:
    act = derived(spark, d, "turns").groupBy("file_id", F.floor(F.col("start_ms") / 1000).alias("frame"), "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("score"))
    return sq.top_speakers_per_frame(sq.speakers_per_frame(act, 1000))


@query("ag21_jn21_speaker_count_grid", with_tables("turns") + _FRAMES + """ select f.file_id, f.frame, m.cluster, count(*) as n from fr f join (values (0, 0), (1, 1), (2, 0)) m(speaker, cluster) using (speaker) group by all""")
def count_grid(spark: SparkSession, d: str) -> DataFrame:
    mapped = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "speaker int, cluster int")
    return sq.speaker_count_grid(frames_of(spark, d), mapped)


@query("src5_st11_sliding_windows", with_tables("segments", "files") + """ select file_id, k as window_idx, k * 1000 as first_ms, least(k * 1000 + 10000, duration_ms) as end_ms, greatest(k * 1000 + 10000 - duration_ms, 0) as pad_ms from (select *, unnest(range(case when duration_ms <= 10000 then 1 else (duration_ms - 10000 + 999) // 1000 + 1 end)) as k from files where duration_ms > 0)""")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return iv.sliding_windows(derived(spark, d, "files"))


@query("ag12_alignment_in_silence", with_tables("segments", "silences") + """, b as (select distinct file_id, end_ms as ts from segments),
m as (select b.file_id, b.ts, bool_or(ts between start_ms and end_ms) as inside, min(least(abs(ts - start_ms), abs(ts - end_ms))) as edge from b left join silences x on x.file_id = b.file_id group by all)
select file_id, count(*) as n, count(*) filter (inside) as n_inside, count(*) filter (not inside and edge <= 300) as n_near, (count(*) filter (inside or edge <= 300) * 1000 // count(*))::bigint as ratio_milli from m group by file_id""")
def alignment(spark: SparkSession, d: str) -> DataFrame:
    return ev.alignment_in_silence(derived(spark, d, "segments"), derived(spark, d, "silences"))


@query("ag13_output_analysis", with_tables("segments") + """, b as (select *, end_ms - start_ms as dur, lag(speaker) over (partition by file_id order by seg_idx) as p from segments)
select file_id, count(*) as n, (list_sort(list(dur)))[count(*) // 2 + 1] as median_ms, max(dur) as max_ms, sum(dur)::bigint as total_ms, count(*) filter (dur < 500) as b0, count(*) filter (dur >= 500 and dur < 1500) as b1, count(*) filter (dur >= 1500 and dur < 3000) as b2, count(*) filter (dur >= 3000) as b3,
  (count(*) filter (p <> speaker) * 60000000 // greatest(max(end_ms), 1))::bigint as switches_per_1000_min from b group by file_id""")
def output_analysis(spark: SparkSession, d: str) -> DataFrame:
    return ev.output_analysis(derived(spark, d, "segments"))


@query("ag14_drift_report", with_tables("segments", "turns") + """, d as (select s.file_id, abs(s.start_ms - t.start_ms) as x from segments s join turns t on s.file_id = t.file_id and s.seg_idx = t.turn_idx)
select file_id, count(*) as n, sum(x)::bigint as sum_ms, (list_sort(list(x)))[count(*) // 2 + 1] as p50, (list_sort(list(x)))[count(*) * 9 // 10 + 1] as p90, count(*) filter (x <= 100) as hit_100, count(*) filter (x <= 200) as hit_200, count(*) filter (x <= 500) as hit_500, max(x) as max_ms from d group by file_id""")
def drift(spark: SparkSession, d: str) -> DataFrame:
    t = derived(spark, d, "turns").select("file_id", F.col("turn_idx").alias("seg_idx"), F.col("start_ms").alias("t"))
    return ev.drift_report(derived(spark, d, "segments").join(t, ["file_id", "seg_idx"]).select("file_id", F.abs(F.col("start_ms") - F.col("t")).alias("x")))


@query("ag22_role_by_text_mass", with_tables("segments") + """, m as (select file_id, speaker, sum(length(text))::bigint as chars from segments group by all)
select *, case when row_number() over (partition by file_id order by chars desc, speaker) = 1 then 'dominant' else 'minority' end as role from m""")
def roles(spark: SparkSession, d: str) -> DataFrame:
    return ev.roles_by_text(derived(spark, d, "segments"))


@query("ag23_se3_sorted_speakers", with_tables("segments") + """ select file_id, array_to_string(list_sort(list(distinct 'Speaker' || (speaker * 5 + 1))), ',') as speakers from segments group by file_id""")
def sorted_speakers(spark: SparkSession, d: str) -> DataFrame:
    return sq.sorted_speakers(derived(spark, d, "segments").withColumn("speaker", F.col("speaker") * 5))


@query("so1_so2_longest_per_speaker", with_tables("segments") + """ select file_id, speaker, seg_idx, end_ms - start_ms as dur_ms from segments qualify row_number() over (partition by file_id, speaker order by end_ms - start_ms desc, seg_idx) <= 2""")
def longest(spark: SparkSession, d: str) -> DataFrame:
    return sq.top_longest(derived(spark, d, "segments").select("file_id", "speaker", "seg_idx", (F.col("end_ms") - F.col("start_ms")).alias("dur_ms")), 2)


@query("se1_union_rewritten", with_tables("segments", "turns") + """ select file_id, seg_idx, start_ms, end_ms from segments where (file_id, seg_idx) not in (select (file_id, turn_idx) from turns where speaker = 1) union all select file_id, turn_idx, start_ms, end_ms from turns where speaker = 1""")
def union_rewritten(spark: SparkSession, d: str) -> DataFrame:
    new = derived(spark, d, "turns").where("speaker = 1").select("file_id", F.col("turn_idx").alias("seg_idx"), "start_ms", "end_ms")
    return ev.rewritten(derived(spark, d, "segments").select("file_id", "seg_idx", "start_ms", "end_ms"), new)


@query("jn23_parity_with_golden", with_tables("segments", "turns") + """ select coalesce(s.file_id, t.file_id) as file_id, count(*) as n, count(*) filter (s.seg_idx is null or t.turn_idx is null) as n_unmatched, count(*) filter (abs(s.start_ms - t.start_ms) <= 50 and abs(s.end_ms - t.end_ms) <= 50) as n_close
from segments s full join turns t on s.file_id = t.file_id and s.seg_idx = t.turn_idx group by 1""")
def parity(spark: SparkSession, d: str) -> DataFrame:
    t = derived(spark, d, "turns").withColumnRenamed("turn_idx", "seg_idx")
    return ev.parity(derived(spark, d, "segments"), t)


@query("prj6_offset_segments", with_tables("segments") + " select file_id, seg_idx, start_ms + 90000 as start_ms, end_ms + 90000 as end_ms, speaker, text from segments")
def offset(spark: SparkSession, d: str) -> DataFrame:
    return iv.offset_times(derived(spark, d, "segments"), 90_000)


_POWERSET = """ select vec_id as frame, coalesce(c in (2, 5, 6), false) as slot0, coalesce(c in (3, 5, 7), false) as slot1, coalesce(c in (4, 6, 7), false) as slot2 from (select vec_id, list_position(embedding[1:7], list_max(embedding[1:7])) as c from embeddings)"""


@query("wn14_powerset", _POWERSET)
def powerset(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.slice("embedding", 1, 7).alias("scores"))
    return sq.powerset_active(e, "scores").drop("scores")


@query("wn14_exclude_overlap", with_tables("turns") + _FRAMES + " select file_id, frame, min(speaker) as speaker from fr group by file_id, frame having count(*) = 1")
def without_overlap(spark: SparkSession, d: str) -> DataFrame:
    return sq.exclude_overlap(frames_of(spark, d))
