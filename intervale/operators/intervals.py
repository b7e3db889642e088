"""Interval joins and interval sets, keyed by file. Times are integer milliseconds.

Overlap joins meet on (file, time bucket): each interval goes to the buckets that it touches, and a pair is made only
in the bucket where the later of the two begins, so no pair appears twice and one long file spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 60_000


def _buckets(start: Column, end: Column, bucket_ms: int) -> Column:
    first = F.floor(start / bucket_ms)
    return F.explode(F.sequence(first, F.greatest(first, F.floor(end / bucket_ms))))


def overlap_join(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, key: str = "file_id", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of one file whose closed intervals meet. Other column names of the two sides must differ."""
    x = left.withColumn("_bucket", _buckets(F.col(l_start), F.col(l_end), bucket_ms))
    y = right.withColumn("_bucket", _buckets(F.col(r_start), F.col(r_end), bucket_ms))
    later = F.floor(F.greatest(l_start, r_start) / bucket_ms)
    return x.join(y, [key, "_bucket"]).where((F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end)) & (F.col("_bucket") == later)).drop("_bucket")


def nearest(points: DataFrame, at: Column, targets: DataFrame, place: Column, order: Column, value: Column) -> DataFrame:
    """points with _near: the value of the target of the same file whose place is nearest to at (a tie: the least order),
    null where the file has none, and _away: the distance. An as-of join: targets and points in one ordering by place,
    each point between the last target before and the first after it, n log n for a file. All columns are whole numbers
    or structs that can be ordered."""
    best = targets.groupBy("file_id", place.alias("_place")).agg(F.min(F.struct(order.alias("o"), value.alias("v"))).alias("_t"))
    here = points.select("file_id", at.alias("_place"), F.struct(*points.columns).alias("_p"))
    both = here.unionByName(best, allowMissingColumns=True).withColumn("_target", F.when(F.col("_t").isNotNull(), F.struct("_place", "_t.o", "_t.v")))
    w = Window.partitionBy("file_id")
    known = both.withColumn("_low", F.last("_target", True).over(w.orderBy("_place").rangeBetween(Window.unboundedPreceding, 0))).withColumn("_high", F.last("_target", True).over(w.orderBy(F.desc("_place")).rangeBetween(Window.unboundedPreceding, 0)))
    sides = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._place") - F.col("_place")).alias("d"), F.col(f"{c}.o").alias("o"), F.col(f"{c}.v").alias("v"))) for c in ("_low", "_high")]
    found = known.where("_p is not null").withColumn("_best", F.array_min(F.array_compact(F.array(*sides))))
    return found.select("_p.*", F.col("_best.v").alias("_near"), F.col("_best.d").alias("_away"))


def overlap_ms(a_start: str, a_end: str, b_start: str, b_end: str) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def attach_words(segments: DataFrame, words: DataFrame, bucket_ms: int = 5_000) -> DataFrame:
    """Each word goes to the segment it overlaps most (strictly; a tie: the earliest); others are dropped.

    segments: file_id, seg_idx, start_ms, end_ms; words: file_id, word_idx, w_start, w_end, word.
    """
    pairs = overlap_join(words, segments.select("file_id", "seg_idx", "start_ms", "end_ms"), "w_start", "w_end", "start_ms", "end_ms", bucket_ms=bucket_ms)
    over = overlap_ms("w_start", "w_end", "start_ms", "end_ms")
    best = pairs.where(over > 0).groupBy("file_id", "word_idx").agg(F.min(F.struct((-over).alias("_o"), "seg_idx", "w_start", "w_end", "word")).alias("_b"))
    return best.select("file_id", "word_idx", "_b.w_start", "_b.w_end", "_b.word", "_b.seg_idx")


def attach_word_lists(segments: DataFrame, words: DataFrame) -> DataFrame:
    """segments with the words that fell to them in input order; null where none did."""
    lists = attach_words(segments, words).groupBy("file_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", F.col("word").alias("text"), F.col("w_start").alias("start_ms"), F.col("w_end").alias("end_ms")))).alias("words"))
    return segments.join(lists, ["file_id", "seg_idx"], "left")


def clip_chunks_to_turns(chunks: DataFrame, turns: DataFrame, least_ms: int = 30) -> DataFrame:
    """Parts of chunks under each turn that overlaps by more than least_ms; a chunk with none takes the speaker of the
    turn with an edge nearest to its middle (a tie: the first turn).

    chunks: file_id, chunk_idx, c_start, c_end; turns: file_id, turn_idx, start_ms, end_ms, speaker.
    """
    pairs = overlap_join(chunks, turns, "c_start", "c_end", "start_ms", "end_ms").where(overlap_ms("c_start", "c_end", "start_ms", "end_ms") > least_ms)
    parts = pairs.select("file_id", "chunk_idx", "turn_idx", F.greatest("c_start", "start_ms").alias("part_start"), F.least("c_end", "end_ms").alias("part_end"), "speaker")
    bare = chunks.where("c_end > c_start").join(parts.select("file_id", "chunk_idx").distinct(), ["file_id", "chunk_idx"], "left_anti")
    edges = turns.select("file_id", "speaker", F.struct("start_ms", "turn_idx").alias("_o"), F.explode(F.array("start_ms", "end_ms")).alias("_edge"))
    near = nearest(bare, F.col("c_start") + F.col("c_end"), edges, F.col("_edge") * 2, F.col("_o"), F.col("speaker")).where("_away is not null").withColumnRenamed("_near", "speaker")
    return parts.unionByName(near.select("file_id", "chunk_idx", F.lit(-1).cast("long").alias("turn_idx"), F.col("c_start").alias("part_start"), F.col("c_end").alias("part_end"), "speaker"))


def filter_spurious_speakers(turns: DataFrame, files: DataFrame, least_ms: int = 2000, least_share: float = 0.01) -> DataFrame:
    """Turns of a speaker with less than max(least_ms, least_share of the file) take the speaker of the valid turn with
    the nearest middle (a tie: the first); a file without a valid speaker stays as it is."""
    totals = turns.groupBy("file_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("_total"))
    judged = totals.join(files, "file_id", "left").select("file_id", "speaker", (F.col("_total") < F.greatest(F.lit(float(least_ms)), least_share * F.coalesce("duration_ms", F.lit(0)))).alias("_spurious"))
    known = turns.join(judged, ["file_id", "speaker"])
    middle = F.col("start_ms") + F.col("end_ms")
    moved = nearest(known.where("_spurious"), middle, known.where(~F.col("_spurious")), middle, F.col("turn_idx"), F.col("speaker"))
    columns = ["file_id", "turn_idx", "start_ms", "end_ms"]
    return known.where(~F.col("_spurious")).select(*columns, "speaker").unionByName(moved.select(*columns, F.coalesce("_near", "speaker").alias("speaker")))


def speaker_by_total_overlap(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Each segment's speaker by summed overlap (a tie: the larger label as text); none: the nearest middle."""
    t = turns.select("file_id", F.col("turn_idx").alias("_turn"), F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"), F.concat(F.lit("Speaker"), F.col("speaker") + 1).alias("label"))
    s = segments.select("file_id", "seg_idx", "start_ms", "end_ms")
    over = overlap_ms("start_ms", "end_ms", "t_start", "t_end")
    sums = overlap_join(s, t, "start_ms", "end_ms", "t_start", "t_end").where(over > 0).groupBy("file_id", "seg_idx", "label").agg(F.sum(over).alias("ms"))
    best = sums.groupBy("file_id", "seg_idx").agg(F.max_by("label", F.struct("ms", "label")).alias("label"))
    bare = s.join(best, ["file_id", "seg_idx"], "left_anti")
    near = nearest(bare, F.col("start_ms") + F.col("end_ms"), t, F.col("t_start") + F.col("t_end"), F.col("_turn"), F.col("label"))
    return best.unionByName(near.where("_away is not null").select("file_id", "seg_idx", F.col("_near").alias("label")))


def assign_items(items: DataFrame, intervals: DataFrame) -> DataFrame:
    """(speaker, confidence in thousandths) of each item: the interval with most overlap (overlap over duration, 1000 at
    most), else the smallest containing one (500), else the one with the nearest edge (0).

    items: file_id, item_idx, i_start, i_end; intervals: file_id, turn_idx, start_ms, end_ms, speaker.
    """
    over = overlap_ms("i_start", "i_end", "start_ms", "end_ms")
    inside = (F.col("start_ms") <= F.col("i_start")) & (F.col("end_ms") >= F.col("i_end"))
    tier = F.when(over > 0, 0).otherwise(1)
    rank = F.struct(tier, F.when(over > 0, -over).otherwise(F.col("end_ms") - F.col("start_ms")), "turn_idx")
    sure = F.when(over > 0, F.least(F.lit(1000), F.floor(over * 1000 / F.greatest(F.col("i_end") - F.col("i_start"), F.lit(1))))).otherwise(500)
    met = overlap_join(items, intervals, "i_start", "i_end", "start_ms", "end_ms").where((over > 0) | inside)
    best = met.groupBy("file_id", "item_idx").agg(F.min_by(F.struct("speaker", sure.cast("long").alias("sure")), rank).alias("_b"))
    held = best.select("file_id", "item_idx", F.col("_b.speaker").alias("speaker"), F.col("_b.sure").alias("confidence_milli"))
    # What meets nothing lies between intervals: the last end before it or the first start after it is the nearest edge.
    bare = items.select("file_id", "item_idx", "i_start", "i_end").join(held, ["file_id", "item_idx"], "left_anti")
    before = last_before(bare, F.col("i_start"), intervals, F.col("end_ms"))
    both = last_before(before, -F.col("i_end"), intervals, -F.col("start_ms"))
    sides = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - edge).alias("d"), F.col(f"{c}.o").alias("o"), F.col(f"{c}.v").alias("v"))) for c, edge in (("_found", F.col("i_start")), ("_found2", -F.col("i_end")))]
    near = both.withColumn("_near", F.array_min(F.array_compact(F.array(*sides)))).where("_near is not null")
    return held.unionByName(near.select("file_id", "item_idx", F.col("_near.v").alias("speaker"), F.lit(0).cast("long").alias("confidence_milli")))


def last_before(points: DataFrame, at: Column, intervals: DataFrame, place: Column) -> DataFrame:
    """points with _found (or _found2, if that is taken): at, o (turn_idx) and v (speaker) of the interval of the file
    with the largest place that is not beyond `at` (a tie: the least turn_idx); null: none."""
    best = intervals.groupBy("file_id", place.alias("_place")).agg(F.min(F.struct(F.col("turn_idx").alias("o"), F.col("speaker").alias("v"))).alias("_t"))
    both = points.select("file_id", at.alias("_place"), F.struct(*points.columns).alias("_p")).unionByName(best, allowMissingColumns=True)
    target = F.when(F.col("_t").isNotNull(), F.struct(F.col("_place").alias("at"), "_t.o", "_t.v"))
    last = F.last(target, True).over(Window.partitionBy("file_id").orderBy("_place").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_last", last).where("_p is not null").select("_p.*", F.col("_last").alias("_found2" if "_found" in points.columns else "_found"))


def snap_targets(points: DataFrame, silences: DataFrame, tolerance_ms: int) -> DataFrame:
    """point columns and target2 (twice the target): the point itself inside a silence, else the middle of the nearest
    silence strictly within the tolerance (a tie: the first), else null. points: file_id, point_id, at_ms."""
    s = silences.select("file_id", F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"))
    p = points.withColumn("p_low", F.col("at_ms") - tolerance_ms - 1).withColumn("p_high", F.col("at_ms") + tolerance_ms + 1)
    # A silence whose middle lies within the tolerance need not touch the point: pairs come from the middles, or contain.
    mids = s.withColumn("m_low", F.floor((F.col("s_start") + F.col("s_end")) / 2)).withColumn("m_high", F.ceil((F.col("s_start") + F.col("s_end")) / 2))
    away = F.abs(F.col("s_start") + F.col("s_end") - 2 * F.col("at_ms"))
    near = overlap_join(p, mids, "p_low", "p_high", "m_low", "m_high").where(away < 2 * tolerance_ms).groupBy("file_id", "point_id").agg(F.min_by(F.col("s_start") + F.col("s_end"), F.struct(away, "s_start", "s_end")).alias("_near"))
    inside = overlap_join(points.withColumn("p_end", F.col("at_ms")), s, "at_ms", "p_end", "s_start", "s_end").select("file_id", "point_id").distinct().withColumn("_inside", F.lit(True))
    found = points.join(near, ["file_id", "point_id"], "left").join(inside, ["file_id", "point_id"], "left")
    return found.select(*points.columns, F.when(F.col("_inside"), 2 * F.col("at_ms")).otherwise(F.col("_near")).alias("target2"))


def snap_segments(segments: DataFrame, silences: DataFrame, tolerance_ms: int = 2000, least_ms: int = 100) -> DataFrame:
    """Starts and ends moved to silences, each by itself, the end after the start; never a file's first start or last
    end, nor where the segment would become shorter than least_ms. Half milliseconds round to even."""
    s = segments.select("file_id", "seg_idx", "start_ms", "end_ms", (F.lag("seg_idx").over(Window.partitionBy("file_id").orderBy("seg_idx")).isNull()).alias("_first"), (F.lead("seg_idx").over(Window.partitionBy("file_id").orderBy("seg_idx")).isNull()).alias("_last"))
    points = s.where(~F.col("_first")).select("file_id", (F.col("seg_idx") * 2).alias("point_id"), F.col("start_ms").alias("at_ms")).unionByName(s.where(~F.col("_last")).select("file_id", (F.col("seg_idx") * 2 + 1).alias("point_id"), F.col("end_ms").alias("at_ms")))
    targets = snap_targets(points, silences, tolerance_ms).select("file_id", "point_id", "target2")
    starts = targets.where("point_id % 2 = 0").select("file_id", F.expr("point_id div 2").alias("seg_idx"), F.col("target2").alias("_s2"))
    ends = targets.where("point_id % 2 = 1").select("file_id", F.expr("point_id div 2").alias("seg_idx"), F.col("target2").alias("_e2"))
    joined = s.join(starts, ["file_id", "seg_idx"], "left").join(ends, ["file_id", "seg_idx"], "left")
    to_ms = lambda c: F.bround(F.col(c) / 2).cast("long")
    moves = F.col("_s2").isNotNull() & (F.col("_s2") != 2 * F.col("start_ms")) & (2 * F.col("end_ms") - F.col("_s2") >= 2 * least_ms)
    begun = joined.withColumn("new_start", F.when(moves, to_ms("_s2")).otherwise(F.col("start_ms")))
    ends_move = F.col("_e2").isNotNull() & (F.col("_e2") != 2 * F.col("end_ms")) & (F.col("_e2") - 2 * F.col("new_start") >= 2 * least_ms)
    return begun.select("file_id", "seg_idx", "new_start", F.when(ends_move, to_ms("_e2")).otherwise(F.col("end_ms")).alias("new_end"))


def window_overlaps(windows: DataFrame, silences: DataFrame) -> DataFrame:
    """Number and total overlap of the silences in each window. windows: file_id, window_idx, win_start, win_end."""
    over = overlap_ms("win_start", "win_end", "start_ms", "end_ms")
    hit = overlap_join(windows, silences, "win_start", "win_end", "start_ms", "end_ms").where(over > 0).groupBy("file_id", "window_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(over).alias("overlap_ms"))
    return windows.join(hit, ["file_id", "window_idx"], "left").select("file_id", "window_idx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("overlap_ms", F.lit(0)).alias("overlap_ms"))


def words_to_pieces(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """Words by their middle into [start, end) pieces, the last piece closed. pieces: file_id, piece_idx, p_start, p_end."""
    last = pieces.withColumn("_last", F.lead("piece_idx").over(Window.partitionBy("file_id").orderBy("piece_idx")).isNull())
    mid2 = F.col("w_start") + F.col("w_end")
    points = words.withColumn("_m_low", F.floor(mid2 / 2)).withColumn("_m_high", F.ceil(mid2 / 2))
    pairs = overlap_join(points, last, "_m_low", "_m_high", "p_start", "p_end")
    return pairs.where((mid2 >= 2 * F.col("p_start")) & ((mid2 < 2 * F.col("p_end")) | (F.col("_last") & (mid2 <= 2 * F.col("p_end"))))).select("file_id", "word_idx", "piece_idx")


def first_container(points: DataFrame, windows: DataFrame, slack_ms: int = 500, chunk_ms: int = 40_000) -> DataFrame:
    """The first window (by index) that holds start + 1 ms within the slack, and the chunk inside it; others dropped.
    points: file_id, seg_idx, start_ms; windows: file_id, window_idx, win_start, win_end."""
    p = points.select("file_id", "seg_idx", (F.col("start_ms") + 1).alias("_at"), (F.col("start_ms") + 1).alias("_to"))
    w = windows.select("file_id", "window_idx", (F.col("win_start") - slack_ms).alias("_low"), (F.col("win_end") + slack_ms).alias("_high"), "win_start")
    hit = overlap_join(p, w, "_at", "_to", "_low", "_high").groupBy("file_id", "seg_idx", "_at").agg(F.min(F.struct("window_idx", "win_start")).alias("_w"))
    return hit.select("file_id", "seg_idx", F.col("_w.window_idx").alias("window_idx"), F.floor(F.greatest(F.col("_at") - 1 - F.col("_w.win_start"), F.lit(0)) / chunk_ms).alias("chunk_idx"))


def nearest_edges(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Whether each point lies strictly inside a region, and the least distance to an edge of any region of its file."""
    edges = regions.select("file_id", F.explode(F.array("start_ms", "end_ms")).alias("_edge"))
    near = nearest(points.select("file_id", "point_id", "at_ms"), F.col("at_ms"), edges, F.col("_edge"), F.col("_edge"), F.col("_edge")).where("_away is not null")
    # Inside: a region that began before the point ends after it.
    spans = regions.groupBy("file_id", F.col("start_ms").alias("_place")).agg(F.max("end_ms").alias("_end"))
    both = near.select("file_id", F.col("at_ms").alias("_place"), "point_id", "_away").unionByName(spans, allowMissingColumns=True)
    reach = F.max("_end").over(Window.partitionBy("file_id").orderBy("_place").rangeBetween(Window.unboundedPreceding, -1))
    known = both.withColumn("_reach", reach).where("_away is not null")
    return known.select("file_id", "point_id", F.coalesce(F.col("_reach") > F.col("_place"), F.lit(False)).alias("inside"), F.col("_away").alias("edge_ms"))


def offset_times(rows: DataFrame, shift_ms: int, columns: tuple[str, ...] = ("start_ms", "end_ms")) -> DataFrame:
    """Rows with their times moved, as when a window's result joins the whole file's."""
    return rows.select(*[(F.col(c) + shift_ms).alias(c) if c in columns else F.col(c) for c in rows.columns])


def sliding_windows(files: DataFrame, window_ms: int = 10_000, step_ms: int = 1_000) -> DataFrame:
    """Overlapping windows that cover each file, one at least, and how much of the last ones is padding."""
    f = files.where("duration_ms > 0")
    last = F.when(F.col("duration_ms") <= window_ms, F.lit(0).cast("long")).otherwise(F.ceil((F.col("duration_ms") - window_ms) / step_ms))
    w = f.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window_idx"))
    end = F.col("window_idx") * step_ms + window_ms
    return w.select("file_id", "window_idx", (F.col("window_idx") * step_ms).alias("first_ms"), F.least(end, "duration_ms").alias("end_ms"), F.greatest(end - F.col("duration_ms"), F.lit(0)).alias("pad_ms"))


def classify_chunks(chunks: DataFrame, segments: DataFrame, silences: DataFrame, least_single_ms: int = 25_000, least_silence_ms: int = 500, margin_ms: int = 5_000) -> DataFrame:
    """Which chunks deserve a second look: trigger_cross with several speakers; trigger_silence for a long one with one
    speaker and a silence of at least least_silence_ms in its middle part (the margins left out); skip otherwise.

    chunks: file_id, chunk_idx, c_start, c_end; segments: file_id, chunk_idx, speaker; silences: file_id, start_ms, end_ms.
    Returns file_id, chunk_idx, label, reason, n_speakers, n_segments, duration_ms.
    """
    said = segments.groupBy("file_id", "chunk_idx").agg(F.count_distinct("speaker").alias("n_speakers"), F.count(F.lit(1)).alias("n_segments"))
    known = chunks.join(said, ["file_id", "chunk_idx"], "left").select("file_id", "chunk_idx", (F.col("c_end") - F.col("c_start")).alias("duration_ms"), (F.col("c_start") + margin_ms).alias("_from"), (F.col("c_end") - margin_ms).alias("_to"), F.coalesce("n_speakers", F.lit(0)).alias("n_speakers"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"))
    room, long = F.col("_to") > F.col("_from") + 1_000, F.col("duration_ms") >= least_single_ms
    over = overlap_ms("_from", "_to", "start_ms", "end_ms")
    heard = overlap_join(known.where(room).select("file_id", "chunk_idx", "_from", "_to"), silences.select("file_id", "start_ms", "end_ms"), "_from", "_to", "start_ms", "end_ms").where(over >= least_silence_ms)
    found = known.join(heard.groupBy("file_id", "chunk_idx").agg(F.count(F.lit(1)).alias("_n"), F.max(over).alias("_longest")), ["file_id", "chunk_idx"], "left")
    several = F.col("n_speakers") >= 2
    label = F.when(several, "trigger_cross").when(long & F.col("_n").isNotNull(), "trigger_silence").otherwise("skip")
    quiet = F.format_string("silences=%d longest=%.2fs", F.col("_n"), F.col("_longest") / 1000)
    reason = F.when(several, F.concat(F.lit("in_chunk_speakers="), F.col("n_speakers").cast("string"))).when(~long, "single_speaker_short").when(~room, "single_speaker_too_short_for_silence").otherwise(F.coalesce(quiet, F.lit("single_speaker_no_silence")))
    return found.select("file_id", "chunk_idx", label.alias("label"), F.when(F.col("_n").isNull() & ~several & long & room, "single_speaker_no_silence").otherwise(reason).alias("reason"), "n_speakers", "n_segments", "duration_ms")


def clip_to_window(turns: DataFrame, start_ms: int, end_ms: int, relative: bool = True, least_ms: int = 50) -> DataFrame:
    """Turns clipped to the window, shorter ones dropped, times relative to its start unless asked otherwise."""
    shift = start_ms if relative else 0
    low, high = F.greatest(F.col("start_ms"), F.lit(start_ms)), F.least(F.col("end_ms"), F.lit(end_ms))
    return turns.where(high - low >= least_ms).select(*[(low - shift).alias(c) if c == "start_ms" else (high - shift).alias(c) if c == "end_ms" else F.col(c) for c in turns.columns])


def normalize_regions(regions: DataFrame, files: DataFrame, gap_ms: int = 500, least_ms: int = 100) -> DataFrame:
    """Regions clamped to the file, short ones dropped, merged where the gap is at most gap_ms."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("duration_ms")))
    r = regions.join(files, "file_id").select("file_id", clamp("start_ms").alias("start_ms"), clamp("end_ms").alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    w = Window.partitionBy("file_id").orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = r.withColumn("_new", F.when(F.col("start_ms") - before <= gap_ms, 0).otherwise(1))
    grouped = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("file_id", "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")


def complement(regions: DataFrame, files: DataFrame, least_ms: int = 1) -> DataFrame:
    """What of [0, duration] no region covers, in parts of at least least_ms; a file without regions is one part."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("duration_ms")))
    edges = regions.join(files, "file_id").select("file_id", clamp("start_ms").alias("start_ms"), clamp("end_ms").alias("end_ms"))
    tail = files.select("file_id", F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    w = Window.partitionBy("file_id").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    gaps = edges.unionByName(tail).select("file_id", F.coalesce(F.max("end_ms").over(w), F.lit(0)).alias("_from"), F.col("start_ms").alias("_to"))
    return gaps.where(F.col("_to") - F.col("_from") >= least_ms).select("file_id", F.col("_from").alias("start_ms"), F.col("_to").alias("end_ms"))


def silence_boundaries(regions: DataFrame, files: DataFrame, least_ms: int = 800) -> DataFrame:
    """Middles (doubled, so whole) of the gaps of at least least_ms between regions; a file without regions has none."""
    held = files.join(regions.select("file_id").distinct(), "file_id", "left_semi")
    return complement(regions, held, least_ms).where("end_ms > start_ms").select("file_id", (F.col("start_ms") + F.col("end_ms")).alias("boundary2"), "start_ms", "end_ms")
