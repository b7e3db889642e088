"""Ordered-sequence operators by window functions: islands, runs, ranks, switches. Keyed by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_file() -> WindowSpec:
    return Window.partitionBy("file_id")


def _collapsed(marked: DataFrame, order: str, last_end: bool) -> DataFrame:
    """One row an island: first index, start, end (the last or the largest), speaker, text joined in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "")
    end = F.max_by("end_ms", order) if last_end else F.max("end_ms")
    return marked.groupBy("file_id", "_island").agg(F.min(order).alias(order), F.min_by("start_ms", order).alias("start_ms"), end.alias("end_ms"), F.min_by("speaker", order).alias("speaker"), text.alias("text"), F.count(F.lit(1)).alias("n_merged")).drop("_island")


def merge_same_speaker(segments: DataFrame, gap_ms: int = 50, order: str = "seg_idx") -> DataFrame:
    """Neighbours of one speaker whose gap to the largest end so far is at most gap_ms become one; end: the largest."""
    w = by_file().orderBy(order)
    runs = segments.withColumn("_change", F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)).withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("file_id", "_run").orderBy(order)
    # Inside a run starts do not fall, so the largest end before a row is that of its own island or lies further back.
    before = F.max("end_ms").over(r.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.when(F.col("start_ms") - before <= gap_ms, 0).otherwise(1))
    return _collapsed(marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))), order, False)


def merge_consecutive(segments: DataFrame, gap_ms: int = 3000, order: str = "seg_idx") -> DataFrame:
    """Neighbours of one speaker with a gap below gap_ms to the previous end become one; end: the last one's."""
    w = by_file().orderBy(order)
    joined = F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) & (F.col("start_ms") - F.lag("end_ms").over(w) < gap_ms)
    marked = segments.withColumn("_new", F.when(joined, 0).otherwise(1))
    return _collapsed(marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))), order, True)


def talk_time(segments: DataFrame) -> DataFrame:
    """Total and share (in millionths, rounded down; a file without duration: all) of each speaker."""
    totals = segments.groupBy("file_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.count(F.lit(1)).alias("n_segments"))
    whole = F.sum("total_ms").over(by_file())
    return totals.withColumn("share_ppm", F.when(whole > 0, F.floor(F.col("total_ms") * 1_000_000 / whole)).otherwise(F.lit(1_000_000)))


def ranked_speakers(segments: DataFrame) -> DataFrame:
    """talk_time with a dense rank from 0: longest first, a tie by the old label."""
    return talk_time(segments).withColumn("new_speaker", F.row_number().over(by_file().orderBy(F.desc("total_ms"), "speaker")) - 1)


def relabel_by_duration(segments: DataFrame) -> DataFrame:
    """Segments with speakers renumbered by total duration."""
    names = ranked_speakers(segments).select("file_id", "speaker", F.col("new_speaker").cast("long").alias("_new"))
    return segments.join(names, ["file_id", "speaker"]).select(*[F.col("_new").alias(c) if c == "speaker" else F.col(c) for c in segments.columns])


def switches(segments: DataFrame, short_ms: int = 1500, order: str = "seg_idx") -> DataFrame:
    """Speaker changes of each file, and whether a short middle of an A-B-A occurs (read only)."""
    w = by_file().orderBy(order)
    prev, nxt = F.lag("speaker").over(w), F.lead("speaker").over(w)
    aba = (prev == nxt) & (prev != F.col("speaker")) & (F.col("end_ms") - F.col("start_ms") <= short_ms)
    marked = segments.select("file_id", F.coalesce((prev != F.col("speaker")).cast("int"), F.lit(0)).alias("_s"), F.coalesce(aba, F.lit(False)).alias("_a"))
    return marked.groupBy("file_id").agg(F.sum("_s").alias("n_switches"), F.max("_a").alias("has_aba"))


def runs_to_turns(frames: DataFrame, step_ms: int, onset_ms: int, offset_ms: int) -> DataFrame:
    """Active frames of each (file, speaker) to turns: runs, gaps of at most offset_ms closed, turns longer than onset_ms.
    frames: file_id, speaker, frame (active ones only)."""
    w = Window.partitionBy("file_id", "speaker").orderBy("frame")
    runs = frames.withColumn("_run", F.col("frame") - F.row_number().over(w)).groupBy("file_id", "speaker", "_run").agg((F.min("frame") * step_ms).alias("start_ms"), ((F.max("frame") + 1) * step_ms).alias("end_ms"))
    t = Window.partitionBy("file_id", "speaker").orderBy("start_ms")
    gap = F.col("start_ms") - F.lag("end_ms").over(t)
    islands = runs.withColumn("_new", F.when(gap <= offset_ms, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(t.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("file_id", "speaker", "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return merged.where(F.col("end_ms") - F.col("start_ms") > onset_ms).drop("_island")


def top_speakers_per_frame(activity: DataFrame, count: Column | str = "k") -> DataFrame:
    """Of each frame the k clusters with most activity (a tie: the lower id). activity: file_id, frame, speaker, score, k."""
    rank = F.row_number().over(Window.partitionBy("file_id", "frame").orderBy(F.desc("score"), "speaker"))
    return activity.withColumn("_rank", rank).where(F.col("_rank") <= (F.col(count) if isinstance(count, str) else count)).drop("_rank")


def tight_boundaries(segments: DataFrame, tight_ms: int = 250, short_ms: int = 1000, order: str = "seg_idx") -> DataFrame:
    """Flags: a boundary to the left or right with a gap of at most tight_ms either way, and a very short segment."""
    w = by_file().orderBy(order)
    left = F.abs(F.col("start_ms") - F.lag("end_ms").over(w)) <= tight_ms
    right = F.abs(F.lead("start_ms").over(w) - F.col("end_ms")) <= tight_ms
    return segments.select("file_id", order, F.coalesce(left, F.lit(False)).alias("tight_left"), F.coalesce(right, F.lit(False)).alias("tight_right"), (F.col("end_ms") - F.col("start_ms") <= short_ms).alias("very_short"))


def linear_text_cuts(turns: DataFrame, text: DataFrame) -> DataFrame:
    """A file's text cut by the turns' shares of time, at round half even; the last turn takes the rest.
    turns: file_id, turn_idx, start_ms, end_ms, speaker; text: file_id, text."""
    w = by_file().orderBy("start_ms", "turn_idx")
    upto = F.sum(F.col("end_ms") - F.col("start_ms")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(F.col("end_ms") - F.col("start_ms")).over(by_file())
    t = turns.join(text, "file_id").withColumn("_n", F.length("text"))
    cut = F.when(F.lead("turn_idx").over(w).isNull(), F.col("_n")).otherwise(F.least(F.bround(upto * F.col("_n") / whole).cast("int"), F.col("_n")))
    t = t.where(F.col("_n") > 0).withColumn("_whole", whole).where("_whole > 0").withColumn("_cut", cut)
    to = F.max("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("char_end", to).withColumn("char_start", F.coalesce(F.lag("char_end").over(w), F.lit(0)))
    return t.select("file_id", "turn_idx", "start_ms", "end_ms", "speaker", F.expr("substring(text, char_start + 1, char_end - char_start)").alias("piece"))


def top_longest(segments: DataFrame, n: int, order: str = "seg_idx") -> DataFrame:
    """The n longest segments of each speaker (a tie: the first)."""
    w = Window.partitionBy("file_id", "speaker").orderBy(F.desc("dur_ms"), order)
    return segments.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def index_percentile(values: Column, numerator: int, denominator: int) -> Column:
    """The element at floor(n * numerator / denominator) of the sorted values, counted from 0, not interpolated."""
    ordered = F.array_sort(F.collect_list(values))
    at = F.least(F.floor(F.size(ordered) * numerator / denominator), F.size(ordered) - 1)
    return F.element_at(ordered, (at + 1).cast("int"))


# Which of three slots are active in each of the seven classes of a powerset output.
POWERSET = ((), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2))


def powerset_active(frames: DataFrame, scores: str) -> DataFrame:
    """frames with slot0 to slot2: whether a slot is active in the class with the highest score (a tie: the first)."""
    best = F.array_position(scores, F.array_max(scores)) - 1
    return frames.select("*", *[F.coalesce(best.isin(*[k for k, slots in enumerate(POWERSET) if slot in slots]), F.lit(False)).alias(f"slot{slot}") for slot in range(3)])


def exclude_overlap(frames: DataFrame) -> DataFrame:
    """Frames in which one speaker alone is active. frames: file_id, speaker, frame (active ones only, distinct)."""
    return frames.groupBy("file_id", "frame").agg(F.min("speaker").alias("speaker"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def sample_ranges(frames: DataFrame, frame_samples: int = 1_600, least_frames: int = 10) -> DataFrame:
    """Sample ranges of runs of at least least_frames frames in which a speaker is alone."""
    runs = runs_to_turns(exclude_overlap(frames), frame_samples, 0, -1)
    return runs.where(F.col("end_ms") - F.col("start_ms") >= frame_samples * least_frames).select("file_id", "speaker", F.col("start_ms").alias("first_sample"), F.col("end_ms").alias("end_sample"))


def speakers_per_frame(activity: DataFrame, unit: int = 1) -> DataFrame:
    """activity with k: the mean of a frame's scores in units, rounded by adding a half and cutting."""
    k = activity.groupBy("file_id", "frame").agg(F.floor(F.avg("score") / unit + 0.5).cast("int").alias("k"))
    return activity.join(k, ["file_id", "frame"])


def speaker_count_grid(frames: DataFrame, clusters: DataFrame) -> DataFrame:
    """Active slots of each cluster by frame; slots without a cluster drop out. clusters: speaker, cluster."""
    return frames.join(F.broadcast(clusters), "speaker").groupBy("file_id", "frame", "cluster").agg(F.count(F.lit(1)).alias("n"))


def sorted_speakers(segments: DataFrame) -> DataFrame:
    """The names of a file's speakers as text, in order of text: Speaker11 before Speaker2."""
    return segments.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("Speaker"), F.col("speaker") + 1))), ",").alias("speakers"))
