"""Quality and evaluation analytics: edit statistics, confusion, risk of windows, acceptance gates, timing reports."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ANSWER_CUES, QUESTION_CUES, cue_count
from ..shipping import shipped
from .intervals import nearest, overlap_join
from .sequences import index_percentile


def normalized(text: str | None) -> str:
    """NFKC, lower case, without punctuation, separators and symbols."""
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").lower() if unicodedata.category(c)[0] not in "PZS")


def edit_counts(reference: str, hypothesis: str) -> dict[str, int]:
    """Characters by kind of edit block; replaced blocks count their longer side as edits."""
    n = dict.fromkeys(("equal", "insert", "delete", "replace_ref", "replace_hyp"), 0)
    for kind, a, b, c, d in SequenceMatcher(None, reference, hypothesis, autojunk=False).get_opcodes():
        if kind == "replace":
            n["replace_ref"] += b - a
            n["replace_hyp"] += d - c
        else:
            n[kind] += d - c if kind == "insert" else b - a
    n["edits"] = n["insert"] + n["delete"] + max(n["replace_ref"], n["replace_hyp"])
    return n


def edit_stats(pairs: DataFrame) -> DataFrame:
    """pairs: id, reference, hypothesis (text) -> id, counts, error rate in millionths (no reference: 0)."""
    columns = ("equal", "insert", "delete", "replace_ref", "replace_hyp", "edits")

    def run(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            texts = [(normalized(r), normalized(h)) for r, h in zip(rows["reference"], rows["hypothesis"])]
            found = pd.DataFrame([edit_counts(*t) for t in texts], columns=list(columns))
            found.insert(0, "id", rows["id"].to_numpy())
            found["ref_chars"] = [len(r) for r, _ in texts]
            found["error_ppm"] = [e * 1_000_000 // n if n else 0 for e, n in zip(found["edits"], found["ref_chars"])]
            yield found

    return shipped(pairs).select("id", "reference", "hypothesis").mapInPandas(run, "id long, " + ", ".join(f"`{c}` long" for c in columns) + ", ref_chars long, error_ppm long")


def best_mapping(confusion: dict[tuple[str, str], int]) -> dict[str, str]:
    """Hypothesis to reference labels with most matches; the first best in order of labels. One to one where there are
    enough reference labels: an assignment problem, whose first best solution fixes label by label what still reaches
    the optimum. With fewer reference labels each takes its own best."""
    hyps, refs = (sorted({k[j] for k in confusion}) for j in (0, 1))
    n = np.array([[confusion.get((h, r), 0) for r in refs] for h in hyps], np.int64).reshape(len(hyps), len(refs))
    if len(hyps) > len(refs):
        return {h: refs[int(row.argmax())] for h, row in zip(hyps, n, strict=True)}
    left, out = list(range(len(refs))), {}
    for k, h in enumerate(hyps):
        best = assignment_value(n[k:, left])
        j = next(j for j in range(len(left)) if n[k, left[j]] + assignment_value(n[k + 1 :, left[:j] + left[j + 1 :]]) == best)
        out[h] = refs[left.pop(j)]
    return out


def assignment_value(n: np.ndarray) -> int:
    """The largest sum of one entry a row, all from different columns (rows <= columns), by shortest augmenting paths."""
    rows, columns = n.shape
    if not rows:
        return 0
    cost = n.max() - n
    owner = np.full(columns, -1)
    price_r, price_c = np.zeros(rows, np.int64), np.zeros(columns, np.int64)
    for start in range(rows):
        far, back, seen = np.full(columns, np.iinfo(np.int64).max // 2), np.full(columns, -1), np.zeros(columns, bool)
        row, column, base = start, -1, 0
        while True:
            reach = base + cost[row] - price_r[row] - price_c
            closer = ~seen & (reach < far)
            far[closer], back[closer] = reach[closer], column
            column = int(np.where(seen, np.iinfo(np.int64).max, far).argmin())
            seen[column], base = True, far[column]
            if owner[column] < 0:
                break
            row = owner[column]
        for c in np.flatnonzero(seen):
            if c != column:
                price_r[owner[c]] += base - far[c]
                price_c[c] -= base - far[c]
        price_r[start] += base
        while column >= 0:
            before = back[column]
            owner[column] = start if before < 0 else owner[before]
            column = before
    return int(sum(n[owner[c], c] for c in range(columns) if owner[c] >= 0))


def equal_characters(texts: DataFrame) -> DataFrame:
    """texts: file_id, reference (array of speaker, text in order), hypothesis (array of seg_idx, speaker, text) ->
    file_id, seg_idx, hyp, ref, n: characters in equal difflib blocks of the normalised texts, by segment and speakers."""

    def run(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            out = []
            for ident, ref, hyp in zip(rows["file_id"], rows["reference"], rows["hypothesis"]):
                said = [(normalized(p["text"]), p["speaker"], None) for p in ref]
                heard = [(normalized(p["text"]), p["speaker"], p["seg_idx"]) for p in hyp]
                whom, who, where = ([p[k] for p in some for _ in p[0]] for some, k in ((said, 1), (heard, 1), (heard, 2)))
                n: dict = {}
                for kind, a, b, c, _ in SequenceMatcher(None, "".join(p[0] for p in said), "".join(p[0] for p in heard), autojunk=False).get_opcodes():
                    for k in range(b - a if kind == "equal" else 0):
                        key = (ident, where[c + k], who[c + k], whom[a + k])
                        n[key] = n.get(key, 0) + 1
                out.extend((*k, v) for k, v in n.items())
            yield pd.DataFrame(out, columns=["file_id", "seg_idx", "hyp", "ref", "n"])

    return shipped(texts).select("file_id", "reference", "hypothesis").mapInPandas(run, "file_id long, seg_idx long, hyp string, ref string, n long")


def confusion_of(chars: DataFrame) -> DataFrame:
    """Counts of pairs. chars: file_id, hyp, ref, and n if a row stands for several."""
    return chars.groupBy("file_id", "hyp", "ref").agg((F.sum("n") if "n" in chars.columns else F.count(F.lit(1))).alias("n"))


def speaker_accuracy(confusion: DataFrame) -> DataFrame:
    """file_id, hyp, mapped, correct and total of each file's best mapping."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {(h, r): int(n) for h, r, n in zip(rows["hyp"], rows["ref"], rows["n"])}
        m = best_mapping(counts)
        return pd.DataFrame({"file_id": key[0], "hyp": list(m), "mapped": list(m.values()), "correct": sum(n for (h, r), n in counts.items() if m[h] == r), "total": sum(counts.values())})

    return shipped(confusion).groupBy("file_id").applyInPandas(run, "file_id long, hyp string, mapped string, correct long, total long")


def segment_majorities(chars: DataFrame, share: float = 0.9) -> DataFrame:
    """The most frequent reference label of each segment (a tie: the smaller), and whether it holds under `share`."""
    n = chars.groupBy("file_id", "seg_idx", "ref").agg((F.sum("n") if "n" in chars.columns else F.count(F.lit(1))).alias("n"))
    m = n.groupBy("file_id", "seg_idx").agg(F.min_by("ref", F.struct(-F.col("n"), "ref")).alias("majority"), F.max("n").alias("n_majority"), F.sum("n").alias("n_chars"))
    return m.withColumn("mixed", F.col("n_majority") < share * F.col("n_chars"))


def paired_characters(left: DataFrame, right: DataFrame) -> DataFrame:
    """CJK characters of two texts paired by position among such characters. left, right: id, text."""

    def spread(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.posexplode(F.filter(F.split("text", ""), lambda c: c.rlike("[一-鿿]"))).alias("pos", name))

    return spread(left, "a").join(spread(right, "b"), ["id", "pos"]).withColumn("same", F.col("a") == F.col("b"))


def interval_iou(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intersection and union (ms) of each pair of speakers of a file, from disjoint turns; columns l, r, both_ms, either_ms."""
    a = left.groupBy("file_id", F.col("speaker").alias("l")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("_la"))
    b = right.groupBy("file_id", F.col("speaker").alias("r")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("_lb"))
    x = left.select("file_id", F.col("speaker").alias("l"), F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    y = right.select("file_id", F.col("speaker").alias("r"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    over = F.least("e1", "e2") - F.greatest("s1", "s2")
    both = overlap_join(x, y, "s1", "e1", "s2", "e2").where(over > 0).groupBy("file_id", "l", "r").agg(F.sum(over).alias("both_ms"))
    return both.join(a, ["file_id", "l"]).join(b, ["file_id", "r"]).select("file_id", "l", "r", "both_ms", (F.col("_la") + F.col("_lb") - F.col("both_ms")).alias("either_ms"))


def match_speakers(left: DataFrame, right: DataFrame) -> DataFrame:
    """file_id, l, r, iou: left speakers in order of their ids, each with the right speaker of largest intersection over
    union that no earlier one has (a tie: the smaller id; also one without any overlap). Speakers left over have no row."""
    whole = lambda df, who, total: df.groupBy("file_id", F.col("speaker").alias(who)).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(total))
    pairs = whole(left, "l", "_la").join(whole(right, "r", "_lb"), "file_id").join(interval_iou(left, right), ["file_id", "l", "r"], "left")
    either = F.coalesce("either_ms", F.col("_la") + F.col("_lb"))
    scored = pairs.where(either > 0).select("file_id", "l", "r", (F.coalesce("both_ms", F.lit(0)) / either).alias("iou"))
    ranked = scored.groupBy("file_id", "l").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("s"), "r"))).alias("ranked"))
    files = ranked.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("l", "ranked"))).alias("_all"))

    def step(done: Column, x: Column) -> Column:
        taken = F.transform(done, lambda y: y["r"])
        best = F.get(F.filter(x["ranked"], lambda y: ~F.array_contains(taken, y["r"])), F.lit(0))
        return F.when(best.isNull(), done).otherwise(F.array_append(done, F.struct(x["l"].alias("l"), best["r"].alias("r"), (-best["s"]).alias("iou"))))

    start = F.array().cast("array<struct<l:bigint,r:bigint,iou:double>>")
    return files.select("file_id", F.explode(F.aggregate("_all", start, step)).alias("_m")).select("file_id", "_m.*")


def alignment_in_silence(segments: DataFrame, silences: DataFrame, near_ms: int = 300) -> DataFrame:
    """Of each file's different segment ends how many lie inside a silence (closed) or within near_ms of one's edge."""
    b = segments.select("file_id", F.col("end_ms").alias("ts")).distinct()
    inside = overlap_join(b.withColumn("_to", F.col("ts")), silences.select("file_id", F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b")), "ts", "_to", "_a", "_b").select("file_id", "ts").distinct().withColumn("inside", F.lit(True))
    edges = silences.select("file_id", F.explode(F.array("start_ms", "end_ms")).alias("_edge"))
    m = nearest(b, F.col("ts"), edges, F.col("_edge"), F.col("_edge"), F.col("_edge")).join(inside, ["file_id", "ts"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    near = ~F.col("inside") & F.coalesce(F.col("_away") <= near_ms, F.lit(False))
    counts = m.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("n_inside"), F.count_if(near).alias("n_near"))
    return counts.withColumn("ratio_milli", F.floor((F.col("n_inside") + F.col("n_near")) * 1000 / F.col("n")))


def output_analysis(segments: DataFrame) -> DataFrame:
    """Of each file: segments, median (the element at n // 2), longest and total duration, durations in four ranges, and
    speaker switches in 1000 minutes."""
    dur = F.col("end_ms") - F.col("start_ms")
    b = segments.withColumn("dur", dur).withColumn("p", F.lag("speaker").over(Window.partitionBy("file_id").orderBy("seg_idx")))
    agg = [F.count(F.lit(1)).alias("n"), index_percentile(F.col("dur"), 1, 2).alias("median_ms"), F.max("dur").alias("max_ms"), F.sum("dur").alias("total_ms")]
    agg += [F.count_if(c).alias(f"b{k}") for k, c in enumerate((F.col("dur") < 500, F.col("dur").between(500, 1499), F.col("dur").between(1500, 2999), F.col("dur") >= 3000))]
    return b.groupBy("file_id").agg(*agg, F.floor(F.count_if(F.coalesce(F.col("p") != F.col("speaker"), F.lit(False))) * 60_000_000 / F.greatest(F.max("end_ms"), F.lit(1))).alias("switches_per_1000_min"))


def drift_report(pairs: DataFrame) -> DataFrame:
    """Of pairs (file_id, x: an absolute difference in ms): number, sum, the elements at n // 2 and 9 n // 10, how many are
    within 100, 200 and 500 ms, and the largest."""
    hits = [F.count_if(F.col("x") <= k).alias(f"hit_{k}") for k in (100, 200, 500)]
    return pairs.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_ms"), index_percentile(F.col("x"), 1, 2).alias("p50"), index_percentile(F.col("x"), 9, 10).alias("p90"), *hits, F.max("x").alias("max_ms"))


def roles_by_text(segments: DataFrame) -> DataFrame:
    """Characters of each speaker, and whether it has most of its file (a tie: the smaller id): dominant or minority."""
    m = segments.groupBy("file_id", "speaker").agg(F.sum(F.length("text")).alias("chars"))
    return m.withColumn("role", F.when(F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("chars"), "speaker")) == 1, "dominant").otherwise("minority"))


def parity(found: DataFrame, golden: DataFrame, tolerance_ms: int = 50) -> DataFrame:
    """Segments against golden ones by index: how many there are, have no partner, or agree within the tolerance."""
    t = golden.select("file_id", "seg_idx", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"), F.lit(1).alias("right"))
    j = found.select("file_id", "seg_idx", "start_ms", "end_ms", F.lit(1).alias("left")).join(t, ["file_id", "seg_idx"], "full")
    close = (F.abs(F.col("start_ms") - F.col("ts")) <= tolerance_ms) & (F.abs(F.col("end_ms") - F.col("te")) <= tolerance_ms)
    return j.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("left").isNull() | F.col("right").isNull()).alias("n_unmatched"), F.count_if(F.coalesce(close, F.lit(False))).alias("n_close"))


def rewritten(segments: DataFrame, changed: DataFrame) -> DataFrame:
    """Segments with those of `changed` (same columns) in place of the ones with their file and index."""
    return segments.join(changed, ["file_id", "seg_idx"], "left_anti").unionByName(changed)


def window_features(segments: DataFrame, window_ms: int = 40_000, tight_ms: int = 250, short_aba_ms: int = 1500) -> DataFrame:
    """Features of tumbling windows by segment start. segments: file_id, seg_idx, start_ms, end_ms, speaker, text."""
    s = segments.withColumn("window_idx", F.floor(F.greatest(F.lit(0), F.col("start_ms")) / window_ms))
    last = F.max("end_ms").over(Window.partitionBy("file_id"))
    w = Window.partitionBy("file_id", "window_idx").orderBy("seg_idx")
    dur = F.col("end_ms") - F.col("start_ms")
    prev, nxt = F.lag("speaker").over(w), F.lead("speaker").over(w)
    bound = F.least((F.col("window_idx") + 1) * window_ms, last)
    chars = F.length("text")
    rows = s.select(
        "file_id", "window_idx", "seg_idx", "speaker", "text", chars.alias("chars"), cue_count(F.col("text"), QUESTION_CUES).alias("q"), cue_count(F.col("text"), ANSWER_CUES).alias("a"),
        F.coalesce((prev != F.col("speaker")).cast("int"), F.lit(0)).alias("switch"),
        F.coalesce(((prev != F.col("speaker")) & (F.abs(F.col("start_ms") - F.lag("end_ms").over(w)) <= tight_ms)).cast("int"), F.lit(0)).alias("tight"),
        F.coalesce((prev == nxt) & (prev != F.col("speaker")) & (dur <= short_aba_ms), F.lit(False)).alias("aba"),
        (dur <= 1000).cast("int").alias("short"), ((F.col("start_ms") < bound - 5000) & (F.col("end_ms") > bound) & (dur >= 12_000)).cast("int").alias("cross"),
        ((chars * 1000 < dur) | (chars * 1000 > 8 * dur)).cast("int").alias("odd_rate"),
    )
    n = lambda c: F.sum(c).cast("long")
    f = rows.groupBy("file_id", "window_idx").agg(
        F.count(F.lit(1)).alias("segments"), n("chars").alias("chars"), F.count_distinct("speaker").alias("speakers"), n("switch").alias("switches"), n("q").alias("question_cues"), n("a").alias("answer_cues"),
        n(((F.col("q") > 0) & (F.col("a") > 0)).cast("int")).alias("qa_mixed"), F.max("aba").alias("aba"), n("short").alias("very_short"), n("tight").alias("tight"), n("cross").alias("long_cross"), n("odd_rate").alias("odd_rate"),
    )
    return f.withColumn("single_qa", (F.col("speakers") == 1) & (F.col("question_cues") > 0) & (F.col("answer_cues") > 0))


def risk_score(f: DataFrame) -> DataFrame:
    """score in hundredths and reasons of window_features' rows: additive weights, capped."""
    c = F.col
    some = lambda name, points, most, reason: (F.least(c(name), F.lit(most)) * points, c(name) > 0, reason)
    rules: list[tuple[Column, Column, str]] = [
        (F.lit(500), c("single_qa"), "single_speaker_with_question_and_answer_cues"),
        some("qa_mixed", 350, 2, "same_segment_question_answer_cues"),
        some("tight", 150, 4, "tight_speaker_boundaries"),
        some("very_short", 100, 4, "very_short_turns"),
        (F.lit(300), c("aba"), "aba_short_turn"),
        (c("long_cross") * 250, c("long_cross") > 0, "long_segment_crosses_window_boundary"),
        (F.lit(300), (c("segments") <= 1) & (c("chars") >= 120) & (c("question_cues") + c("answer_cues") > 0), "long_single_segment_with_role_cues"),
        (F.lit(150), c("segments") >= 5, "many_segments"),
        (F.lit(150), c("switches") >= 3, "many_speaker_switches"),
        some("odd_rate", 75, 3, "abnormal_chars_per_second"),
        (F.lit(100), (c("question_cues") > 0) & (c("answer_cues") > 0) & (c("speakers") <= 2), "question_answer_cues_in_window"),
    ]
    total = sum((F.when(when, points).otherwise(F.lit(0)) for points, when, _ in rules), F.lit(0))
    return f.withColumn("score", total.cast("long")).withColumn("reasons", F.array_compact(F.array(*[F.when(when, F.lit(reason)) for _, when, reason in rules])))


def audio_features(windows: DataFrame, turns: DataFrame, pieces: DataFrame, silences: DataFrame) -> DataFrame:
    """Features of windows from what models heard in them, one row for each of windows (file_id, window_idx, win_start,
    win_end).

    turns: file_id, window_idx, turn_idx, start_ms, end_ms, speaker (local clusters); pieces: file_id, window_idx, seg_idx,
    role (dominant, minority or another), to_dominant, to_minority (cosines with the two centroids; null: unknown) and
    embedding; silences: file_id, start_ms, end_ms. A piece disagrees where the other centroid is nearer by more than
    0.05, surely by more than 0.10; neighbours of one role more than 0.4 apart count as far.
    """
    from ..functions.text import cosine
    from .intervals import window_overlaps

    key = ["file_id", "window_idx"]
    dur = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    prev = F.lag("speaker").over(Window.partitionBy(*key).orderBy("start_ms", "turn_idx"))
    t = turns.select(*key, "speaker", dur.alias("dur"), F.coalesce((prev != F.col("speaker")).cast("int"), F.lit(0)).alias("switch"))
    local = t.groupBy(*key).agg(F.count(F.lit(1)).alias("local_turns"), F.sum("switch").alias("local_switches"), F.sum("dur").alias("speech_ms"), F.min("dur").alias("least_turn_ms"), F.max("dur").alias("most_turn_ms"))
    by = t.groupBy(*key, "speaker").agg(F.sum("dur").alias("d")).groupBy(*key).agg(F.count(F.lit(1)).alias("local_speakers"), F.min("d").alias("_least"))
    order = Window.partitionBy(*key).orderBy("seg_idx")
    margin = F.col("to_dominant") - F.col("to_minority")
    away = F.when(F.lag("embedding").over(order).isNotNull() & F.col("embedding").isNotNull(), 1 - cosine(F.lag("embedding").over(order), F.col("embedding")))
    dominant, minority = F.col("role") == "dominant", F.col("role") == "minority"
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    p = pieces.select(*key, "role", "to_dominant", "to_minority", margin.alias("m"), away.alias("away"), (F.lag("role").over(order) == F.col("role")).alias("same"))
    heard = p.groupBy(*key).agg(
        yes((dominant & (F.col("m") < -0.05)) | (minority & (F.col("m") > 0.05))).alias("disagreements"), yes(dominant & (F.col("m") < -0.10)).alias("sure_minority"), yes(minority & (F.col("m") > 0.10)).alias("sure_dominant"),
        F.round(F.min(F.when(dominant, F.col("to_dominant"))), 4).alias("dominant_least"), F.round(F.min(F.when(minority, F.col("to_minority"))), 4).alias("minority_least"),
        F.round(F.greatest(F.coalesce(F.max("away"), F.lit(0.0)), F.lit(0.0)), 4).alias("most_away"), yes(F.col("same") & (F.col("away") > 0.4)).alias("far_pairs"),
    )
    quiet = window_overlaps(windows, silences).select(*key, F.col("n").alias("silences"), F.col("overlap_ms").alias("silence_ms"))
    j = windows.join(local, key, "left").join(by, key, "left").join(heard, key, "left").join(quiet, key, "left")
    share = F.when((F.col("local_speakers") >= 2) & (F.col("speech_ms") > 0), F.round(F.col("_least") / F.col("speech_ms"), 3)).otherwise(F.lit(0.0))
    zero = ["local_turns", "local_switches", "local_speakers", "least_turn_ms", "most_turn_ms", "disagreements", "sure_minority", "sure_dominant", "most_away", "far_pairs", "silences", "silence_ms"]
    length = F.greatest(F.col("win_end") - F.col("win_start"), F.lit(1))
    return j.select(*key, F.round(F.coalesce("speech_ms", F.lit(0)) / length, 3).alias("speech_share"), share.alias("minority_share"), "dominant_least", "minority_least", *zero).fillna(0, zero)


def risk_score_audio(f: DataFrame) -> DataFrame:
    """score in hundredths and reasons from window_features and audio_features together (and mixed_hints): disagreement
    of centroids, far neighbours of one label and surplus switches weigh most, what the text alone says less."""
    c = F.col
    upto = lambda name, points, most: F.least(c(name), F.lit(most)) * points
    surplus = c("local_switches") - c("switches")
    single, two = c("speakers") <= 1, c("local_speakers") >= 2
    strict = single & two & (c("minority_share") >= 0.25) & (c("silence_ms") < 6000)
    rules: list[tuple[Column, Column, str]] = [
        (upto("sure_minority", 400, 3), c("sure_minority") >= 1, "confident_minority_audio_in_dominant_label"),
        (upto("sure_dominant", 400, 3), c("sure_dominant") >= 1, "confident_dominant_audio_in_minority_label"),
        (upto("disagreements", 100, 3), (c("disagreements") >= 1) & (c("sure_minority") + c("sure_dominant") == 0), "soft_label_audio_disagreement"),
        (upto("far_pairs", 300, 3), c("far_pairs") >= 1, "same_label_adjacent_far_embeddings"),
        (F.lit(300), surplus >= 3, "local_switches_far_exceed_hyp"),
        (F.lit(150), surplus == 2, "local_switches_exceed_hyp"),
        (F.lit(200), c("dominant_least") < 0.40, "dominant_self_cos_below_0.40"),
        (F.lit(100), (c("dominant_least") >= 0.40) & (c("dominant_least") < 0.55), "dominant_self_cos_below_0.55"),
        (F.lit(300), strict, "single_hyp_but_audio_two_speakers_strict"),
        (F.lit(100), ~strict & single & two & (c("minority_share") >= 0.15), "single_hyp_but_audio_two_speakers"),
        (F.lit(150), c("single_qa"), "single_speaker_with_question_and_answer_cues"),
        (upto("qa_mixed", 150, 2), c("qa_mixed") > 0, "same_segment_question_answer_cues"),
        (upto("mixed_hints", 100, 3), c("mixed_hints") > 0, "mixed_or_confidence_debug"),
        (upto("tight", 75, 4), c("tight") > 0, "tight_speaker_boundaries"),
        (upto("very_short", 50, 4), c("very_short") > 0, "very_short_turns"),
        (F.lit(150), c("aba"), "aba_short_turn"),
        (c("long_cross") * 100, c("long_cross") > 0, "long_segment_crosses_window_boundary"),
        (upto("odd_rate", 50, 3), c("odd_rate") > 0, "abnormal_chars_per_second"),
        (F.lit(30), (c("question_cues") > 0) & (c("answer_cues") > 0) & (c("speakers") <= 2), "question_answer_cues_in_window"),
        (F.lit(50), (c("silence_ms") < 500) & two & (c("speakers") >= 2), "very_low_silence_with_two_speakers_both_in_hyp"),
    ]
    known = [(points, F.coalesce(when, F.lit(False)), reason) for points, when, reason in rules]
    total = sum((F.when(when, points).otherwise(F.lit(0)) for points, when, _ in known), F.lit(0))
    return f.withColumn("score", total.cast("long")).withColumn("reasons", F.array_compact(F.array(*[F.when(when, F.lit(reason)) for _, when, reason in known])))


def top_risks(scored: DataFrame, k: int, least: int = 1) -> DataFrame:
    """The k windows with most risk (a tie: the first)."""
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "file_id", "window_idx").limit(k)


def gate(source: DataFrame) -> DataFrame:
    """Whether a refined window is accepted, and why not. One row a window: window_id, items, low_conf, src_switches,
    out_switches, src_segments, out_segments, very_short, drift (share), both_two (both sides have two speakers),
    max_sim, max_margin (null: unknown)."""
    c = F.col
    rules = [
        ("low_conf_ratio", c("low_conf") / F.greatest(c("items"), F.lit(1)) > 0.35),
        ("too_many_switches", c("out_switches") > F.greatest(F.lit(8), c("src_switches") + 5)),
        ("too_many_output_segments", c("out_segments") > F.greatest(F.lit(10), 4 * c("src_segments") + 4)),
        ("too_many_very_short_segments", c("very_short") >= 4),
        ("speaker_duration_drift", c("both_two") & (c("drift") > 1.25) & (c("src_switches") <= 1)),
        ("low_centroid_similarity", F.coalesce(c("max_sim") < 0.25, F.lit(False))),
        ("low_centroid_margin", F.coalesce(c("max_margin") < 0.03, F.lit(False))),
    ]
    reasons = F.when(c("out_segments") == 0, F.array(F.lit("empty_aligned_output"))).otherwise(F.array_compact(F.array(*[F.when(w, F.lit(name)) for name, w in rules])))
    return source.select("window_id", (F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))


def similar_runs(segments: DataFrame, least: float = 0.95, run: int = 4) -> DataFrame:
    """The first run of at least `run` neighbouring texts (trimmed, non-empty) alike by the difflib ratio, of each file:
    the run's first text, the one that completed it, and their similarity in ten-thousandths."""

    def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = [t.strip() for t in rows.sort_values("seg_idx")["text"] if t and t.strip()]
        first, found = 0, []
        for k in range(1, len(texts)):
            alike = SequenceMatcher(None, texts[k - 1], texts[k]).ratio()
            if alike < least:
                first = k
            elif k - first + 1 >= run:
                found = [(key[0], first, k, round(alike * 10_000))]
                break
        return pd.DataFrame(found, columns=["file_id", "first", "last", "similarity"])

    return shipped(segments).select("file_id", "seg_idx", "text").groupBy("file_id").applyInPandas(find, "file_id long, first long, last long, similarity long")


def timing_report(stages: DataFrame) -> DataFrame:
    """Total, count, mean, extremes and sample deviation by tag and stage. stages: tag, stage, seconds."""
    s = F.col("seconds")
    return stages.groupBy("tag", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(s), 3).alias("total"), F.round(F.avg(s), 3).alias("mean"), F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.coalesce(F.stddev_samp(s), F.lit(0.0)), 3).alias("stdev"))


#: The switch sets that an ablation goes through: name, cluster merge, short-segment guard, silence alignment.
SWITCHES = (("default", True, True, True), ("no_cluster_merge", False, True, True), ("no_short_guard", True, False, True), ("no_silence_align", True, True, False), ("all_off", False, False, False))


def ablation(segments: DataFrame, merged: DataFrame, silences: DataFrame, truth: DataFrame, switches: tuple = SWITCHES) -> DataFrame:
    """One result of recognition and diarization after-treated under each switch set, held against the truth: config,
    file_id, n_speakers, n_segments, speech_ms, delta (speakers found less expected) and verdict (OK, over, under).

    segments: file_id, seg_idx, start_ms, end_ms, speaker, text; merged: file_id, speaker, merged_into; silences: file_id,
    start_ms, end_ms; truth: file_id, expected.
    """
    from .folds import per_file, short_guard
    from .intervals import snap_segments

    to = merged.select("file_id", "speaker", F.col("merged_into").alias("_to"))
    out = None
    for name, merge, guard, align in switches:
        s = segments
        if merge:
            s = s.join(to, ["file_id", "speaker"], "left").withColumn("speaker", F.coalesce("_to", "speaker")).select(*segments.columns)
        s = per_file(s, short_guard) if guard else s
        if align:
            at = snap_segments(s, silences)
            s = s.drop("start_ms", "end_ms").join(at.withColumnsRenamed({"new_start": "start_ms", "new_end": "end_ms"}), ["file_id", "seg_idx"])
        part = s.groupBy("file_id").agg(F.count_distinct("speaker").alias("n_speakers"), F.count(F.lit(1)).alias("n_segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms")).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    delta = F.col("n_speakers") - F.col("expected")
    return out.join(truth, "file_id").select("config", "file_id", "n_speakers", "n_segments", "speech_ms", delta.alias("delta"), F.when(delta == 0, "OK").when(delta > 0, "over").otherwise("under").alias("verdict"))


def _spread(seconds: Column) -> list[Column]:
    return [F.round(F.avg(seconds), 3).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.round(F.coalesce(F.stddev_samp(seconds), F.lit(0.0)), 3).alias("stdev")]


def concurrency_report(results: DataFrame) -> DataFrame:
    """One row: files, files from the cache and their share in percent, processing seconds, and the mean of the server's
    seconds for files that were not cached. results: client_id, cached, seconds, server_seconds."""
    cached = F.count_if("cached")
    fresh = F.when(~F.col("cached"), F.col("server_seconds"))
    return results.agg(F.count(F.lit(1)).alias("n"), cached.alias("n_cached"), F.round(F.coalesce(F.try_divide(cached * 100, F.count(F.lit(1))), F.lit(0.0)), 3).alias("hit_percent"), *_spread(F.col("seconds")), F.round(F.avg(fresh), 3).alias("server_mean"))


def client_report(results: DataFrame) -> DataFrame:
    """Files and processing seconds of each client."""
    return results.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), *_spread(F.col("seconds")))


def errors_by_phase(errors: DataFrame) -> DataFrame:
    """Errors of each phase; without one: unknown. errors: phase."""
    return errors.groupBy(F.coalesce("phase", F.lit("unknown")).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


def run_summary(runs: DataFrame, windows: DataFrame, samples: DataFrame) -> DataFrame:
    """Of each run: seconds spent over seconds of audio (whole, and processed: without windows 0), the same for
    recognition and diarization, windows, warnings, and peaks of memory and processor (without samples 0).

    runs: run_id, audio_s, total_s, asr_s, diarize_s; windows: run_id, duration_s, warnings; samples: run_id, rss_mb,
    cpu_pct. A run without audio has ratios of 0.
    """
    w = windows.groupBy("run_id").agg(F.sum("duration_s").alias("processed_s"), F.count(F.lit(1)).alias("n_windows"), F.sum("warnings").alias("n_warnings"))
    s = samples.groupBy("run_id").agg(F.max("rss_mb").alias("rss_peak_mb"), F.max("cpu_pct").alias("cpu_pct_peak"))
    j = runs.join(w, "run_id", "left").join(s, "run_id", "left").fillna(0, ["processed_s", "n_windows", "n_warnings", "rss_peak_mb", "cpu_pct_peak"])
    over = lambda a, b: F.round(F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0)), 6)
    return j.select(
        "run_id", "processed_s", over("total_s", "audio_s").alias("rtf_full"), over("total_s", "processed_s").alias("rtf_processed"), over("asr_s", "audio_s").alias("asr_rtf_full"), over("asr_s", "processed_s").alias("asr_rtf_processed"),
        over("diarize_s", "audio_s").alias("diarize_rtf"), "n_windows", "n_warnings", "rss_peak_mb", "cpu_pct_peak",
    )
