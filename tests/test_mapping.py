"""Mappings between labellings, as-of joins, admission and reports against plain versions."""

import random
from difflib import SequenceMatcher
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale.operators import cache as ca
from intervale.operators import clusters as cl
from intervale.operators import evaluation as ev
from intervale.operators import intervals as iv
from intervale.operators import lifecycle as lc
from intervale.plans import catalog
from intervale.plans.mapping_queries import spoken_and_heard
from intervale.streaming import uploads as up

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(60))
def test_best_mapping_is_the_first_best(seed):
    r = random.Random(seed)
    hyps, refs = ([f"{c}{k}" for k in range(r.randrange(1, 6))] for c in "hr")
    counts = {(h, f): r.randrange(4) for h in hyps for f in refs if r.random() < 0.8}
    for h in hyps:
        counts.setdefault((h, refs[0]), 1)
    hyps, refs = (sorted({k[j] for k in counts}) for j in (0, 1))
    choices = permutations(refs, len(hyps)) if len(hyps) <= len(refs) else product(refs, repeat=len(hyps))
    score = lambda m: sum(n for (h, f), n in counts.items() if m[h] == f)
    assert ev.best_mapping(counts) == max((dict(zip(hyps, c)) for c in choices), key=score)


def test_best_mapping_of_many_labels():
    r = np.random.default_rng(3)
    counts = {(f"h{k:02}", f"r{j:02}"): int(r.integers(0, 9)) + 1000 * (j == (k * 7 + 3) % 24) for k in range(20) for j in range(24)}
    assert ev.best_mapping(counts) == {f"h{k:02}": f"r{(k * 7 + 3) % 24:02}" for k in range(20)} and ev.best_mapping({}) == {}


def intervals_of(r, files=4, most=25, span=2000):
    rows = []
    for f in range(files):
        for k in range(r.randrange(most)):
            a = r.randrange(span)
            rows.append((f, k, a, a + r.randrange(1, 150), r.randrange(3)))
    return rows


@pytest.mark.parametrize("seed", (1, 2))
def test_as_of_joins_against_all_pairs(spark, seed):
    r = random.Random(seed)
    turns, items = intervals_of(r), intervals_of(r)
    t = spark.createDataFrame(turns, "file_id long, turn_idx long, start_ms long, end_ms long, speaker long")
    points = [(f, k, r.randrange(2300)) for f in range(5) for k in range(30)]
    p = spark.createDataFrame(points, "file_id long, point_id long, at_ms long")
    mid = F.col("start_ms") + F.col("end_ms")
    got = {(x["file_id"], x["point_id"]): (x["_near"], x["_away"]) for x in iv.nearest(p, F.col("at_ms") * 2, t, mid, F.col("turn_idx"), F.col("speaker")).collect()}
    for f, k, at in points:
        near = min(((abs(a + b - 2 * at), i, s) for g, i, a, b, s in turns if g == f), default=(None, None, None))
        assert got[f, k] == (near[2], near[0])
    edges = {(x["file_id"], x["point_id"]): (x["inside"], x["edge_ms"]) for x in iv.nearest_edges(p, t).collect()}
    for f, k, at in points:
        own = [(a, b) for g, _, a, b, _ in turns if g == f]
        assert edges.get((f, k)) == ((any(a < at < b for a, b in own), min(min(abs(at - a), abs(at - b)) for a, b in own)) if own else None)
    i = spark.createDataFrame([x[:4] for x in items], "file_id long, item_idx long, i_start long, i_end long")
    found = {(x["file_id"], x["item_idx"]): (x["speaker"], x["confidence_milli"]) for x in iv.assign_items(i, t).collect()}
    for f, k, a, b, _ in items:
        best = []
        for g, j, c, d, s in turns:
            if g == f:
                over = min(b, d) - max(a, c)
                tier = (0, -over, j, s, min(1000, over * 1000 // max(b - a, 1))) if over > 0 else (1, d - c, j, s, 500) if c <= a and d >= b else (2, min(abs(a - d), abs(c - b)), j, s, 0)
                best.append(tier)
        assert found.get((f, k)) == (min(best)[3:] if best else None)
    chunks = spark.createDataFrame([(f, k, a, b) for f, k, a, b, _ in items], "file_id long, chunk_idx long, c_start long, c_end long")
    bare = {(x["file_id"], x["chunk_idx"]): x["speaker"] for x in iv.clip_chunks_to_turns(chunks, t).where("turn_idx = -1").collect()}
    for f, k, a, b, _ in items:
        own = [x for x in turns if x[0] == f]
        if own and all(min(b, d) - max(a, c) <= 30 for _, _, c, d, _ in own):
            assert bare[f, k] == min((min(abs(2 * c - a - b), abs(2 * d - a - b)), c, j, s) for _, j, c, d, s in own)[3]
        else:
            assert (f, k) not in bare


def test_a_single_known_label_keeps_the_longest_cluster(spark):
    turns = spark.createDataFrame([(1, 0, 100, 7), (1, 100, 400, 8), (2, 0, 500, 1)], "file_id long, start_ms long, end_ms long, speaker long")
    known = spark.createDataFrame([(1, 0, 90, "B"), (2, 600, 700, "A"), (2, 700, 800, "B")], "file_id long, k_start long, k_end long, label string")
    names = spark.createDataFrame([(1, ["A", "B"]), (2, ["A", "B"])], "file_id long, names array<string>")
    assert {(x["file_id"], x["speaker"], x["label"]) for x in cl.map_by_overlap(turns, known, names).collect()} == {(1, 8, "B"), (1, 7, "A"), (2, 1, "A")}


def test_a_cluster_without_centroid_takes_what_is_left(spark):
    local = spark.createDataFrame([(1, 5, 90, [1.0, 0.0]), (1, 6, 80, [0.9, 0.1]), (1, 7, 70, None)], "file_id long, speaker long, dur_ms long, centroid array<double>")
    known = spark.createDataFrame([(1, "A", [1.0, 0.0]), (1, "B", [0.0, 1.0])], "file_id long, label string, centroid array<double>")
    names = spark.createDataFrame([(1, ["A", "B"])], "file_id long, names array<string>")
    rows = {x["speaker"]: x for x in cl.map_by_centroid(local, known, names).collect()}
    assert [rows[k]["label"] for k in (5, 6, 7)] == ["A", "B", "A"] and rows[7]["scores"] is None and rows[5]["margin"] == 1.0
    assert [s["label"] for s in rows[6]["scores"]] == ["A", "B"]


def test_equal_characters_against_a_loop(spark):
    rows = spoken_and_heard(spark, SMALL).limit(12).collect()
    want = {}
    for row in rows:
        ref = [(c, p["speaker"]) for p in row["reference"] for c in ev.normalized(p["text"])]
        hyp = [(c, p["speaker"], p["seg_idx"]) for p in row["hypothesis"] for c in ev.normalized(p["text"])]
        for i, j, n in SequenceMatcher(None, "".join(c for c, _ in ref), "".join(c for c, *_ in hyp), autojunk=False).get_matching_blocks():
            for k in range(n):
                key = (row["file_id"], hyp[j + k][2], hyp[j + k][1], ref[i + k][1])
                want[key] = want.get(key, 0) + 1
    got = {(x["file_id"], x["seg_idx"], x["hyp"], x["ref"]): x["n"] for x in ev.equal_characters(spark.createDataFrame(rows, spoken_and_heard(spark, SMALL).schema)).collect()}
    assert got == want and len({k[2] for k in want}) > 1
    sums = {(x["hyp"], x["ref"]): x["n"] for x in ev.confusion_of(spark.createDataFrame([(1, 0, "a", "b", 3), (1, 1, "a", "b", 4)], "file_id long, seg_idx long, hyp string, ref string, n long")).collect()}
    assert sums == {("a", "b"): 7}


def test_a_rejected_task_does_not_wait():
    log = [(1, 10, "pending"), (2, 11, "pending"), (3, 12, "pending"), (4, 12, "processing"), (5, 13, "pending"), (6, 10, "processing"), (7, 14, "pending"), (8, 15, "pending")]
    assert lc.admission_steps(log, 2) == [(1, 0, True), (2, 1, True), (3, 2, False), (5, 2, False), (7, 1, True), (8, 2, False)]


def test_eviction_ranks_ties_by_id(spark):
    rows = spark.createDataFrame([(k, f"h{k}", "e", 1, 1000, 50 if k < 8 else 60 + k) for k in range(12)], "id long, file_hash string, engine string, result_len long, created_s long, accessed_s long")
    for most in (1, 4, 6, 12, 99):
        assert sorted(x["id"] for x in ca.evict(rows, 1000, 100, most).collect()) == list(range(12))[max(0, 12 - most) :]
    assert ca.evict(rows.limit(0), 1000, 100, 3).count() == 0 and ca.evict(rows, 1000, 100, 0).count() == 12


def test_merge_log_tells_of_every_merge(spark):
    d = "/root/testdata/sf0.01"
    log = catalog.queries()["cl1_merge_log"](spark, d).collect()
    to = {(x["file_id"], x["speaker"]): x["merged_into"] for x in catalog.queries()["cl1_jn13_merge_clusters"](spark, d).collect()}
    moved = {k for k, v in to.items() if k[1] != v}
    told = {(x["file_id"], x["from_speaker"]) for x in log if not x["action"].startswith(("skip", "minor_kept"))}
    assert moved and moved == told
    folded = {(x["file_id"], x["step"]) for x in log}
    assert len(folded) == len(log)


def test_uploads_are_checked(spark):
    chunks = spark.createDataFrame([(1, 1, 5, b"cd"), (1, 0, 9, b"ab"), (1, 1, 7, b"XX"), (2, 0, 1, b"")], "session long, chunk_index long, arrival long, data binary")
    files = up.assembled(chunks)
    rows = {x["session"]: x for x in files.collect()}
    assert bytes(rows[1]["data"]) == b"abcd" and rows[1]["size"] == 4 and rows[2]["size"] == 0
    told = spark.createDataFrame([(1, 2, 4, rows[1]["md5"].upper()), (2, 2, 0, rows[2]["md5"])], "session long, chunks long, size long, md5 string")
    assert {(x["session"], x["complete"], x["accepted"]) for x in up.checked(files, told).collect()} == {(1, True, True), (2, False, False)}


def test_reports_of_nothing(spark):
    empty = spark.createDataFrame([], "client_id long, cached boolean, seconds double, server_seconds double")
    assert ev.concurrency_report(empty).first()["hit_percent"] == 0
    runs = spark.createDataFrame([(1, 0, 5, 4, 0)], "run_id long, audio_s long, total_s long, asr_s long, diarize_s long")
    none = spark.createDataFrame([], "run_id long, duration_s long, warnings long"), spark.createDataFrame([], "run_id long, rss_mb long, cpu_pct long")
    row = ev.run_summary(runs, *none).first()
    assert (row["rtf_full"], row["rtf_processed"], row["rss_peak_mb"]) == (0, 0, 0)


@pytest.mark.parametrize("name", ["jn6_map_by_overlap", "jn7_map_by_centroid", "jn16_match_speakers", "ds4_classify_chunks", "st2_admission", "jn12_minor_to_main", "ag10_best_mapping"])
def test_queries_do_something(spark, name):
    """What the query decides is not always the same, so that a check of it means something."""
    rows = catalog.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    column = {"jn6_map_by_overlap": "label", "jn7_map_by_centroid": "label", "jn16_match_speakers": "r", "ds4_classify_chunks": "label", "st2_admission": "admitted", "jn12_minor_to_main": "main", "ag10_best_mapping": "mapped"}[name]
    assert rows[column].nunique() > 1


def test_guard_counts_add_up():
    from intervale.operators import folds as fo

    r = random.Random(5)
    seen = {}
    for _ in range(200):
        rows, at = [], 0
        for _ in range(r.randrange(12)):
            at += r.randrange(300)
            rows.append({"start_ms": at, "end_ms": (at := at + r.choice([300, 900, 2000])), "speaker": r.randrange(2), "text": r.choice(["对", "yes well", "a much longer text than that", ""])})
        n = fo.guard_counts(rows)
        assert len(fo.short_guard(rows)) == len(rows) - n["into_prev"] - n["into_next"] - n["merged"]
        seen = {k: seen.get(k, 0) + v for k, v in n.items()}
    assert all(seen.values())


def test_ablation_against_its_steps(spark):
    from intervale.operators import folds as fo
    from intervale.plans.fold_queries import spoken

    rows = {(x["config"], x["file_id"]): x for x in catalog.queries()["ag25_ablation_switches"](spark, SMALL).collect()}
    files: dict = {}
    for x in spoken(spark, SMALL).orderBy("file_id", "seg_idx").collect():
        files.setdefault(x["file_id"], []).append({"start_ms": x["start_ms"], "end_ms": x["end_ms"], "speaker": x["speaker"], "text": x["text"]})
    assert len(rows) == 5 * len(files)
    for f, segments in files.items():
        for name, merge, guard, align in ev.SWITCHES:
            s = [x | {"speaker": 0 if merge and x["speaker"] == 2 else x["speaker"]} for x in segments]
            s = fo.short_guard(s) if guard else s
            got, n = rows[name, f], len({x["speaker"] for x in s})
            assert (got["n_speakers"], got["n_segments"]) == (n, len(s)) and got["delta"] == n - (f % 3 + 1) and got["verdict"] == ("OK" if got["delta"] == 0 else "over" if got["delta"] > 0 else "under")
            if not align:
                assert got["speech_ms"] == sum(x["end_ms"] - x["start_ms"] for x in s)
    assert len({(x["n_segments"], x["n_speakers"]) for x in rows.values()}) > 2


def test_audio_features_against_loops(spark):
    from intervale.plans.mapping_queries import review_windows

    windows, turns, pieces, silences = (x.collect() for x in review_windows(spark, SMALL))
    got = {(x["file_id"], x["window_idx"]): x for x in ev.audio_features(*review_windows(spark, SMALL)).collect()}
    assert len(got) == len(windows)
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    far = 0
    for w in windows:
        key = (w["file_id"], w["window_idx"])
        row = got[key]
        t = sorted((x for x in turns if (x["file_id"], x["window_idx"]) == key), key=lambda x: (x["start_ms"], x["turn_idx"]))
        p = sorted((x for x in pieces if (x["file_id"], x["window_idx"]) == key), key=lambda x: x["seg_idx"])
        by: dict = {}
        for x in t:
            by[x["speaker"]] = by.get(x["speaker"], 0) + x["end_ms"] - x["start_ms"]
        speech = sum(by.values())
        assert (row["local_turns"], row["local_speakers"], row["local_switches"]) == (len(t), len(by), sum(a["speaker"] != b["speaker"] for a, b in zip(t, t[1:])))
        assert row["minority_share"] == pytest.approx(min(by.values()) / speech if len(by) > 1 else 0, abs=6e-4) and row["speech_share"] == pytest.approx(speech / 10_000, abs=6e-4)
        m = [(x["role"], x["to_dominant"] - x["to_minority"]) for x in p if x["to_minority"] is not None]
        assert row["sure_minority"] == sum(r == "dominant" and d < -0.10 for r, d in m) and row["sure_dominant"] == sum(r == "minority" and d > 0.10 for r, d in m)
        assert row["disagreements"] == sum((r == "dominant" and d < -0.05) or (r == "minority" and d > 0.05) for r, d in m)
        away = [(1 - cos(a["embedding"], b["embedding"]), a["role"] == b["role"]) for a, b in zip(p, p[1:])]
        assert row["most_away"] == pytest.approx(max((a for a, _ in away), default=0), abs=1e-4) and row["far_pairs"] == sum(a > 0.4 and s for a, s in away)
        far += row["far_pairs"]
        over = [min(x["end_ms"], w["win_end"]) - max(x["start_ms"], w["win_start"]) for x in silences if x["file_id"] == w["file_id"]]
        assert (row["silences"], row["silence_ms"]) == (sum(x > 0 for x in over), sum(x for x in over if x > 0))
    assert far
