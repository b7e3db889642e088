"""Worked cases and invariants of the sequential operators."""

import random

import numpy as np
import pytest

from intervale.operators import clusters as cl
from intervale.operators import evaluation as ev
from intervale.operators import folds as fo


def seg(a, b, who=0, text="abc"):
    return {"start_ms": a, "end_ms": b, "speaker": who, "text": text}


def test_tiny_segments_join_the_nearer_side_and_ties_go_back():
    out = fo.absorb_tiny([seg(0, 2000, 0, "a"), seg(2100, 2300, 1, "b"), seg(2400, 5000, 2, "c")], 1500)
    assert [(s["text"], s["end_ms"]) for s in out] == [("ab", 2300), ("c", 5000)]
    assert fo.absorb_tiny([seg(0, 100, 0, "x")], 1500) == [seg(0, 100, 0, "x")]


def test_a_join_with_the_next_is_not_tested_again():
    out = fo.absorb_tiny([seg(0, 100, 0, "a"), seg(110, 220, 1, "b"), seg(9000, 12000, 1, "c")], 1500)
    assert [s["text"] for s in out] == ["ab", "c"]


def test_inputs_are_not_changed():
    rows = [seg(0, 2000), seg(2100, 2200, 1), seg(2200, 6000)]
    before = [dict(r) for r in rows]
    fo.short_guard(rows)
    assert rows == before


def test_aba_reads_its_own_writes():
    rows = [seg(0, 500, 0, "对"), seg(500, 1000, 1, "对"), seg(1000, 1500, 0, "对"), seg(1500, 2000, 1, "对")]
    assert [s["speaker"] for s in fo.smooth_aba(rows, 1500)] == [0, 0, 0, 1]


def test_boundaries_count_from_the_last_one_kept():
    rows = [seg(100, 108), seg(116, 124)]
    assert fo.unique_boundaries(rows, 1000) == [100, 116]


@pytest.mark.parametrize("seed", range(30))
def test_split_text_is_lossless(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab。？ c!") for _ in range(r.randrange(120)))
    weights = [r.randrange(0, 900) for _ in range(r.randrange(1, 9))]
    parts = fo.split_text(text, weights)
    assert len(parts) == len(weights) and "".join(parts) == text


def test_chunks_follow_turns():
    chunks = [seg(0, 10_000, text="主持人提问？嘉宾回答。"), seg(10_000, 20_000, text="嘉宾继续解释。")]
    out = fo.merge_chunks_and_turns(chunks, [seg(0, 4000, 1), seg(4000, 20_000, 0)])
    assert [s["speaker"] for s in out] == [1, 0, 0]
    assert out[0]["text"] == "主持人提问？"
    assert "".join(s["text"] for s in out) == "主持人提问？嘉宾回答。嘉宾继续解释。"


def test_a_short_turn_takes_little_text():
    out = fo.merge_chunks_and_turns([seg(0, 10_000, text="这是一整句话。后面内容继续。")], [seg(0, 500, 1), seg(500, 10_000, 0)])
    assert [s["speaker"] for s in out] == [1, 0] and len(out[0]["text"]) <= 3


def test_windows_prefer_silence():
    plain = fo.plan_windows([], 4_980_000)
    assert [w["end_ms"] - w["start_ms"] for w in plain[:3]] == [720_000] * 3 and plain[-1]["end_ms"] == 4_980_000
    assert fo.plan_windows([(704_000, 716_000)], 1_800_000)[0]["end_ms"] == 710_000
    assert fo.plan_windows([], 1_800_000, overlap=10_000)[1]["asr_start_ms"] == 710_000
    assert fo.plan_windows([], 0) == []
    with pytest.raises(ValueError):
        fo.plan_windows([], 1, target=1, least=2)


def test_long_segments_are_cut_at_silences_and_else_evenly():
    s = seg(0, 40_000, 0, "字" * 40)
    out = fo.split_long([s], [(12_900, 13_100), (25_900, 26_100)], 15_000, 1_000)
    assert [x["end_ms"] for x in out] == [13_000, 26_000, 40_000] and "".join(x["text"] for x in out) == s["text"]
    even = fo.split_long([s], [], 12_000, 1_000)
    assert len(even) == 4 and max(x["end_ms"] - x["start_ms"] for x in even) <= 12_010
    words = [{"text": "w", "start_ms": 2000 * k, "end_ms": 2000 * k + 1500} for k in range(20)]
    cut = fo.split_long([s | {"words": words}], [], 12_000, 1_000)
    assert sum(len(x["words"] or []) for x in cut) == 20


def test_cosine_and_merges():
    assert cl.cosine(None, [1.0]) == -1 and cl.cosine([0.0, 0.0], [1.0, 0.0]) == -1
    assert cl.cosine([1.0, 0.0], [0.0, 1.0]) == 0 and cl.cosine([1.0, 2.0], [2.0, 4.0]) == pytest.approx(1)
    near = {k: np.array([1.0, 0.01 * k]) for k in range(3)}
    to, events = cl.merge_plan({0: 50, 1: 30, 2: 20}, near)
    assert set(to.values()) == {0} and len(events) == 2
    assert cl.complete_linkage(np.zeros((0, 2)), 0.5) == [] and cl.complete_linkage(np.ones((1, 2)), 0.5) == [0]
    assert cl.complete_linkage(np.array([[1.0, 0], [1, 0.01], [0, 1], [0.01, 1]]), 0.5) == [0, 0, 1, 1]


def plain_linkage(vectors, most):
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    away = 1 - unit @ unit.T
    groups = [[k] for k in range(len(vectors))]
    while pairs := [(max(away[x, y] for x in a for y in b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]:
        d, i, j = min(pairs)
        if d > most:
            break
        groups[i] += groups.pop(j)
    of = {k: g for g, members in enumerate(groups) for k in members}
    names = {}
    return [names.setdefault(of[k], len(names)) for k in range(len(vectors))]


@pytest.mark.parametrize("held", [1, 64, 1 << 25])
@pytest.mark.parametrize("most", [0.05, 0.4, 0.9, 1.0, 1.6])
def test_linkage_merges_nearest_first_by_vectors_and_by_matrix(most, held):
    rng = np.random.default_rng(5)
    few = rng.normal(size=(6, 5))
    zeros = rng.normal(size=(24, 3))
    zeros[::5] = 0
    for v in (rng.normal(size=(30, 4)), few[rng.integers(0, 6, 30)], zeros, rng.choice([-0.5, 0.5], size=(25, 4)), np.eye(3)[rng.integers(0, 3, 12)]):
        assert cl.complete_linkage(v, most, held) == plain_linkage(v, most)


def test_a_vector_without_finite_values_stays_alone():
    v = np.array([[1.0, 0], [np.nan, 1], [1, 0.01], [np.inf, 0], [np.inf, 0], [1, 0]])
    assert cl.complete_linkage(v, 0.5) == [0, 1, 0, 2, 3, 0]
    assert cl.complete_linkage(v[1:2], 0.5) == [0] and cl.complete_linkage(v[3:5], 0.5) == [0, 1]


def test_linkage_takes_the_square_of_the_vectors_not_the_cube():
    import time

    v = np.random.default_rng(6).normal(size=(4000, 64))
    began = time.process_time()
    labels = cl.complete_linkage(v, 0.9)
    assert time.process_time() - began < 15
    assert len(labels) == 4000 and set(labels) == set(range(max(labels) + 1))


def test_each_file_is_clustered_in_a_task_of_its_own(spark):
    from pyspark.sql import functions as F

    v = spark.range(120).select((F.col("id") % 4).alias("file_id"), F.col("id").alias("seg_idx"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    tasks = cl.cluster_vectors(v, 0.5).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("file_id").alias("files")).collect()
    assert [r["files"] for r in tasks] == [1] * 4


def test_edit_counts_and_mapping():
    assert ev.edit_counts("abcd", "abxd")["edits"] == 1
    assert ev.normalized("Ａ， b!") == "ab"
    assert ev.best_mapping({("x", "p"): 3, ("x", "q"): 1, ("y", "p"): 4}) == {"x": "q", "y": "p"}


def test_alerts():
    from intervale.streaming.alerts import step

    up = {"reachable": True, "health": "healthy", "queue_size": 2, "queue_max": 20, "errors_total": 4}
    sent, state = step(up | {"reachable": False}, {}, 0)
    assert [a["key"] for a in sent] == ["server_down"]
    sent, again = step(up | {"reachable": False}, state, 500)
    assert not sent and again["active"]["server_down"]["last_notified"] == 0
    sent, state = step(up, again, 600)
    assert [a["level"] for a in sent] == ["recovery"]
    sent, _ = step(up | {"queue_size": 18}, state, 700)
    assert [a["key"] for a in sent] == ["queue_saturation"]
    assert not step(up | {"queue_max": 0}, state, 700)[0]
    assert [a["key"] for a in step(up | {"errors_total": 10}, state, 700)[0]] == ["error_surge"]
    assert not step(up, {}, 0)[0]


def test_layers():
    from intervale.sources.config import layered

    out = layered({"a": {"b": 1, "c": 2}, "_comment": 0}, {"a": {"b": 5}}, {"a": {"c": 7}}, {"X": "9"}, {"X": "a.b"})
    assert out == {"a": {"b": 9, "c": 7}}
