"""Sequential rewrites whose steps read their own earlier output, as folds over one file's rows.

Each fold is a pure function over lists of segments (dicts with start_ms, end_ms, speaker, text) and runs in one
applyInPandas per file; several folds chain inside the same call. A file has thousands of segments at most, which is
what one task holds at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import ANSWER_CUES, BACKCHANNELS, PURE_PUNCTUATION, QUESTION_CUES
from ..shipping import shipped

Segment = dict
_PURE = re.compile(PURE_PUNCTUATION)
SENTENCE_ENDS = "。？！；!?;"


def half_even(numerator: int, denominator: int) -> int:
    """The nearest whole number to a fraction of non-negative numbers, halves to even."""
    whole, rest = divmod(numerator, denominator)
    return whole + (2 * rest > denominator or (2 * rest == denominator and whole % 2 == 1))


def filler(text: str) -> bool:
    return not text or text.strip() in BACKCHANNELS or bool(_PURE.match(text))


def absorb_tiny(segments: Iterable[Segment], least_ms: int, joined: dict[str, int] | None = None) -> list[Segment]:
    """Segments shorter than least_ms that have text join the neighbour with the smaller gap (a tie: the one before, as
    it stands after earlier joins). What a join with the one after makes is not tested again. joined: gets the numbers of
    joins with the one before (into_prev) and after (into_next)."""
    joined = {} if joined is None else joined
    joined |= {"into_prev": 0, "into_next": 0}
    todo = [dict(s) for s in segments]
    done: list[Segment] = []
    k = 0
    while k < len(todo):
        now = todo[k]
        after = todo[k + 1] if k + 1 < len(todo) else None
        k += 1
        if now["end_ms"] - now["start_ms"] >= least_ms or not (now["text"] or "").strip():
            done.append(now)
            continue
        before = done[-1] if done else None
        backwards = before is not None and (after is None or now["start_ms"] - before["end_ms"] <= after["start_ms"] - now["end_ms"])
        if backwards:
            before["text"] = (before["text"] or "") + now["text"]
            before["end_ms"] = max(before["end_ms"], now["end_ms"])
            joined["into_prev"] += 1
        elif after is not None:
            joined["into_next"] += 1
            done.append(after | {"text": now["text"] + (after["text"] or ""), "start_ms": min(now["start_ms"], after["start_ms"])})
            k += 1
        else:
            done.append(now)
    return done


def smooth_aba(segments: Iterable[Segment], most_ms: int) -> list[Segment]:
    """The middle of an A-B-A takes A's speaker if it is a filler, or at most 1 s long with 5 characters a second or
    more. Later steps see what earlier ones wrote."""
    out = [dict(s) for s in segments]
    for left, mid, right in zip(out, out[1:], out[2:]):
        length = mid["end_ms"] - mid["start_ms"]
        if left["speaker"] != right["speaker"] or left["speaker"] == mid["speaker"] or length > most_ms:
            continue
        text = (mid["text"] or "").strip()
        dense = 0 < length <= 1000 and len(text) * 1000 >= 5 * length
        if filler(text) or dense:
            mid["speaker"] = left["speaker"]
    return out


def join_same(segments: Iterable[Segment], gap_ms: int) -> list[Segment]:
    out: list[Segment] = []
    for s in segments:
        last = out[-1] if out else None
        if last and last["speaker"] == s["speaker"] and s["start_ms"] - last["end_ms"] <= gap_ms:
            last["text"] = (last["text"] or "") + (s["text"] or "")
            last["end_ms"] = max(last["end_ms"], s["end_ms"])
        else:
            out.append(dict(s))
    return out


def short_guard(segments: Iterable[Segment], least_ms: int = 1500, most_mid_ms: int = 1500, gap_ms: int = 50) -> list[Segment]:
    return join_same(smooth_aba(absorb_tiny(segments, least_ms), most_mid_ms), gap_ms)


def guard_counts(segments: Iterable[Segment], least_ms: int = 1500, most_mid_ms: int = 1500, gap_ms: int = 50) -> dict[str, int]:
    """What short_guard does: tiny segments joined with the one before or after, speakers smoothed, neighbours merged."""
    counts: dict[str, int] = {}
    whole = absorb_tiny(segments, least_ms, counts)
    smooth = smooth_aba(whole, most_mid_ms)
    changed = sum(a["speaker"] != b["speaker"] for a, b in zip(whole, smooth, strict=True))
    return counts | {"smoothed": changed, "merged": len(smooth) - len(join_same(smooth, gap_ms))}


def guard_stats(segments: DataFrame, **limits: int) -> DataFrame:
    """guard_counts of each file."""
    names = ("into_prev", "into_next", "smoothed", "merged")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = guard_counts(rows.sort_values("seg_idx")[["start_ms", "end_ms", "speaker", "text"]].to_dict("records"), **limits)
        return pd.DataFrame([(key[0], *(found[c] for c in names))], columns=["file_id", *names])

    return shipped(segments).select("file_id", "seg_idx", "start_ms", "end_ms", "speaker", "text").groupBy("file_id").applyInPandas(run, "file_id long, " + ", ".join(f"{c} long" for c in names))


def smooth_roles(segments: Iterable[Segment], guard: bool = False, most_question_ms: int = 10_000, most_answer_ms: int = 12_000) -> list[Segment]:
    """Two speakers: the one with more text answers, the other asks; short segments whose cues say otherwise change
    sides. With the guard an answer needs an answering neighbour, the one before as already rewritten."""
    out = [dict(s) for s in segments]
    mass: dict = {}
    for s in out:
        mass[s["speaker"]] = mass.get(s["speaker"], 0) + len(s["text"] or "")
    if len(mass) != 2:
        return out
    answers, asks = sorted(mass, key=lambda k: -mass[k])
    # At the end of a text only, a closing particle is a question cue here.
    cues = [re.compile(c + "$" if c == "吗[？?]?" else c) for c in QUESTION_CUES], [re.compile(c) for c in ANSWER_CUES[:11]]
    for k, s in enumerate(out):
        q, a = (sum(bool(c.search(s["text"] or "")) for c in some) for some in cues)
        length = s["end_ms"] - s["start_ms"]
        near = {out[j]["speaker"] for j in (k - 1, k + 1) if 0 <= j < len(out)}
        if s["speaker"] == answers and length <= most_question_ms and q >= max(1, a):
            s["speaker"] = asks
        elif s["speaker"] == asks and length <= most_answer_ms and a >= 1 and a > q and (not guard or answers in near):
            s["speaker"] = answers
    return out


def unique_boundaries(segments: Iterable[Segment], duration_ms: int, apart_ms: int = 10) -> list[int]:
    """Starts and ends well inside the file, each more than apart_ms after the last one kept."""
    kept: list[int] = []
    for at in sorted(t for s in segments for t in (s["start_ms"], s["end_ms"]) if apart_ms < t < duration_ms - apart_ms):
        if not kept or at - kept[-1] > apart_ms:
            kept.append(at)
    return kept


def _near_sentence_end(text: str, target: int, reach: int) -> int:
    if target <= 0 or target >= len(text):
        return max(0, min(target, len(text)))
    ends = [k for k in range(max(1, target - reach), min(len(text) - 1, target + reach) + 1) if text[k - 1] in SENTENCE_ENDS]
    return min(ends, key=lambda k: abs(k - target), default=target)


def split_text(text: str, weights: list[int]) -> list[str]:
    """The text in len(weights) parts by weight, cut at sentence ends near by; joined they are the text."""
    if not weights:
        return []
    weights = [max(0, w) for w in weights]
    if not any(weights):
        weights = [1] * len(weights)
    total, sofar, at, parts = sum(weights), 0, 0, []
    for w in weights[:-1]:
        sofar += w
        target = max(at, half_even(len(text) * sofar, total))
        reach = min(18, max(2, half_even(target - at, 2)))
        cut = _near_sentence_end(text, target, reach)
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def merge_chunks_and_turns(chunks: Iterable[dict], turns: Iterable[dict], least_ms: int = 30) -> list[Segment]:
    """Each chunk's text split among the turns that overlap it by more than least_ms, by time; a chunk with none takes
    the speaker of the turn with the edge nearest to its middle. Empty parts are dropped."""
    ordered = sorted(turns, key=lambda t: t["start_ms"])
    if not ordered:
        return []
    out: list[Segment] = []
    for c in sorted((c for c in chunks if c["text"] and c["end_ms"] > c["start_ms"]), key=lambda c: (c["start_ms"], c["end_ms"])):
        parts = [(max(c["start_ms"], t["start_ms"]), min(c["end_ms"], t["end_ms"]), t["speaker"]) for t in ordered]
        parts = [p for p in parts if p[1] - p[0] > least_ms]
        if not parts:
            mid2 = c["start_ms"] + c["end_ms"]
            near = min(ordered, key=lambda t: min(abs(2 * t["start_ms"] - mid2), abs(2 * t["end_ms"] - mid2)))
            parts = [(c["start_ms"], c["end_ms"], near["speaker"])]
        for (a, b, who), text in zip(parts, split_text(c["text"], [b - a for a, b, _ in parts])):
            if text:
                out.append({"start_ms": a, "end_ms": b, "speaker": who, "text": text})
    return out


def plan_windows(gaps: list[tuple[int, int]], duration_ms: int, target: int = 720_000, soft: int = 900_000, hard: int = 1_200_000, least: int = 180_000, overlap: int = 0, reach: int = 60_000) -> list[dict]:
    """Long recordings cut greedily: at the gap whose middle is nearest to the target (a tie: the longest gap) within
    reach, else the nearest up to the hard limit, else at the target. A short tail joins the last window, which may so
    exceed the hard limit. gaps: silences (start, end) of at least the wanted length."""
    if not 0 < least <= target <= soft <= hard or overlap < 0:
        raise ValueError("window limits must grow: least, target, soft, hard")
    out: list[dict] = []
    start = 0
    while start < duration_ms:
        end = duration_ms
        if duration_ms - start > soft:
            goal, first = start + target, start + least
            for low, high in ((max(first, goal - reach), min(start + soft, goal + reach)), (first, start + hard)):
                inside = [g for g in gaps if 2 * low <= g[0] + g[1] <= 2 * min(high, duration_ms)]
                if inside:
                    best = min(inside, key=lambda g: (abs(g[0] + g[1] - 2 * goal), g[0] - g[1]))
                    end = half_even(best[0] + best[1], 2)
                    break
            else:
                end = goal
        if end <= start:
            end = min(duration_ms, start + hard)
        if duration_ms - end < least:
            end = duration_ms
        out.append({"idx": len(out), "start_ms": start, "end_ms": end, "asr_start_ms": max(0, start - overlap) if out else start, "asr_end_ms": end})
        start = end
    return out


def pick_cuts(start: int, end: int, candidates: list[float], most: int, least: int) -> tuple[list[float], int]:
    """Cuts near the points that divide the span evenly: the nearest candidate that leaves `least` on both sides, else
    the point itself, moved inside. Also how many were made without a candidate."""
    parts = math.ceil((end - start) / most)
    cuts: list[float] = []
    hard, last = 0, start
    for k in range(1, parts):
        goal = start + (end - start) * k / parts
        usable = [c for c in sorted(candidates) if last + least <= c <= end - least]
        cut = min(usable, key=lambda c: abs(c - goal)) if usable else min(max(goal, last + least), end - least)
        if not usable:
            if cut <= last + least:
                continue
            hard += 1
        cuts.append(cut)
        last = cut
    return cuts, hard


def split_long(segments: Iterable[Segment], silences: list[tuple[int, int]], most: int, least: int) -> list[Segment]:
    """Segments longer than `most` cut between words where they have any, else at silences, else evenly."""
    out: list[Segment] = []
    for s in segments:
        words = s.get("words") if s.get("words") is not None else []
        if s["end_ms"] - s["start_ms"] <= most or not (s["text"] or "").strip():
            out.append(s)
            continue
        mids = [(a["end_ms"] + b["start_ms"]) / 2 for a, b in zip(words, words[1:])] if len(words) else [(a + b) / 2 for a, b in silences]
        cuts, _ = pick_cuts(s["start_ms"], s["end_ms"], [m for m in mids if s["start_ms"] + least <= m <= s["end_ms"] - least], most, least)
        edges = [s["start_ms"], *cuts, s["end_ms"]]
        spans = list(zip(edges, edges[1:]))
        texts = split_text(s["text"], [round((b - a) * 2) for a, b in spans])
        for k, ((a, b), text) in enumerate(zip(spans, texts)):
            last = k == len(spans) - 1
            own = [w for w in words if a <= (w["start_ms"] + w["end_ms"]) / 2 and ((w["start_ms"] + w["end_ms"]) / 2 < b or (last and (w["start_ms"] + w["end_ms"]) / 2 == b))]
            out.append(s | {"start_ms": round(a), "end_ms": round(b), "text": text, "words": own or None} if cuts else s)
    return out


FOLDED = "file_id long, seg_idx long, start_ms long, end_ms long, speaker long, text string"


def per_file(segments: DataFrame, fold: Callable[[list[Segment]], list[Segment]]) -> DataFrame:
    """One fold, or several chained, over each file's segments in order; renumbered from 0."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = fold(rows.sort_values("seg_idx")[["start_ms", "end_ms", "speaker", "text"]].to_dict("records"))
        out = pd.DataFrame(found, columns=["start_ms", "end_ms", "speaker", "text"])
        out.insert(0, "seg_idx", range(len(out)))
        out.insert(0, "file_id", key[0])
        return out

    return shipped(segments).select("file_id", "seg_idx", "start_ms", "end_ms", "speaker", "text").groupBy("file_id").applyInPandas(run, FOLDED)
