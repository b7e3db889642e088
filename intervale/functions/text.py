"""Text functions: filler and question tests, subtitle times, cue counts, ordered glossaries, repetition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filler tokens, question tails, cue patterns.
BACKCHANNELS = ("对", "嗯嗯", "好的", "是的")
PURE_PUNCTUATION = r"^[，。！？!?,.\s]+$"
QUESTION_TAIL = r"(对吗|是吧|是不是|有没有|可以吗|好吗|是吗)$"
QUESTION_TAIL_CHARS = 14
QUESTION_CUES = ("你觉得", "你们", "可以讲讲", "能不能", "会不会", "有没有", "是不是", "是什么", "为什么", "商业模式", "接下来", "同意.{0,8}吗", "吗[？?]?", "[？?]")
ANSWER_CUES = ("我觉得", "在我看来", "我相信", "我们公司", "我们自己", "我是", "我的", "我刚", "对我来讲", "龙虾", "章鱼", "明略", "开源")


def is_backchannel(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return (trimmed == "") & (F.coalesce(F.length(text), F.lit(0)) == 0) | trimmed.isin(*BACKCHANNELS) | F.coalesce(text.rlike(PURE_PUNCTUATION), F.lit(False))


def is_question_tail(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(trimmed) <= QUESTION_TAIL_CHARS) & trimmed.rlike(QUESTION_TAIL)


def cue_count(text: Column, cues: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for c in cues:
        out = out + text.rlike(c).cast("int")
    return out


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds."""
    part = lambda unit, most: F.floor(ms / unit) % most if most else F.floor(ms / unit)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def srt_time_truncated(ms: Column) -> Column:
    """The same, but with the milliseconds cut from the fraction of the seconds as a double: 4.35 s gives ,349."""
    seconds = ms / 1000
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(seconds) % 60, F.floor((seconds % 1) * 1000))


def replace_in_order(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other: later ones see the output of earlier ones."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def repetition(text: Column, shortest: int = 2, longest: int = 12, repeats: int = 6) -> Column:
    """The first phrase, shortest size first, then leftmost, that follows itself at least `repeats` times; else null."""
    compact = F.regexp_replace(text, r"\s+", "")
    found = [F.nullif(F.regexp_extract(compact, rf"(?s)(.{{{n}}})\1{{{repeats - 1},}}", 1), F.lit("")) for n in range(shortest, longest + 1)]
    return F.coalesce(*found)


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[一-鿿]")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null or zero vectors: -1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0).cast("double"), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / F.nullif(norm, F.lit(0.0))), F.lit(-1.0))
