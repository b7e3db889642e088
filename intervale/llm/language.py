"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans of mixed text.

Words are runs of letters (ASCII digits and punctuation end them). A word's score for a language is the sum of the
log-probabilities of its byte n-grams there; languages that hardly ever use the word's script are no candidates. The
best path pays a penalty for each switch of language. A document's language is the one whose words have most bytes
(a tie: the first by name), its score their share. Nothing but the text is an input of a prediction.

The n-gram tables are learnt from a sample of labelled documents, about SAMPLE_DOCS a language by a hash of the id, for
every language that a label of a row not held out names. Only counts above 0 are kept, at most BUCKETS a language, and that is broadcast; with
more languages slices of text are smaller. Texts are never cut.

Defined results: null texts and texts without a letter are `und` with score 0 and no spans, and so is everything if
no labelled row exists; rows are never dropped or merged, whatever their ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEPPED_BYTES, id_remainder, map_slices, np_id_remainder, table, text_of
from .words import Words, mix, words_of

FOLDS, HELD_OUT = 3, 1
SAMPLE_DOCS = 1500
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SWITCH = 25.0
#: Table entries that are summed together; languages up to which slices of text have their full size.
ENTRIES, FULL_SLICES = 1 << 22, 16
#: Least share of a language's words for a script to belong to it.
SCRIPT_SHARE = 0.01
#: The score of a word in a language that its script rules out.
FORBIDDEN = -1e5
#: First code points of the ranges of scripts, and the script that begins there; 0: no letters of a known script.
_RANGES = ((0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 1), (0xB6, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xA00, 9), (0xB80, 10), (0xC00, 0), (0xE00, 11), (0xE80, 0), (0x10A0, 12), (0x1100, 13), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 14), (0x3100, 0), (0x3400, 15), (0xA000, 0), (0xAC00, 13), (0xD7B0, 0), (0xF900, 15), (0xFB00, 0), (0x20000, 15), (0x30000, 0))
_FROM, _SCRIPT = (np.array(x, np.int64) for x in zip(*_RANGES, strict=True))
SCRIPTS = 16
_LETTER = regex.compile(r"\p{L}")
_OTHER = np.zeros(256, bool)
_OTHER[[c for c in range(128) if not chr(c).isalpha()]] = True


def scripts_of(words: Words, at: np.ndarray) -> np.ndarray:
    """The script of the first code point of the words at the given places."""
    data = np.concatenate([words.data, np.zeros(3, np.uint8)]).astype(np.int64)
    start = words.start[at]
    lead, *rest = (data[start + k] for k in range(4))
    tail = [x & 63 for x in rest]
    two, three, four = (lead & 31) << 6 | tail[0], (lead & 15) << 12 | tail[0] << 6 | tail[1], (lead & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)))
    return _SCRIPT[np.searchsorted(_FROM, point, "right") - 1]


def word_ngrams(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams (2, 3 and 4, with a space at both ends) of the words at the given places, and the
    index in `at` of each."""
    length = words.end[at] - words.start[at] + 2
    ends = np.cumsum(length)
    begin = ends - length
    owner = np.repeat(np.arange(len(at)), length)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - begin[owner]
    inner = (place > 0) & (place < length[owner] - 1)
    text = np.full(len(owner), 0x20, np.uint64)
    text[inner] = words.data[(words.start[at][owner] + place - 1)[inner]]
    buckets, owners = [], []
    code = text
    for n in (2, 3, 4):
        code = code[:-1] << np.uint64(8) | text[n - 1 :]
        inside = place[: len(code)] + n <= length[owner[: len(code)]]
        buckets.append((mix(code[inside] | np.uint64(n << 56)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner[: len(code)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct word, and the distinct word of each word."""
    _, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return at, which


class Model:
    """Log-probabilities of the (bucket, language) pairs that occur, and the languages [script, language] may be.

    A language's log-probability of a bucket is its `base` where the count is 0, and above that by the entry.
    """

    def __init__(self, languages: list[str], key: np.ndarray, n: np.ndarray) -> None:
        """key: bucket (then BUCKETS + script) times the number of languages, plus the language; n: its count."""
        self.languages = languages
        order = np.argsort(key)
        row, label = np.divmod(key[order], len(languages))
        n = n[order]
        gram = row < BUCKETS
        total = np.bincount(label[gram], n[gram], len(languages))
        self.base = np.log(0.5) - np.log(total + 0.5 * BUCKETS)
        self.first = np.searchsorted(row[gram], np.arange(BUCKETS + 1))
        self.label = label[gram].astype(np.int32)
        self.above = (np.log(n[gram] + 0.5) - np.log(0.5)).astype(np.float32)
        self.dense = None
        if len(languages) <= FULL_SLICES:  # the same sums, faster
            self.dense = np.zeros((BUCKETS, len(languages)), np.float32)
            self.dense[row[gram], self.label] = self.above
        scripts = np.zeros((SCRIPTS, len(languages)))
        scripts[row[~gram] - BUCKETS, label[~gram]] = n[~gram]
        share = scripts / np.maximum(1, scripts.sum(0, keepdims=True))
        self.allowed = share >= SCRIPT_SHARE
        self.allowed[~self.allowed.any(1)] = True

    def word_scores(self, words: Words) -> np.ndarray:
        at, which = _distinct(words)
        buckets, owner = word_ngrams(words, at)
        k = len(self.languages)
        scores = np.bincount(owner, minlength=len(at))[:, None] * self.base
        if self.dense is not None:
            scores += np.stack([np.bincount(owner, self.dense[buckets, j], len(at)) for j in range(k)], 1)
            buckets = buckets[:0]
        many = self.first[buckets + 1] - self.first[buckets]
        done = np.cumsum(many)
        low = 0
        while low < len(buckets):
            high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + ENTRIES + scores.size, "right")))
            count = many[low:high]
            entry = np.repeat(self.first[buckets[low:high]] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            scores += np.bincount(np.repeat(owner[low:high], count) * k + self.label[entry], self.above[entry], scores.size).reshape(scores.shape)
            low = high
        scores -= scores.max(1, keepdims=True)  # of a word's scores only the differences matter
        return np.where(self.allowed[scripts_of(words, at)], scores, FORBIDDEN).astype(np.float32)[which]


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word; text i has the words first[i]:first[i+1]. All texts advance together."""
    words, labels = scores.shape
    kind = np.min_scalar_type(max(0, labels - 1))
    length = np.diff(first)
    by_length = np.argsort(-length, kind="stable")
    longest = int(length[by_length[0]]) if len(length) else 0
    active = np.searchsorted(-length[by_length], -np.arange(1, longest + 1), "right")
    begin = first[:-1][by_length]
    back = np.empty(scores.shape, kind)
    best = np.empty((len(length), labels), np.float32)
    own = np.arange(labels, dtype=kind)
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        if t:
            before = best[:n]
            top = before.argmax(1)
            change = before[np.arange(n), top][:, None] - switch
            stays = before >= change
            back[at] = np.where(stays, own, top[:, None])
            best[:n] = np.where(stays, before, change) + scores[at]
        else:
            best[:n] = scores[at]
        best[:n] -= best[:n].max(1, keepdims=True)  # sums stay small, so that long texts lose no digits
    out = np.empty(words, kind)
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        out[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return out


def learn(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """From text and lang of the rows whose id's remainder is not the held-out one."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder("doc_id", folds) != held_out))
    found = rows.groupBy("lang").count().collect()
    if not found:
        return None
    languages = sorted(r["lang"] for r in found)
    parts = docs.sparkSession.createDataFrame([(r["lang"], min(1_000_000, round(1e6 * sample_docs / r["count"]))) for r in found], "lang string, _part long")
    sample = rows.join(F.broadcast(parts), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < F.col("_part")).select("doc_id", "text", "lang")
    index = {k: i for i, k in enumerate(languages)}

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(part.column("text"), True, _OTHER)
        own = np.array([index[x] for x in part.column("lang").to_pylist()], np.int64)[words.text]
        at, which = _distinct(words)
        pair, times = np.unique(which * len(languages) + own, return_counts=True)
        word, label = np.divmod(pair, len(languages))
        buckets, owner = word_ngrams(words, at[word])
        script = BUCKETS + scripts_of(words, at[word])
        key, inverse = np.unique(np.concatenate([buckets * len(languages) + label[owner], script * len(languages) + label]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([times[owner], times])).astype(np.int64)
        return pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    counts = map_slices(sample, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = np.fromiter(((r["key"], r["n"]) for r in counts.toLocalIterator()), np.dtype((np.int64, 2)))
    return Model(languages, pairs[:, 0], pairs[:, 1])


def label_spans(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans (first byte, end byte, language) of every row of docs (doc_id, text)."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        n = part.num_rows
        ids = part.column(0)
        names, scores, spans = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
        if model is not None:
            words = words_of(part.column(1), True, _OTHER)
            labels = viterbi(model.word_scores(words), words.first, switch)
            size = words.end - words.start
            k = len(model.languages)
            mass = np.bincount(words.text * k + labels, size, n * k).reshape(n, k)
            top = mass.argmax(1)
            change = np.ones(len(labels), bool)
            change[1:] = (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1])
            begin = np.flatnonzero(change)
            last = np.append(begin[1:], len(labels)) - 1
            for a, b in zip(begin, last, strict=True):
                t = words.text[a]
                spans[t].append({"first": int(words.start[a] - words.base[t]), "end": int(words.end[b] - words.base[t]), "lang": model.languages[labels[a]]})
            for i, text in enumerate(text_of(part.column(1)).to_pylist()):
                if mass[i, top[i]] > 0 and _LETTER.search(text):
                    names[i], scores[i] = model.languages[top[i]], mass[i, top[i]] / mass[i].sum()
                else:
                    spans[i] = []
        held = np_id_remainder(ids.to_pylist(), FOLDS) == HELD_OUT
        return pa.record_batch([ids, pa.array(held), pa.array(names), pa.array(scores), pa.array(spans, kind)], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, schema, most=max(1, STEPPED_BYTES * FULL_SLICES // max(FULL_SLICES, len(model.languages) if model else 0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label_spans(docs, learn(docs))
