"""Benchmark decontamination: word-pair seeds join training passages to test items, Smith-Waterman scores them.

Words are compared lower-cased (A-Z) with ASCII punctuation as space. Test items are read in blocks of at most
BLOCK_BYTES of text, the bound of what is broadcast; a larger benchmark takes more passes. A seed is a pair of words
next to each other, or with one word between, in the item and in the text. With m matches and e errors an alignment
scores 2 m - e; at threshold t of an item of n words e <= 2 m - 2 t n, so at most m - t n of its m - 1 steps from match to
match hold two errors or more, and t n - 1 steps or more are seeds, all within (3 - 2 t) n words. Where so many seeds
lie so close, the text is aligned with the item, word by word: no passage that reaches the threshold is missed.

Defined results: null or empty texts and items without words match nothing; an item of fewer than SEED_WORDS words has
its whole word sequence as its seed; repeated rows give repeated results; null ids are carried; other columns are kept
by clean() and left out by find().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import by_text_batches, map_slices, slices, table
from .words import mix, ngrams, words_of

#: Items of fewer words have one seed, the whole sequence.
SEED_WORDS = 4
#: Hits of seeds that are looked at together (or those of one text), which bounds memory.
HITS = 1 << 21
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of the best possible alignment score.
THRESHOLD = 0.4
FILTER_BITS = 20
_PAIR = np.uint64(0xA4093822299F31D0)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def pairs_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of words at a distance of 1 or 2 inside texts, and the position of the first word of each."""
    left = np.repeat(first[1:], np.diff(first))
    values, places = [], []
    for step in (1, 2):
        at = np.flatnonzero(np.arange(len(hashes)) + step < left)
        values.append(mix(hashes[at] * _PAIR + hashes[at + step]))
        places.append(at)
    return np.concatenate(values), np.concatenate(places)


class Items:
    """A block of test items: their word hashes, and sorted seeds with the items and places where they occur."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        self.ids = ids
        words = words_of(pa.array(texts, pa.large_string()), True, _PUNCTUATION)
        hashes = words.hashes()
        self.words = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        seeds, item, place, size = [], [], [], []
        count = np.diff(words.first)
        for n in range(1, SEED_WORDS):
            grams, at = ngrams(hashes, words.first, n)
            whole = count[words.text[at]] == n if len(at) else np.zeros(0, bool)
            seeds.append(grams[whole])
            place.append(at[whole])
            size.append(np.full(int(whole.sum()), n))
        grams, at = pairs_of(hashes, words.first)
        long = count[words.text[at]] >= SEED_WORDS if len(at) else np.zeros(0, bool)
        seeds.append(grams[long])
        place.append(at[long])
        size.append(np.zeros(int(long.sum()), np.int64))
        for at in place:
            item.append(words.text[at] if len(at) else at)
        place = [at - words.first[own] if len(at) else at for at, own in zip(place, item, strict=True)]
        self._set(*(np.concatenate(x) for x in (seeds, item, place, size)))

    def _set(self, seed: np.ndarray, item: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place, self.size = seed[order], item[order], place[order], size[order]
        self.sizes = sorted(set(self.size.tolist()))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def occurrences(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in self.seed (the first of equal ones) and words of the texts where seeds begin."""
        places, at = [], []
        for n in self.sizes:
            grams, begin = ngrams(hashes, first, n) if n else pairs_of(hashes, first)
            near = np.flatnonzero(self.filter[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            k = np.searchsorted(self.seed, grams[near])
            k[k == len(self.seed)] = 0
            hit = (self.seed[k] == grams[near]) & (self.size[k] == n) if len(self.seed) else np.zeros(len(near), bool)
            places.append(k[hit])
            at.append(begin[near[hit]])
        return (np.concatenate(places), np.concatenate(at)) if places else (np.empty(0, np.int64),) * 2


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local score, and the number of the passage's words up to its end. One vector step for each item word."""
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.empty_like(row)
        new[0] = 0
        np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _regions(items: Items, seed: np.ndarray, at: np.ndarray, text: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, begin, end) of the words where an item has enough seeds close together; text, at: of each hit."""
    many = np.searchsorted(items.seed, items.seed[seed], "right") - seed
    each = np.repeat(np.arange(len(seed)), many)
    entry = seed[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    text, item, at = text[each], items.item[entry], at[each]
    length = np.array([len(w) for w in items.words], np.int64)
    need = np.maximum(1, np.ceil(threshold * length - 1 - 1e-9).astype(np.int64))
    need[length < SEED_WORDS] = 1
    span = np.maximum(length, np.ceil((3 - 2 * threshold) * length).astype(np.int64))
    enough = np.bincount(item, minlength=len(length)) >= need
    order = np.flatnonzero(enough[item])
    order = order[np.lexsort((at[order], item[order], text[order]))]
    text, item, at = text[order], item[order], at[order]
    last = np.arange(len(order)) + need[item] - 1
    begins = np.flatnonzero(last < len(order))
    ends = last[begins]
    close = (text[ends] == text[begins]) & (item[ends] == item[begins]) & (at[ends] - at[begins] <= span[item[begins]])
    begins, ends = begins[close], ends[close]
    k = 0
    while k < len(begins):
        t, i = int(text[begins[k]]), int(item[begins[k]])
        begin, end = int(at[ends[k]] - span[i]), int(at[begins[k]] + span[i] + 1)
        k += 1
        while k < len(begins) and text[begins[k]] == t and item[begins[k]] == i and at[ends[k]] - span[i] <= end:
            end = int(at[begins[k]] + span[i] + 1)
            k += 1
        yield t, i, begin, end


def _alignments(target: np.ndarray, hashes: np.ndarray, begin: int, end: int, least: float) -> Iterator[tuple[int, int, int]]:
    """(score, first word, end word) of the best alignment in hashes[begin:end], then of those left and right of it."""
    todo = [(begin, end)]
    while todo:
        begin, end = todo.pop()
        if MATCH * (end - begin) < least:
            continue
        score, stop = smith_waterman(target, hashes[begin:end])
        if score < least or not score:
            continue
        _, back = smith_waterman(target[::-1], hashes[begin : begin + stop][::-1])
        first, stop = begin + stop - back, begin + stop
        yield score, first, stop
        todo += [(begin, first), (stop, end)]


def _matches(part: pa.RecordBatch, items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item's index, score, first byte, end byte) of the passages in a slice's texts that reach the threshold."""
    words = words_of(part.column("text"), True, _PUNCTUATION)
    hashes = words.hashes()
    seed, at = items.occurrences(hashes, words.first)
    if not len(seed):
        return []
    order = np.argsort(at, kind="stable")
    seed, at = seed[order], at[order]
    text = words.text[at]
    hits = np.cumsum(np.searchsorted(items.seed, items.seed[seed], "right") - seed)
    found = []
    low = 0
    while low < len(seed):
        high = int(np.searchsorted(hits, (hits[low - 1] if low else 0) + HITS, "right"))
        if high < len(seed):  # a text's hits stay together
            high = int(np.searchsorted(text, text[high]))
            high = high if high > low else int(np.searchsorted(text, text[low], "right"))
        for t, i, begin, end in _regions(items, seed[low:high], at[low:high], text[low:high], threshold):
            target = items.words[i]
            best = MATCH * len(target)
            for score, first, stop in _alignments(target, hashes, max(int(words.first[t]), begin), min(int(words.first[t + 1]), end), threshold * best):
                found.append((t, i, score / best, int(words.start[first] - words.base[t]), int(words.end[stop - 1] - words.base[t])))
        low = high
    return found


def _id_type(benchmark: DataFrame) -> str:
    """Whole numbers are carried as such, item ids of other types as text."""
    return "long" if isinstance(benchmark.schema["item_id"].dataType, IntegralType) else "string"


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast(_id_type(benchmark)).alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len((row["text"] or "").encode())
        if ids and size + n > BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield Items(ids, texts)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each passage of a document that copies a test item: doc_id, item_id, score, start_byte, end_byte."""
    schema = f"doc_id long, item_id {_id_type(benchmark)}, score double, start_byte long, end_byte long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64() if _id_type(benchmark) == "long" else pa.string(), pa.float64(), pa.int64(), pa.int64()]
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def work(part: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            items = shared.value
            found = [(part.column(0)[t].as_py(), items.ids[i], s, a, b) for t, i, s, a, b in _matches(part, items, threshold)]
            return pa.record_batch([pa.array(x, k) for k, x in zip(kinds, zip(*found, strict=True), strict=True)], names=names) if found else None

        part = map_slices(rows, work, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no passage of a test item."""
    spark = docs.sparkSession
    by_text_batches(spark)
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[t for t, *_ in _matches(part, shared.value, threshold)]] = False
                    if keep.any():
                        yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
