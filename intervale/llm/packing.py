"""Hierarchical multi-length packing of tokenised documents into training sequences.

Documents are cut into full windows of the longest tier; what is left is routed to the smallest tier that holds it.
Tiers are packed from the longest down: a window takes one long rest, its gap is filled with the largest rests of
shorter tiers that fit, then by cutting one more. Where too little is left to fill a window, the rest itself is cut
at a power of two, which needs no padding. Sequences of a block are dealt to step groups of near-equal token counts.

A block is a run of consecutive rows of a task with at most BLOCK_TOKENS tokens (or one document), so memory is
bounded and nothing is shuffled; sequence ids hold the partition's number in their high bits. Rows are never
dropped: a null or empty text is one token, the end token 0. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text_batches, slices, table, text_of

LONGEST = 1024
SHORTEST_TIER = 128
BLOCK_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
END_ID = 0
#: Whitespace runs from this length on are left to `tokenizers`: the pattern's look-ahead steps back through them on the stack.
LONG_RUN = 10_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: The pre-tokeniser's pattern (a fixed value), its alternatives in an order that matches the same pieces faster.
PIECES = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids, for a byte-level BPE file of the `tokenizers` library whose ids are in merge order.

    The file's vocabulary is run by `tiktoken`, which gives the same ids several times faster. Strings of special
    tokens are ordinary text here, and whitespace runs of LONG_RUN and more are too long for its stack: document_encoder()
    has both.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


@lru_cache(maxsize=2)
def document_encoder(path: str) -> Callable[[str], list[int]]:
    """text -> the ids that `tokenizers` gives with its default settings and no special tokens added around the text.

    Texts are split at the file's added tokens, whose ids are emitted; where these have options that reach into the text
    around them, the whole text is left to `tokenizers`. So is a part with a whitespace run of LONG_RUN.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    library = Tokenizer.from_file(path)
    ordinary = encoder(path)
    ids = {x["content"]: x["id"] for x in added}
    plain = not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    token = re.compile("|".join(re.escape(x) for x in sorted(ids, key=len, reverse=True)) or r"(?!)")
    long_run = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")

    def whole(text: str) -> list[int]:
        return library.encode(text, add_special_tokens=False).ids

    def part(text: str) -> list[int]:
        return whole(text) if len(text) >= LONG_RUN and long_run.search(text) else ordinary(text)

    def encode(text: str) -> list[int]:
        if not token.search(text):
            return part(text)
        if not plain:
            return whole(text)
        out, at = [], 0
        for x in token.finditer(text):
            out += part(text[at : x.start()])
            out.append(ids[x.group()])
            at = x.end()
        return out + part(text[at:])

    return encode


class _Rests:
    """Rests of documents by length; the largest that fits is found by a bit mask of the lengths in stock."""

    def __init__(self, most: int) -> None:
        self.stock: list[list[tuple[int, int]]] = [[] for _ in range(most)]
        self.mask = 0
        self.tokens = 0

    def put(self, length: int, item: tuple[int, int]) -> None:
        self.stock[length].append(item)
        self.mask |= 1 << length
        self.tokens += length

    def largest(self, at_most: int) -> int:
        return (self.mask & ((1 << (at_most + 1)) - 1)).bit_length() - 1

    def take(self, length: int) -> tuple[int, int]:
        item = self.stock[length].pop()
        if not self.stock[length]:
            self.mask ^= 1 << length
        self.tokens -= length
        return item


def pack(lengths: list[int], longest: int = LONGEST, shortest_tier: int = SHORTEST_TIER) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document's index, start, length). Every token of every document is in exactly one."""
    done: list[list[tuple[int, int, int]]] = []
    rests = _Rests(longest)
    for doc, n in enumerate(lengths):
        full = n - n % longest
        done.extend([(doc, at, longest)] for at in range(0, full, longest))
        if n > full:
            rests.put(n - full, (doc, full))
    while rests.mask:
        length = rests.largest(longest)
        doc, start = rests.take(length)
        tier = max(shortest_tier, 1 << (length - 1).bit_length())
        gap = tier - length
        if gap > rests.tokens:  # nothing is left that could fill the window
            even = 1 << (length.bit_length() - 1)
            done.append([(doc, start, even)])
            if length > even:
                rests.put(length - even, (doc, start + even))
            continue
        window = [(doc, start, length)]
        while gap:
            fits = rests.largest(gap)
            if fits > 0:
                window.append((*rests.take(fits), fits))
                gap -= fits
            else:  # the shortest one in stock is longer than the gap: cut it
                short = (rests.mask & -rests.mask).bit_length() - 1
                doc, start = rests.take(short)
                window.append((doc, start, gap))
                rests.put(short - gap, (doc, start + gap))
                gap = 0
        done.append(window)
    return done


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each sequence: longest first, each to the group with the fewest tokens."""
    groups = max(1, round(sum(sizes) / step_tokens))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        load, g = heap[0]
        out[k] = g
        heapq.heapreplace(heap, (load + sizes[k], g))
    return out


def _rows(docs: list[tuple[int | None, np.ndarray]], first: int, block: int, longest: int) -> pa.RecordBatch:
    sequences = pack([len(ids) for _, ids in docs], longest)
    sizes = [sum(x[2] for x in s) for s in sequences]
    groups = step_groups(sizes)
    out: list[tuple] = []
    for k, sequence in enumerate(sequences):
        offset = 0
        for doc, start, length in sequence:
            key, ids = docs[doc]
            out.append((key, start, length, zlib.crc32(ids[start : start + length]), len(ids), first + k, offset, sizes[k], block | groups[k]))
            offset += length
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(x, pa.int32() if n == "tier" else pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)], names=names)


def pack_documents(df: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents (columns doc_id, text), one row each, as SCHEMA says. No shuffle."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_encoder(path)
        high = TaskContext.get().partitionId() << 40
        docs: list = []
        held = sequences = blocks = 0

        def block() -> pa.RecordBatch:
            nonlocal docs, held, sequences, blocks
            rows = _rows(docs, high + sequences, high | blocks << 20, longest)
            sequences = rows.column(5)[-1].as_py() - high + 1
            docs, held, blocks = [], 0, blocks + 1
            return rows

        for batch in batches:
            for part in slices(batch):
                for key, text in zip(part.column(0).to_pylist(), text_of(part.column(1)).to_pylist(), strict=True):
                    ids = np.array([*encode(text), END_ID], "<u4")
                    if docs and held + len(ids) > block_tokens:
                        yield block()
                    docs.append((key, ids))
                    held += len(ids)
        if docs:
            yield block()

    by_text_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
