"""Membership filters of a bounded number of bits, built by aggregation: no false negatives, a bounded broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text_batches
from .words import mix


def bits_for(keys: DataFrame, most: int = 28) -> int:
    """log2 of the bits that let few other keys pass: 64 to 128 for each key, at most 2**most (32 MB by default). Beyond
    that more other keys pass, which costs time and loses nothing."""
    return min(most, max(16, keys.count().bit_length() + 6))


def filter_of(keys: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits as int64 words, of the first column (long) of keys; nulls are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(mix(batch.column(0).drop_null().to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.record_batch([pa.array(place >> 6), pa.array((np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    by_text_batches(keys.sparkSession)
    out = np.zeros(1 << (bits - 6), np.int64)
    rows = keys.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bit").to_numpy()
    return out


def might_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key (int64) whether the filter may hold it."""
    bits = (len(words) * 64).bit_length() - 1
    place = (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    return (words[place >> 6] >> (place & 63)) & 1 == 1
