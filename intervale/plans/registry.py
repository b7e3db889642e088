"""Queries by name, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from ..sources.substrate import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS_SQL = """select file_id, w_seg * 1000 + k as word_idx, start_ms + cast(floor(k * (end_ms - start_ms) / n) as bigint) as w_start,
  start_ms + cast(floor((k + 1) * (end_ms - start_ms) / n) as bigint) + (k % 4) * 15 - 15 as w_end, word
from (select file_id, seg_idx as w_seg, start_ms, end_ms, len(string_split(text, ' ')) as n, unnest(string_split(text, ' ')) as word,
             unnest(range(len(string_split(text, ' ')))) as k from segments)"""


def with_tables(*names: str) -> str:
    """A WITH clause of derived tables, for the SQL side; `words` needs `segments` before it."""
    return "with recursive " + ", ".join(f"{n} as ({WORDS_SQL if n == 'words' else oracle(n)})" for n in names)


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add
