"""Queries work on every row and on whole texts: held against SQL on a larger table, or by count and length."""

import duckdb
import pytest
from test_queries import plain

from intervale.plans import catalog

DATA = "/root/testdata/sf0.01"
NAMES = ["flt9_quality_gate", "src9_parse_prometheus", "ag21_jn21_speaker_count_grid", "jn17_cache_lookup", "ag7_ag8_moving_average", "wn7_smooth_aba", "ag17_window_features", "ag19_risk_score", "snk2_srt_variants"]


@pytest.fixture(scope="module")
def large():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "events", "documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_every_row_is_worked_on(name, spark, large):
    assert plain(catalog.queries()[name](spark, DATA).toPandas()) == plain(large.sql(catalog.oracle_sql()[name]).df())


def test_no_query_cuts_its_input():
    for name, sql in catalog.oracle_sql().items():
        assert "substr(text, 1" not in sql and "event_id <" not in sql and "frame <" not in sql, name


def test_every_vector_has_a_cluster(spark):
    d = "/root/testdata/sf0.1"
    got = catalog.queries()["cl2_complete_linkage"](spark, d).collect()
    want = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null").select("vec_id").collect()
    assert sorted(r["seg_idx"] for r in got) == sorted(r["vec_id"] for r in want)


def test_edits_and_folds_see_whole_texts(spark):
    from pyspark.sql import functions as F

    from intervale.operators.evaluation import normalized
    from intervale.sources.substrate import derived

    text = {r["conv_id"] * 1000 + r["turn"]: r["text"] for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    rows = catalog.queries()["ag9_edit_stats"](spark, DATA).collect()
    assert len(rows) == len(text) and all(r["ref_chars"] == len(normalized(text[r["id"]])) for r in rows)
    longest = derived(spark, DATA, "segments").where("seg_idx % 12 in (0, 4, 8, 11)").agg(F.max(F.length("text"))).first()[0]
    for name in ("wn6_absorb_tiny", "wn8_short_guard", "wn16_role_smoothing", "jn2_wn20_merge_chunks_and_turns"):
        assert catalog.queries()[name](spark, DATA).agg(F.max(F.length("text"))).first()[0] >= min(longest, 91)
