"""The queries of this subpackage, and the SQL that some can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard, language, lines, media, packing, quality, sharding, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality.query,
        "op2_url_filters": urls.query,
        "op3_line_dedup": lines.query,
        "op4_sharding": sharding.query,
        "op5_language_id": language.query,
        "op6_packing": packing.query,
        "op7_toxicity": toxicity.query,
        "op8_jaccard_join": jaccard.query,
        "op9_decontamination": decontamination.query,
        "op10_media_columns": media.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": urls.oracle(), "op3_line_dedup": lines.ORACLE, "op8_jaccard_join": jaccard.ORACLE}
