"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skysieve.llm import clusters, infill, language, lines, mixing, simhash, substrings, templates, tokencount, topk, toxicity, urls, warc
from skysieve.llm.common import table


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_template_decontamination": templates.op2,
        "op3_edit_token_counts": tokencount.op3,
        "op4_warc_archive": warc.op4,
        "op5_exact_top_k": topk.op5,
        "op6_line_dedup": lines.op6,
        "op7_url_filter": urls.op7,
        "op8_source_mixing": mixing.op8,
        "op9_simhash": op9,
        "op10_language": language.op10,
        "op11_substring_dedup": substrings.op11,
        "op12_fill_in_middle": infill.op12,
        "op13_centroids": clusters.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_archive": warc.ORACLE, "op5_exact_top_k": topk.ORACLE, "op6_line_dedup": lines.ORACLE, "op7_url_filter": urls.ORACLE, "op11_substring_dedup": substrings.ORACLE, "op12_fill_in_middle": infill.ORACLE, "op13_centroids": clusters.ORACLE}
