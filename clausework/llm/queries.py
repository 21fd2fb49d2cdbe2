"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausework.llm import decontaminate, fill_middle, license_scan, line_dedup, ngram_join, packing, quality_rules, ranked_search, substring_dedup, token_counts, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.query,
    "op2_token_counts": token_counts.query,
    "op3_toxicity": toxicity.query,
    "op4_decontaminate": decontaminate.query,
    "op5_warc": warc.query,
    "op6_ngram_join": ngram_join.query,
    "op7_line_dedup": line_dedup.query,
    "op8_license_scan": license_scan.query,
    "op9_quality_rules": quality_rules.query,
    "op10_packing": packing.query,
    "op11_fill_middle": fill_middle.query,
    "op12_substring_dedup": substring_dedup.query,
    "op13_ranked_search": ranked_search.query,
}
SQL: dict[str, str] = {"op1_url_filter": url_filter.SQL, "op4_decontaminate": decontaminate.SQL, "op5_warc": warc.SQL, "op6_ngram_join": ngram_join.SQL, "op9_quality_rules": quality_rules.SQL, "op11_fill_middle": fill_middle.SQL, "op12_substring_dedup": substring_dedup.SQL, "op13_ranked_search": ranked_search.SQL}
