"""The queries of the corpus operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import embedding_dedup, html_extract, language_id, mixing, near_dedup, sentencepiece_bpe, sharding, substring_dedup, token_alignment, token_files, topk_search, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_sharding": sharding.op4_sharding,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_html_extract": html_extract.op6_html_extract,
        "op7_sentencepiece": sentencepiece_bpe.op7_sentencepiece,
        "op8_topk_search": topk_search.op8_topk_search,
        "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
        "op10_token_files": token_files.op10_token_files,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_whitening": whitening.op12_whitening,
        "op13_url_filter": url_filter.op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_near_dedup": near_dedup.ORACLE,
        "op8_topk_search": topk_search.ORACLE,
        "op9_embedding_dedup": embedding_dedup.ORACLE,
        "op13_url_filter": url_filter.ORACLE,
    }
