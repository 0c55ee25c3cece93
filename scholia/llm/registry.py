"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholia.llm.binary import op9_token_binary
from scholia.llm.decontamination import op5_benchmark_decontamination
from scholia.llm.language import op7_language_id
from scholia.llm.packing import op4_packing
from scholia.llm.search import SQL as SEARCH_SQL
from scholia.llm.search import op8_exact_top_k
from scholia.llm.sharding import op10_rendezvous_sharding
from scholia.llm.simhash import op6_simhash_near_dedup
from scholia.llm.substring import SQL as SUBSTRING_SQL
from scholia.llm.substring import op2_substring_dedup
from scholia.llm.toxicity import op3_toxicity
from scholia.llm.urls import op1_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_filter,
        op2_substring_dedup,
        op3_toxicity,
        op4_packing,
        op5_benchmark_decontamination,
        op6_simhash_near_dedup,
        op7_language_id,
        op8_exact_top_k,
        op9_token_binary,
        op10_rendezvous_sharding,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SUBSTRING_SQL, "op8_exact_top_k": SEARCH_SQL}
