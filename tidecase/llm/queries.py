"""The operators as named queries over the test tables, with checking SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidecase.llm.jaccard import jaccard_join
from tidecase.llm.language import word_backoff
from tidecase.llm.merkle import SQL as MERKLE_SQL
from tidecase.llm.merkle import merkle_manifest
from tidecase.llm.mixture import SQL as MIXTURE_SQL
from tidecase.llm.mixture import hierarchical_budget
from tidecase.llm.packing import best_fit_packing
from tidecase.llm.piece_counts import piece_counts
from tidecase.llm.placement import SQL as PLACEMENT_SQL
from tidecase.llm.placement import permutation_table
from tidecase.llm.quality import empirical_bayes
from tidecase.llm.quantized_search import rotated_codes
from tidecase.llm.sketch import bottom_k
from tidecase.llm.token_file import token_file
from tidecase.llm.toxicity import conditional_field
from tidecase.llm.turn_repair import repaired_conversations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_empirical_bayes_quality": empirical_bayes,
    "op2_grouping_genetic_packing": best_fit_packing,
    "op3_rotated_bit_codes": rotated_codes,
    "op4_permutation_table": permutation_table,
    "op5_word_first_backoff": word_backoff,
    "op6_conditional_field": conditional_field,
    "op7_bottom_k_sketch": bottom_k,
    "op8_hierarchical_budget": hierarchical_budget,
    "op9_context_range_coder": token_file,
    "op10_adaptive_prefix_join": jaccard_join,
    "op11_generalised_lr_repair": repaired_conversations,
    "op12_pretoken_counts": piece_counts,
    "op13_midstate_manifest": merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op4_permutation_table": PLACEMENT_SQL,
    "op8_hierarchical_budget": MIXTURE_SQL,
    "op13_midstate_manifest": MERKLE_SQL,
}
