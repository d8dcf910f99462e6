"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from sitetide.llm import (
    bpe,
    decontamination,
    embeddings,
    filter_audit,
    fm_index,
    multiset_hash,
    oracles,
    pii,
    sharding,
    simhash,
    suffix_levels,
    token_output,
    toxicity,
    whitening,
)


def queries() -> dict:
    return {
        "op1_fm_index": fm_index.op1_fm_index,
        "op2_orc_tokens": token_output.op2_orc_tokens,
        "op3_anchor_expansion": pii.op3_anchor_expansion,
        "op4_suffix_levels": suffix_levels.op4_suffix_levels,
        "op5_word_table_bpe": bpe.op5_word_table_bpe,
        "op6_aho_corasick": decontamination.op6_aho_corasick,
        "op7_simhash_variants": simhash.op7_simhash_variants,
        "op8_string_kernel": toxicity.op8_string_kernel,
        "op9_virtual_slots": sharding.op9_virtual_slots,
        "op10_kmeans_cells": embeddings.op10_kmeans_cells,
        "op11_multiset_hash": multiset_hash.op11_multiset_hash,
        "op12_whitening": whitening.op12_whitening,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict:
    return {"op1_fm_index": oracles.OP1, "op6_aho_corasick": oracles.OP6, "op10_kmeans_cells": oracles.OP10, "op13_filter_audit": oracles.OP13}
