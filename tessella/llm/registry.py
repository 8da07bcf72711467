"""Named queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from tessella.llm import byte_bpe, exact_topk, language_id, near_dedup, neighbours, packing, pii, records, substring_dedup, toxicity


def queries() -> dict[str, Callable]:
    return {
        "op1_minhash_dedup": near_dedup.op1_minhash_dedup,
        "op2_exact_topk": exact_topk.op2_exact_topk,
        "op3_language_id": language_id.op3_language_id,
        "op4_pii": pii.op4_pii,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_token_records": records.op9_token_records,
        "op10_vantage_point_ann": neighbours.op10_vantage_point_ann,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": exact_topk.OP2_SQL}
