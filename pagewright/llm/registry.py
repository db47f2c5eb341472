"""The corpus queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pagewright.llm import gif, line_dedup, mixing, near_dedup, oracle, packing, pii, quality, resampling, search, sharding, suffix_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
        "op2_gif_media": gif.op2_gif_media,
        "op3_sharding": sharding.op3_sharding,
        "op4_pii": pii.op4_pii,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_warc": warc.op12_warc,
        "op13_ranked_search": search.op13_ranked_search,
        "gif_timed_frames": gif.gif_timed_frames,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_queries()
