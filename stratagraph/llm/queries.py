"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chunk_dedup, exact_dedup, mixing, near_dedup, pii, pitman_yor, quality, scaled_sketch, token_files


def queries() -> dict:
    return {
        "op1_pitman_yor": pitman_yor.op1_pitman_yor,
        "op2_chunk_dedup": chunk_dedup.op2_chunk_dedup,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_quality": quality.op4_quality,
        "op5_token_files": token_files.op5_token_files,
        "op6_scaled_sketch": scaled_sketch.op6_scaled_sketch,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_bpe": bpe.op8_bpe,
        "op9_pii": pii.op9_pii,
        "op10_fair_mix": mixing.op10_fair_mix,
    }


def oracle_sql() -> dict:
    return {"op7_exact_dedup": exact_dedup.SQL}
