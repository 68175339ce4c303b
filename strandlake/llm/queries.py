"""The training-data operators as registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, licences, line_dedup, near_dedup, pack, pii, quality, repetition, syncmers, token_counts, token_files, whitening


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_decontamination": decontaminate.op1, "op2_quality_classifier": quality.op2, "op3_syncmer_fingerprints": syncmers.op3, "op4_license_scan": licences.op4,
        "op5_mixture_packing": pack.op5, "op6_token_files": token_files.op6, "op7_line_dedup": line_dedup.op7, "op8_minhash_dedup": near_dedup.op8,
        "op9_token_counts": token_counts.op9, "op10_pii": pii.op10,
        "op11_quality_rules": repetition.op11, "op12_embedding_whitening": whitening.op12, "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.ORACLE, "op4_license_scan": licences.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op8_minhash_dedup": near_dedup.ORACLE, "op11_quality_rules": repetition.ORACLE}
