"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from civicflow.llm import bpe, filter_audit, language_id, line_dedup, media, packing, quality, secrets, simhash, syncmers, token_files, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_quality": quality.op2_quality,
        "op3_media": media.op3_media,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_fingerprints": syncmers.op6_fingerprints,
        "op7_simhash": simhash.op7_simhash,
        "op8_bpe": bpe.op8_bpe,
        "op9_language_id": language_id.op9_language_id,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_token_files": token_files.op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.OP4_SQL, "op5_secret_scan": secrets.OP5_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL}
