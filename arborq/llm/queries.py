"""Query registry of the training-data operators: name -> function of (spark, sf_dir), and SQL where it can express one."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language, line_dedup, media, packing, pylm, quality, session_closing, simhash, spencode, toxicity, vector_codes

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_quality": quality.op2_quality,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language_id": language.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_media": media.op6_media,
    "op7_lm_scoring": pylm.op7_lm_scoring,
    "op8_sentencepiece": spencode.op8_sentencepiece,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_benchmark_decontamination": decontaminate.op11_benchmark_decontamination,
    "op12_session_closing": session_closing.op12_session_closing,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {"op1_exact_dedup": exact_dedup.OP1_SQL}
