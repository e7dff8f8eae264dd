"""The operators' queries over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from . import chat, decontaminate, fingerprints, language, line_dedup, mixing, near_dup, periodic, quality, repeated_windows, sharding, spelling, token_output

QUERIES = {
    "op1_mix_to_weights": mixing.op1_mix_to_weights,
    "op2_token_ids": token_output.op2_token_ids,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_chat_format": chat.op4_chat_format,
    "op5_quality_kneser_ney": quality.op5_quality_kneser_ney,
    "op6_language_id": language.op6_language_id,
    "op7_minhash_near_dup": near_dup.op7_minhash_near_dup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_shard_best_fit": sharding.op10_shard_best_fit,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_suffix_windows": repeated_windows.op13_suffix_windows,
}
ORACLE_SQL = {
    "op1_mix_to_weights": mixing.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op11_periodic_runs": periodic.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_suffix_windows": repeated_windows.OP13_SQL,
}
