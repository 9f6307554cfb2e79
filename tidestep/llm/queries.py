"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from tidestep.llm import exact_dedup, mixing, packing, quality, repeats, simhash, token_counts, token_files, topk, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_topk": topk.op2_topk,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_token_files": token_files.op7_token_files,
    "op8_repeats": repeats.op8_repeats,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op2_topk": topk.ORACLE_SQL,
    "op3_mixing": mixing.ORACLE_SQL,
    "op8_repeats": repeats.ORACLE_SQL,
}
