"""The corpus queries by name, and SQL for those that it can express."""

from __future__ import annotations

from tidemark.llm import bpe, exact_dedup, langid, mixing, quality, simhash, suffixes, topk, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_warc": warc.op2_warc,
    "op3_simhash": simhash.op3_simhash,
    "op4_repeats": suffixes.op4_repeats,
    "op5_bpe": bpe.op5_bpe,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_topk": topk.op8_topk,
    "op9_quality": quality.op9_quality,
    "op10_language_id": langid.op10_language_id,
}
ORACLES = {
    "op2_warc": warc.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_topk": topk.ORACLE_SQL,
}
