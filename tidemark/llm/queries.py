"""The registered queries of the training-data operators."""

from __future__ import annotations

from tidemark.llm import blocks, chroma, decontaminate, hashtree, langid, pieces, ppm, simhash, toxicity, trainorder

QUERIES = {
    "op1_block_lstm": blocks.op1,
    "op2_max_plus_pieces": pieces.op2,
    "op3_chroma": chroma.op3,
    "op4_ppm_score": ppm.op4,
    "op5_hash_tree": hashtree.op5,
    "op6_training_order": trainorder.op6,
    "op7_simhash": simhash.op7,
    "op8_wu_manber": decontaminate.op8,
    "op9_deobfuscated_toxicity": toxicity.op9,
    "op10_marginal_unigrams": langid.op10,
}
ORACLE_SQL: dict[str, str] = {"op8_wu_manber": decontaminate.SQL}
