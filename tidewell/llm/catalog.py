"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewell.llm import bayes, bpe, lines, minhash, pii, quality, secrets, sharding, suffix, winnow

QUERIES = {
    "op1_line_frequency": quality.op1_line_frequency,
    "op2_extendible_hashing": sharding.op2_extendible_hashing,
    "op3_anchor_expansion": pii.op3_anchor_expansion,
    "op4_hierarchical_bayes": bayes.op4_hierarchical_bayes,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_suffix_array": suffix.op6_suffix_array,
    "op7_secret_forest": secrets.op7_secret_forest,
    "op8_weighted_minhash": minhash.op8_weighted_minhash,
    "op9_segment_join": lines.op9_segment_join,
    "op10_winnowing": winnow.op10_winnowing,
}

ORACLES: dict[str, str] = {
    "op1_line_frequency": quality.OP1_SQL,
    "op2_extendible_hashing": sharding.OP2_SQL,
    "op10_winnowing": winnow.OP10_SQL,
}
