"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import chat, divergence, mixing, packing, pii, quality, simhash, substrings, suffixes, topk, toxicity, warc, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op5_chat": chat.op5_chat,
    "op6_pii": pii.op6_pii,
    "op7_topk": topk.op7_topk,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_warc": warc.op9_warc,
    "op10_substrings": substrings.op10_substrings,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_whitening": whitening.op12_whitening,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op2_quality": quality.ORACLE,
    "op5_chat": chat.ORACLE,
    "op7_topk": topk.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_substrings": substrings.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
