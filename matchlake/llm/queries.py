"""The queries of the corpus operators, and the SQL that gives the same rows."""

from __future__ import annotations

from . import alignment, ann, conversations, fingerprints, html, language, minhash, mixing, packing, quality, rollup, suffixes, warc

QUERIES = {
    "op1_token_counts": rollup.op1,
    "op2_quality": quality.op2,
    "op3_main_text": html.op3,
    "op4_fingerprints": fingerprints.op4,
    "op5_near_duplicates": minhash.op5,
    "op6_nearest": ann.op6,
    "op7_language": language.op7,
    "op8_mix_sources": mixing.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_warc": warc.op10,
    "op11_conversation_repair": conversations.op11,
    "op12_suffix_dedup": suffixes.op12,
    "op13_token_alignment": alignment.op13,
}

ORACLES = {
    "op8_mix_sources": mixing.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
}
