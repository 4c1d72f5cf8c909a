"""Registered queries of the training-data operators, one per operator."""

from __future__ import annotations

from vigil.llm import binary_ids, conversations, decontaminate, divergence, licenses, neardup, packing, pii, quality, sharding, simhash, suffix, warc

QUERIES = {f.__name__: f for f in [
    pii.op1_disclosure, decontaminate.op2_spaced_seeds, sharding.op3_virtual_slots, binary_ids.op4_dictionary_frames,
    suffix.op5_difference_cover, quality.op6_boosted_rules, licenses.op7_winnowed_licenses, neardup.op8_odd_sketches, packing.op9_large_item_matching, warc.op10_warc_revisits, divergence.op11_divergence, simhash.op12_pigeonhole_simhash, conversations.op13_grammar_repair]}
#: SQL has no CRC-32, BPE, SHA-1 over archives, trees, sketches or XXH64, so the others are tested against brute force (tests/llm).
ORACLES: dict[str, str] = {"op11_divergence": divergence.ORACLE}
