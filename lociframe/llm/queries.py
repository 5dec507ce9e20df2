"""Registered corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import fim, fingerprints, html, lm, minhash, mixing, packing, pii, quality, substrings, toxicity, variants, wordvec

QUERIES = {
    "op1_compact_windows": substrings.query,
    "op2_hyperminhash": minhash.query,
    "op3_scaled_fingerprints": fingerprints.query,
    "op4_crf_pii": pii.query,
    "op5_host_quality": quality.query,
    "op6_dom_content": html.query,
    "op7_pack_windows": packing.query,
    "op8_toxicity": toxicity.query,
    "op9_target_mixing": mixing.query,
    "op10_interpolated_lm": lm.query,
    "op11_bit_sliced_variants": variants.query,
    "op12_fill_in_middle": fim.query,
    "op13_random_indexing_quality": wordvec.query,
}

ORACLE_SQL = {
    "op2_hyperminhash": minhash.ORACLE_SQL,
    "op5_host_quality": quality.ORACLE_SQL,
    "op12_fill_in_middle": fim.ORACLE_SQL,
}
