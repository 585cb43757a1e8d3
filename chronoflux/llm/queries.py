"""Registered queries of this package and their SQL."""

from __future__ import annotations

from . import ann, bwt, flatgraph, knn, lm, mixing, packing, pii, quality, simhash, substring, trie, variants

QUERIES = {
    "op6_quality": quality.op6_quality,
    "op1_mixing": mixing.op1_mixing,
    "op2_pii": pii.op2_pii,
    "op7_exact_top_k": knn.op7_exact_top_k,
    "op10_approximate_neighbours": ann.op10_approximate_neighbours,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op9_suffix_array": bwt.op9_suffix_array,
    "op4_lm_scoring": lm.op4_lm_scoring,
    "op3_simhash": simhash.op3_simhash,
    "op8_packing": packing.op8_packing,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_embedding_near_duplicates": flatgraph.op12_embedding_near_duplicates,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op1_mixing": mixing.ORACLE, "op11_spelling_variants": variants.ORACLE, "op12_embedding_near_duplicates": flatgraph.ORACLE, "op13_prefix_trie": trie.ORACLE}
