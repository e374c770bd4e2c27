"""The queries of this subpackage by name, and the SQL that checks some of them."""

from __future__ import annotations

from jambwork.llm import fertility, fingerprints, jaccard, katz, mixing, packing, pieces, search, spelling, suffixes, toolcalls, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_fertility": fertility.op4_fertility,
    "op5_katz": katz.op5_katz,
    "op6_warc": warc.op6_warc,
    "op7_tool_calls": toolcalls.op7_tool_calls,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_lexical_search": search.op12_lexical_search,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}

ORACLE_SQL = {
    "op3_jaccard_join": jaccard.ORACLE,
    "op7_tool_calls": toolcalls.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op12_lexical_search": search.ORACLE,
}
