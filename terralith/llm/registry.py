"""The queries of this subpackage and their SQL."""

from . import chat, decontaminate, language_id, lexical_search, packing, pii, quality_rules, simhash, structure_repair, substring_dedup, suffix_dedup, token_counts, warc

QUERIES = {
    "op10_quality_rules": quality_rules.op10,
    "op7_simhash": simhash.op7,
    "op2_decontaminate": decontaminate.op2,
    "op9_pii": pii.op9,
    "op5_packing": packing.op5,
    "op3_substring_dedup": substring_dedup.op3,
    "op8_suffix_dedup": suffix_dedup.op8,
    "op4_warc": warc.op4,
    "op6_token_counts": token_counts.op6,
    "op1_chat": chat.op1,
    "op11_lexical_search": lexical_search.op11,
    "op12_structure_repair": structure_repair.op12,
    "op13_language_id": language_id.op13,
}

ORACLES: dict[str, str] = {
    "op1_chat": chat.ORACLE,
    "op4_warc": warc.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
}
