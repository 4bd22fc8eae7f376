"""Queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from lodeweave.llm import chat, decontaminate, html_text, language, line_frequency, mixing, repair, sharding, simhash, toxicity, vector_codes
from lodeweave.llm.dart_minhash import op7_dart_minhash
from lodeweave.llm.substring_dedup import op1_substring_dedup

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat": chat.op2_chat,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language": language.op4_language,
    "op5_line_frequency": line_frequency.op5_line_frequency,
    "op6_html_text": html_text.op6_html_text,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_mixing": mixing.op8_mixing,
    "op10_hilbert_sharding": sharding.op10_hilbert_sharding,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op11_simhash": simhash.op11_simhash,
    "op12_structure_repair": repair.op12_structure_repair,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op2_chat": chat.ORACLE,
    "op5_line_frequency": line_frequency.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op12_structure_repair": repair.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
