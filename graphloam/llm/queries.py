"""The subpackage's queries, by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: name -> module that defines the function of that name and, in ORACLES, its SQL
_MODULES = {
    "op9_vector_dedup": "vector_dedup",
    "op6_jaccard_join": "jaccard_join",
    "op10_substring_dedup": "substring_dedup",
    "op1_language_id": "language_id",
    "op2_token_counts": "token_counts",
    "op3_license_scan": "license_scan",
    "op4_quality": "quality",
    "op5_decontamination": "decontaminate",
    "op7_sentencepiece": "sentencepiece_codec",
    "op8_sharding": "sharding",
    "op11_token_align": "token_align",
    "op12_fill_in_middle": "fill_in_middle",
    "op13_suffix_dedup": "suffix_dedup",
}


def queries() -> dict:
    return {name: getattr(import_module(f"graphloam.llm.{module}"), name) for name, module in _MODULES.items()}


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, module in _MODULES.items():
        sql = getattr(import_module(f"graphloam.llm.{module}"), "ORACLES", {})
        out |= {k: v for k, v in sql.items() if k == name}
    return out
