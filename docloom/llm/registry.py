"""Queries of this subpackage: one ``opN_<name>`` per operator, each over its whole intended table."""

from __future__ import annotations

from docloom.functions.frames import prepared

from . import ann, bpe, chat, decontaminate, language, merkle, packing, records, sharding, simhash, substrings, toxicity, whitening

_ALL = {
    "op1_toxicity": toxicity,
    "op2_substring_dedup": substrings,
    "op3_token_records": records,
    "op4_byte_bpe": bpe,
    "op5_nearest_neighbours": ann,
    "op6_simhash": simhash,
    "op7_sharding": sharding,
    "op8_decontamination": decontaminate,
    "op9_chat_format": chat,
    "op10_language_id": language,
    "op11_whitening": whitening,
    "op12_merkle": merkle,
    "op13_packing": packing,
}


def _prepared(query):
    return lambda spark, sf_dir: query(prepared(spark), sf_dir)


def queries() -> dict:
    return {name: _prepared(module.query) for name, module in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _ALL.items() if getattr(module, "ORACLE_SQL", None)}
