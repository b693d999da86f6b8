"""The corpus queries, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from framesift.llm import chat, decontam, langid, licenses, linededup, merkle, mixing, multihash, partcodes, simhash, substring, tokenbin, toxicity


def queries():
    return {
        "op1_mix_sources": mixing.query,
        "op2_license_scan": licenses.query,
        "op3_language_id": langid.query,
        "op4_substring_dedup": substring.query,
        "op5_chat_format": chat.query,
        "op6_simhash": simhash.query,
        "op7_token_shards": tokenbin.query,
        "op8_multiset_fingerprints": multihash.query,
        "op9_decontaminate": decontam.query,
        "op10_site_lines": linededup.query,
        "op11_merkle_manifest": merkle.query,
        "op12_part_codes": partcodes.query,
        "op13_toxic_passages": toxicity.query,
    }


def oracle_sql():
    return {
        "op1_mix_sources": mixing.ORACLE,
        "op4_substring_dedup": substring.ORACLE,
        "op5_chat_format": chat.ORACLE,
        "op9_decontaminate": decontam.ORACLE,
        "op10_site_lines": linededup.ORACLE,
        "op11_merkle_manifest": merkle.ORACLE,
        "op12_part_codes": partcodes.ORACLE,
    }
