"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import bpe, decontaminate, minhash, pages, quality, sharding, substrings, suffix_tree, suffixes, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_sharding": sharding.query,
    "op3_pages": pages.query,
    "op4_suffixes": suffixes.query,
    "op5_bpe": bpe.query,
    "op6_minhash": minhash.query,
    "op7_substrings": substrings.query,
    "op8_decontaminate": decontaminate.query,
    "op9_suffix_tree": suffix_tree.query,
    "op10_quality_rules": quality.query,
}
SQL = {
    "op3_pages": pages.SQL,
    "op4_suffixes": suffixes.SQL,
    "op6_minhash": minhash.SQL,
    "op7_substrings": substrings.SQL,
    "op10_quality_rules": quality.SQL,
}
