"""Queries of the training-data operators: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fertility, grammar_ids, jaccard_join, langid, license_scan, packing, preferences, prefix_trie, sharding, substring_dedup, token_align, warc

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_tokenizer_fertility": (fertility.op1, None),
    "op2_license_scan": (license_scan.op2, license_scan.SQL),
    "op3_substring_dedup": (substring_dedup.op3, substring_dedup.SQL),
    "op4_language_id": (langid.op4, None),
    "op5_best_fit_packing": (packing.op5, None),
    "op6_decontamination": (decontaminate.op6, decontaminate.SQL),
    "op7_salvage_warc": (warc.op7, warc.SQL),
    "op8_sharding": (sharding.op8, None),
    "op9_preferences": (preferences.op9, preferences.SQL),
    "op10_jaccard_join": (jaccard_join.op10, jaccard_join.SQL),
    "op11_token_align": (token_align.op11, None),
    "op12_prefix_trie": (prefix_trie.op12, prefix_trie.SQL),
    "op13_grammar_ids": (grammar_ids.op13, None),
}
