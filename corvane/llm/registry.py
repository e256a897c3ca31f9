"""The registered queries of this package and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, decontamination, hard_negatives, langid, language_model, mixing, piece_codec, quality_rules, sharding, simhash, token_counts, toxicity, transport_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_sharding": sharding.query,
    "op3_langid": langid.query,
    "op4_quality_rules": quality_rules.query,
    "op5_piece_codec": piece_codec.query,
    "op6_simhash": simhash.query,
    "op7_language_model": language_model.query,
    "op8_token_counts": token_counts.query,
    "op9_transport_stream": transport_stream.query,
    "op10_mixing": mixing.query,
    "op11_conversation_trie": conversation_trie.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_decontamination": decontamination.query,
}

SQL: dict[str, str] = {
    "op2_sharding": sharding.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op10_mixing": mixing.SQL,
    "op11_conversation_trie": conversation_trie.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_decontamination": decontamination.SQL,
}
