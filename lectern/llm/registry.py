"""The queries of this package and their DuckDB SQL, for the entry module."""

from __future__ import annotations

from lectern.llm import chat, language, mixing, multiset, periods, pieces, prefixtrie, private, quality, simhash, substrings, suffixes, tokenstore


def pipeline(spark, sf_dir: str):
    """All stages of the pipeline at the repository's top, which is only imported here."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_token_store": tokenstore.query,
        "op2_quality_rules": quality.query,
        "op3_language_mixture": language.query,
        "op4_private_spans": private.query,
        "op5_simhash_near_dedup": simhash.query,
        "op6_raking_mixture": mixing.query,
        "op7_chat_format": chat.query,
        "op8_sentencepiece_scan": pieces.query,
        "op9_substring_dedup": substrings.query,
        "op10_multiset_fingerprints": multiset.query,
        "op11_lyndon_runs": periods.query,
        "op12_suffix_dedup": suffixes.query,
        "op13_prefix_trie": prefixtrie.query,
    }


def oracle_sql() -> dict[str, str]:
    """The pipeline has none (its ORACLE_SQL is None)."""
    return {"op2_quality_rules": quality.ORACLE, "op7_chat_format": chat.ORACLE, "op9_substring_dedup": substrings.ORACLE, "op12_suffix_dedup": suffixes.ORACLE, "op13_prefix_trie": prefixtrie.ORACLE}
