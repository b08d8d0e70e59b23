"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe_codec, bpe_count, decontaminate, langid, media, neardup, passages, quality, shard, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_shard_bytes": shard.query,
    "op3_bpe_codec": bpe_codec.query,
    "op4_language": langid.query,
    "op5_token_counts": bpe_count.query,
    "op6_near_duplicates": neardup.query,
    "op7_passages": passages.query,
    "op8_lossless_webp": media.query,
    "op9_toxicity": toxicity.query,
    "op10_quality": quality.query,
}

#: The others rest on checksums, tokenizers or fitted models, which SQL lacks; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": decontaminate.ORACLE_SQL, "op6_near_duplicates": neardup.ORACLE_SQL}
