"""Configuration as nested dicts: defaults, a file, overrides."""

from __future__ import annotations

import json
from pathlib import Path

from ..operators.retrieve import Rerank


def deep_merge(base: dict, override: dict | None) -> dict:
    """``override`` over ``base``: dicts merge key by key at every depth, all else is replaced. Neither argument changes."""
    both = lambda k: isinstance(base.get(k), dict) and isinstance((override or {})[k], dict)
    return base | {k: deep_merge(base[k], v) if both(k) else v for k, v in (override or {}).items()}


DEFAULT = {
    "enabled": True, "rerank_top_n": 24, "final_top_k": 8, "use_mmr": True, "table_aware": True, "mmr_lambda": 0.72,
    "weights": {"vector": 0.44, "bm25": 0.26, "lexical": 0.16, "title_path": 0.14}, "bonuses": {"multi_source": 0.08, "table_chunk": 0.12},
}


def rerank_config(path: str | None = None, override: dict | None = None) -> tuple[Rerank, dict]:
    """(weights and depths, the whole configuration) of the defaults, a JSON file and overrides, in this order."""
    said = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    c = deep_merge(deep_merge(DEFAULT, said), override)
    w, b = c["weights"], c["bonuses"]
    table = b["table_chunk"] if c["table_aware"] else 0.0
    made = Rerank(vector=w["vector"], bm25=w["bm25"], lexical=w["lexical"], title=w["title_path"], multi_source=b["multi_source"], table=table, mmr_lambda=c["mmr_lambda"], rerank_top=c["rerank_top_n"], top=c["final_top_k"])
    return made, c
