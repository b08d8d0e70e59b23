"""Token counts by heap-and-linked-list byte-pair merging.

A text is split at the vocabulary's special strings (one token each) and then by the vocabulary's pattern. Each piece
starts as a list of byte symbols; a heap holds the adjacent pairs that have a merge, by (rank, position), and the
lowest is merged until none is left. The count is the initial symbols minus the merges; no ids are made. Pieces repeat,
so a worker remembers the counts of short pieces it has seen (a bounded memory that changes no result).

Defined results: null and empty texts have 0 bytes and 0 tokens; rows with equal ids are counted one by one; very long texts are
counted whole, and a piece without a break takes memory in proportion to it; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import small_batches

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: Fixed value: the pattern of byte-level vocabularies that splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MEMORY_PIECES, _MEMORY_CHARS = 600_000, 40


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class PairRanks:
    """The merges of a byte-level vocabulary file as ranks of symbol pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        symbols = byte_symbols()
        ids = d["model"]["vocab"]
        self.of_byte = [ids[symbols[b]] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(d["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[ids[a], ids[b]] = (rank, ids[a + b])
        self.special = [t["content"] for t in d["added_tokens"]]

    def count(self, piece: bytes) -> int:
        """Symbols left of a piece after all merges."""
        sym = [self.of_byte[b] for b in piece]
        n = len(sym)
        if n < 2:
            return n
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            if r := ranks.get((sym[i], sym[i + 1])):
                heap.append((r[0], i, sym[i], sym[i + 1], r[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        nxt, prv, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            merges += 1
            sym[i], sym[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if r := ranks.get((new, sym[k])):
                    heapq.heappush(heap, (r[0], i, new, sym[k], r[1]))
            if (h := prv[i]) >= 0 and (r := ranks.get((sym[h], new))):
                heapq.heappush(heap, (r[0], h, sym[h], new, r[1]))
        return n - merges


class Counter:
    """Counts whole texts; remembers short pieces."""

    def __init__(self, path: str):
        import regex

        self.pairs, self.seen = PairRanks(path), {}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in self.pairs.special)) if self.pairs.special else None

    def __call__(self, text: str) -> int:
        if any(s in text for s in self.pairs.special):
            parts = [p for p in self.cut.split(text) if p is not None]
            special = set(self.pairs.special)
            return sum(1 if p in special else self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        pieces = self.find(text)
        seen = self.seen
        for p in {*pieces}.difference(seen):
            if len(p) <= _MEMORY_CHARS:
                seen[p] = self.pairs.count(p.encode())
        try:
            return sum(map(seen.__getitem__, pieces))
        except KeyError:
            return sum(seen[p] if p in seen else self.pairs.count(p.encode()) for p in pieces)
        finally:
            if len(seen) > _MEMORY_PIECES:
                seen.clear()


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. ``vocabulary`` is a file that every executor has."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias(doc_id), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = vocabulary or public_tokenizers.path(VOCABULARY)
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        count = _COUNTERS[path]
        for b in batches:
            n_bytes, n_tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(1)):
                if t := t.as_py():
                    n_bytes[i], n_tokens[i] = len(t.encode()), count(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=[doc_id, "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"`{doc_id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: tokens of every whole text of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
