"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling (gear) hash over 32 bytes cuts each text where its content says so, hence texts that share a passage share
its chunks whatever surrounds them. Chunks that occur more than once are found by one pass over chunk hashes; those that
save the most bytes, up to ``dictionary_bytes`` of text (a proven bound for the broadcast), are encoded once, and every
occurrence takes its ids from there. Other chunks are encoded where they occur; the ids are the same either way.

Chunks may end inside a word, so joins are repaired: the part that is re-encoded grows from the join to the left and the
right until both ends meet white space inside the neighbouring chunks. This vocabulary drops white space before it
splits, so at such a place any two encodings agree exactly; if a chunk holds no white space it is re-encoded whole and
the window goes on into the next. Between white space, a worker remembers the ids of words it has seen.

Defined results: null and empty texts have no ids and decode to the empty string; rows of equal id are encoded one by one; very
long texts are encoded whole, chunk by chunk; other columns are not read.
"""

from __future__ import annotations

import os
from array import array
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K
from .store import small_batches

VOCABULARY = "word_bpe_49k.json"
#: Chunks end about every LEAST + 2**BITS bytes, after LEAST and before MOST.
LEAST, MOST, BITS = 128, 4096, 9
DICTIONARY_BYTES = 16 << 20
_GEAR = (K.mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SPACE = ~K.NONSPACE
_MEMORY_WORDS = 150_000


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, the document's end included; all at character boundaries."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        shifted = h[:-s] << np.uint32(s)
        h[s:] += shifted
    cuts = np.flatnonzero(h < np.uint32(1 << (32 - BITS))) + 1
    part = np.searchsorted(cuts, offsets).tolist()
    cuts, ends = cuts.tolist(), []
    for d, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        out, last = [], lo
        for c in [*cuts[part[d] : part[d + 1]], hi]:
            while c - last > MOST:
                last = _whole(data, last + MOST, hi)
                out.append(last)
            if c - last >= LEAST and c < hi:
                last = _whole(data, c, hi)
                if last < hi:
                    out.append(last)
        if hi > lo and (not out or out[-1] < hi):
            out.append(hi)
        ends.append(out)
    return ends


def _whole(data: np.ndarray, at: int, hi: int) -> int:
    while at < hi and data[at] & 0xC0 == 0x80:
        at += 1
    return at


class Codec:
    """Ids (little-endian unsigned 32-bit) of pieces of text, and the text of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        ids = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        if self.tok.decoder is not None or ids(" \n\t\r\x0b\x0c") or ids("a b\nc") != ids("a") + ids("b") + ids("c"):
            raise ValueError("chunks are joined at white space, so the vocabulary must drop it and decode by words")
        names = self.tok.get_vocab(with_added_tokens=True)
        self.names = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name.encode()
        self.ids: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def learn(self, pieces: list[bytes]) -> None:
        """Makes the words of these pieces known. Words not seen for a generation are forgotten."""
        if len(self.ids) > _MEMORY_WORDS:
            self.ids, self.before = {}, self.ids
        new: set[bytes] = set()
        for p in pieces:
            new.update(p.split())
        new.difference_update(self.ids)
        old = new.intersection(self.before)
        for w in old:
            self.ids[w] = self.before[w]
        words = list(new - old)
        for w, e in zip(words, self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            self.ids[w] = array("I", e.ids).tobytes()

    def piece(self, p: bytes) -> bytes:
        """The ids of a piece whose words are known."""
        return b"".join(map(self.ids.__getitem__, p.split()))

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.names.__getitem__, array("I", ids)))


_CODECS: dict[str, Codec] = {}


def _codec(path: str | None) -> Codec:
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _inner(data: np.ndarray, ends: list[list[int]], offsets: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """(start, first white space, after the last white space, end) of the chunks of each document; without white space the middle two are the end."""
    spaces = np.flatnonzero(_SPACE[data])
    flat = np.array([e for x in ends for e in x], np.int64)
    counts = np.array([len(x) for x in ends])
    starts = np.empty_like(flat)
    if len(flat):
        starts[1:] = flat[:-1]
        firsts = np.cumsum(counts) - counts
        has = counts > 0
        starts[firsts[has]] = offsets[:-1][has]
    lo, hi = np.searchsorted(spaces, starts), np.searchsorted(spaces, flat)
    none = lo == hi
    if len(spaces):
        a = np.where(none, flat, spaces[np.minimum(lo, len(spaces) - 1)])
        z = np.where(none, flat, spaces[np.maximum(hi - 1, 0)] + 1)
    else:
        a = z = flat
    rows = list(zip(starts.tolist(), a.tolist(), z.tolist(), flat.tolist()))
    at = 0
    for n in counts.tolist():
        yield rows[at : at + n]
        at += n


def _hash(chunk: bytes) -> int:
    return int.from_bytes(blake2b(chunk, digest_size=8).digest(), "little", signed=True)


def shared_chunks(rows: DataFrame, dictionary_bytes: int) -> dict[int, int]:
    """Hashes of the repeated chunks that save most bytes, at most ``dictionary_bytes`` of text in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen: Counter = Counter()
            size: dict[int, int] = {}
            for b in K.slices(whole, "text"):
                data, offsets = K.text_bytes(b.column(0))
                raw = data.tobytes()
                for d, ends in enumerate(chunk_ends(data, offsets)):
                    last = int(offsets[d])
                    for e in ends:
                        h = _hash(raw[last:e])
                        seen[h] += 1
                        size[h] = e - last
                        last = e
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64()), pa.array([size[h] for h in seen], pa.int64())], names=["h", "n", "size"])

    counts = rows.select("text").mapInArrow(run, "h long, n long, size long").groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    most = max(1, dictionary_bytes // (LEAST * 4))
    best = counts.where("n > 1").orderBy(((F.col("n") - 1) * F.col("size")).desc(), "h").limit(most).collect()
    out, total = {}, 0
    for r in best:
        if (total := total + r["size"]) > dictionary_bytes:
            break
        out[r.h] = r.n
    return out


def dictionary(rows: DataFrame, hashes: dict[int, int], vocabulary: str | None) -> dict[bytes, tuple[bytes, bytes, bytes]]:
    """chunk -> (head, ids of the middle, tail), each encoded once, on the executors."""
    if not hashes:
        return {}
    known = rows.sparkSession.sparkContext.broadcast(set(hashes))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(known.value)
        for whole in batches:
            for b in K.slices(whole, "text"):
                if not left:
                    continue
                data, offsets = K.text_bytes(b.column(0))
                raw, found = data.tobytes(), []
                for d, ends in enumerate(chunk_ends(data, offsets)):
                    last = int(offsets[d])
                    for e in ends:
                        if (h := _hash(raw[last:e])) in left:
                            left.discard(h)
                            found.append((h, raw[last:e]))
                        last = e
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([c for _, c in found], pa.binary())], names=["h", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for b in batches:
            chunks = [c.as_py() for c in b.column(0)]
            data, offsets = np.frombuffer(b"".join(chunks), np.uint8), np.cumsum([0, *map(len, chunks)])
            spans = [x[0] for x in _inner(data, [[int(e)] for e in offsets[1:]], offsets)] if chunks else []
            raw = data.tobytes()
            codec.learn([raw[a:z] for _, a, z, _ in spans])
            done = [codec.piece(raw[a:z]) for _, a, z, _ in spans]
            cols = [chunks, [raw[s:a] for s, a, _, _ in spans], done, [raw[z:e] for _, _, z, e in spans]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in cols), pa.array([a < e for _, a, _, e in spans], pa.bool_())], names=["chunk", "head", "ids", "tail", "spaced"])

    chunks = rows.select("text").mapInArrow(texts, "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk")).select("chunk")
    made = chunks.mapInArrow(encode, "chunk binary, head binary, ids binary, tail binary, spaced boolean").collect()
    known.unpersist()
    return {bytes(r.chunk): (bytes(r["head"]), bytes(r.ids), bytes(r.tail)) for r in made if r.spaced}


def encode_decode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """One row per input row: id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded text, n_reused chunks."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(dictionary(rows, shared_chunks(rows, dictionary_bytes), vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = _codec(vocabulary), shared.value
        for whole in batches:
            for b in K.slices(whole, "text"):
                data, offsets = K.text_bytes(b.column(1))
                raw, docs, learn = data.tobytes(), [], []
                for spans in _inner(data, chunk_ends(data, offsets), offsets):
                    parts, glue, reused = [], b"", 0  # parts: pieces to encode, or what the dictionary has of them
                    for s, a, z, e in spans:
                        if hit := known.get(raw[s:e]):
                            join = glue + hit[0]
                            parts += (join, hit)
                            learn.append(join)
                            glue = hit[2]
                            reused += 1
                        elif a == e:
                            glue += raw[s:e]
                        else:
                            join, mid = glue + raw[s:a], raw[a:z]
                            parts += (join, mid)
                            learn += (join, mid)
                            glue = raw[z:e]
                    parts.append(glue)
                    learn.append(glue)
                    docs.append((parts, reused))
                codec.learn(learn)
                ids, texts = [], []
                for parts, _ in docs:
                    ids.append(b"".join([p[1] if isinstance(p, tuple) else codec.piece(p) for p in parts]))
                    texts.append(codec.decode(ids[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([len(x) >> 2 for x in ids], np.int64)), pa.array(ids, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([r for _, r in docs], pa.int32())], names=["id", "n_tokens", "ids", "decoded", "n_reused"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string, n_reused int")
    return out.withColumnRenamed("id", doc_id)


def digests(docs: DataFrame) -> DataFrame:
    """The result columns of op3 for a documents table."""
    return encode_decode(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: ids and decoded text of every whole text of ``documents``."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
