"""Batch text kernels: words, word hashes and shingles of whole Arrow string columns at once.

Everything works on the UTF-8 bytes of a batch, laid end to end, so a batch costs a few numpy passes rather than a
Python call for each word. Hashes are 64 bits; operators that must be exact confirm what hashes propose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles; a longer document makes a pass of its own.
SLICE_BYTES = 1 << 19
_U = np.uint64
_POW_LEN = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POW = _powers(0x9E3779B97F4A7C15 | 1, _POW_LEN)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U))

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of the decontamination contract: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Words of the near-duplicate contract: everything but ASCII white space.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes laid end to end, n + 1 offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    if data is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, dtype=np.uint8)[lo:hi], offsets - lo


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a batch: byte spans in ``data`` (lower-cased), 64-bit hashes, and the word range of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, mask: np.ndarray = ALNUM):
        self.data = LOWER[data]
        m = mask[self.data]
        n = len(m)
        prev, nxt = np.empty(n, bool), np.empty(n, bool)
        if n:
            prev[0], prev[1:] = False, m[:-1]
            nxt[-1], nxt[:-1] = False, m[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            prev[inner] = False
            nxt[inner - 1] = False
        self.starts = np.flatnonzero(m & ~prev)
        self.ends = np.flatnonzero(m & ~nxt) + 1
        self.lens = self.ends - self.starts
        self.first = np.searchsorted(self.starts, offsets)  # n_docs + 1 word positions
        self.hashes = self._hash(m)

    def _hash(self, m: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        at = np.flatnonzero(m)
        begin = np.cumsum(self.lens) - self.lens
        pos = at - np.repeat(self.starts, self.lens)
        vals = _BYTE[self.data[at]]
        if int(self.lens.max()) > _POW_LEN:
            vals = vals * _POW[pos & (_POW_LEN - 1)] * ((pos >> 16) * 2 + 1).astype(_U)
        else:
            vals = vals * _POW[pos]
        return mix(np.add.reduceat(vals, begin) ^ (self.lens.astype(_U) << _U(48)))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def phrase(self, lo: int, hi: int) -> bytes:
        """Words lo to hi - 1 with one space between them; no word holds a space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist()))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash at each word position, valid): a position is valid if k words of its document start there."""
        n = len(self.hashes)
        out = np.zeros(n, _U)
        valid = np.zeros(n, bool)
        if n >= k:
            acc = np.zeros(n - k + 1, _U)
            for j in range(k):
                acc = acc * _U(0xD6E8FEB86659FD93) + self.hashes[j : n - k + 1 + j]
            out[: n - k + 1] = mix(acc ^ _U(k))
            last = np.repeat(self.first[1:], self.counts)
            valid = np.arange(n) + k <= last
        return out, valid


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; a document of fewer than k words, but not none, has one shingle."""
    counts = words.counts
    hashes, valid = words.shingles(k)
    out: list[np.ndarray] = []
    first = words.first.tolist()
    for d, n in enumerate(counts.tolist()):
        lo = first[d]
        if n >= k:
            out.append(np.unique(hashes[lo : lo + n - k + 1]))
        elif n:
            acc = np.zeros(1, _U)
            for j in range(n):
                acc = acc * _U(0xD6E8FEB86659FD93) + words.hashes[lo + j : lo + j + 1]
            out.append(mix(acc ^ _U(n)))
        else:
            out.append(np.zeros(0, _U))
    return out
