"""Lossless WebP (the public VP8L bitstream), both ways, in numpy.

``decode`` reads any lossless image: prefix codes (simple and normal), meta prefix codes, back-references, colour cache,
and the predictor, cross-colour, subtract-green and palette transforms, and gives the pixels as an array. ``encode``
writes images with any of these features; ``encode_bytes`` stores a payload of 8-bit samples in the green channel.

Where only green takes bits, as in stored payloads, the code length at every bit position comes from one table look-up
over the whole stream, and only the walk from symbol to symbol is sequential.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (x, y) of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MOST_SIDE = 1 << 14
_CACHE_MULTIPLIER = 0x1E35A7BD
_LIMIT = 12
#: Bytes of a stream that are looked up, and symbols that are written, at a time.
_SEGMENT = 1 << 16
_REVERSED: dict[int, np.ndarray] = {}


def _reversed(bits: int) -> np.ndarray:
    """Each number of ``bits`` bits with its bits reversed."""
    if bits not in _REVERSED:
        n = np.arange(1 << bits)
        out = np.zeros_like(n)
        for i in range(bits):
            out |= ((n >> i) & 1) << (bits - 1 - i)
        _REVERSED[bits] = out
    return _REVERSED[bits]


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


# ---------------------------------------------------------------- reading


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)


class Code:
    """A canonical prefix code as a table over the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.only = 0, int(used[0]) if len(used) else 0
            self.symbols = self.lengths = None
            return
        self.only = None
        order = used[np.argsort(lengths[used], kind="stable")]
        lens = lengths[order].astype(np.int64)
        self.bits = bits = int(lens[-1])
        span = 1 << (bits - lens)
        if int(span.sum()) != 1 << bits:
            raise ValueError("an incomplete or oversubscribed prefix code")
        back = _reversed(bits)
        self.symbols = np.repeat(order, span)[back]
        self.lengths = np.repeat(lens, span)[back].astype(np.uint8)

    def read(self, b: Bits) -> int:
        if self.only is not None:
            return self.only
        at = b.at
        v = (int.from_bytes(b.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & ((1 << self.bits) - 1)
        b.at = at + int(self.lengths[v])
        return int(self.symbols[v])


def _read_code(b: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.uint8)
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        first = b.read(8 if wide else 1)
        if not two:
            code = Code(lengths)
            code.only = first
            return code
        lengths[[first, b.read(8)]] = 1
        return Code(lengths)
    own = np.zeros(19, np.uint8)
    for i in range(4 + b.read(4)):
        own[LENGTH_ORDER[i]] = b.read(3)
    code, left = Code(own), alphabet
    if b.read(1):
        left = 2 + b.read(2 + 2 * b.read(3))
    out: list[int] = []
    last, table, sizes = 8, code.symbols.tolist() if code.only is None else None, code.lengths.tolist() if code.only is None else None
    mask, data, at = (1 << code.bits) - 1, b.data, b.at
    while len(out) < alphabet and left:
        left -= 1
        v = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        if table is None:
            s = code.only
        else:
            s = table[v & mask]
            n = sizes[v & mask]
            at, v = at + n, v >> n
        if s < 16:
            out.append(s)
            last = s or last
        elif s == 16:
            out += [last] * (3 + (v & 3))
            at += 2
        elif s == 17:
            out += [0] * (3 + (v & 7))
            at += 3
        else:
            out += [0] * (11 + (v & 127))
            at += 7
    b.at = at
    lengths[: len(out)] = out[:alphabet]
    return Code(lengths)


def _prefixed(b: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + b.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_image(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels of an entropy-coded image as height x width numbers, 8 bits each of alpha, red, green and blue."""
    cache_bits = b.read(4) if b.read(1) else 0
    groups, group_bits = None, 0
    if main and b.read(1):
        group_bits = b.read(3) + 2
        groups = (_read_image(b, _blocks(width, group_bits), _blocks(height, group_bits), False) >> 8) & 0xFFFF
    n_groups = int(groups.max()) + 1 if groups is not None else 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(b, n) for n in sizes] for _ in range(n_groups)]
    green, red, blue, alpha, dist = codes[0]
    if n_groups == 1 and not cache_bits and None not in (red.only, blue.only, alpha.only):
        flat = _read_green(b, green, dist, width, width * height)
        return ((alpha.only << 24 | red.only << 16 | blue.only) | flat.astype(np.uint32) << np.uint32(8)).astype(np.uint32).reshape(height, width)
    return _read_pixels(b, codes, groups, group_bits, cache_bits, width, height)


def _read_green(b: Bits, green: Code, dist: Code, width: int, total: int) -> np.ndarray:
    """Pixels of which only green takes bits."""
    out = np.empty(total, np.uint8)
    if green.only is not None and green.only < 256:
        out[:] = green.only
        return out
    bits, done = green.bits, 0
    stop = green.lengths.copy()
    stop[green.symbols >= 256] = 0
    while done < total:
        from_byte = b.at >> 3
        raw = np.frombuffer(b.data, np.uint8, min(_SEGMENT + 2, len(b.data) - from_byte), from_byte).astype(np.uint32)
        three = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        windows = ((three[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << bits) - 1)).astype(np.uint16).ravel()
        lens, limit = stop[windows].tobytes() + bytes(16), len(windows)
        p = start = b.at & 7
        while done < total and p < limit:
            mark, first = bytearray(limit - p), p
            for _ in range(total - done):
                n = lens[p]
                if not n:
                    break
                mark[p - first] = 1
                p += n
            at = np.flatnonzero(np.frombuffer(mark, np.uint8)) + first
            out[done : done + len(at)] = green.symbols[windows[at]]
            done += len(at)
            b.at = from_byte * 8 + p
            if done < total and p < limit:
                length = _prefixed(b, green.read(b) - 256)
                back = _distance(_prefixed(b, dist.read(b)), width)
                _copy(out, done, back, length)
                done += length
                p = b.at - from_byte * 8
        if p == start and done < total:
            raise ValueError("the stream ends before the image does")
    return out


def _copy(out: np.ndarray, at: int, back: int, length: int) -> None:
    if back > at or at + length > len(out):
        raise ValueError("a back-reference beyond the image")
    if back >= length:
        out[at : at + length] = out[at - back : at - back + length]
    else:
        out[at : at + length] = np.resize(out[at - back : at], length)


def _read_pixels(b: Bits, codes: list, groups: np.ndarray | None, group_bits: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    total, at = width * height, 0
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    known = 0  # pixels that the cache has seen
    blocks = groups.tolist() if groups is not None else None
    while at < total:
        group = codes[blocks[(at // width) >> group_bits][(at % width) >> group_bits] if blocks else 0]
        s = group[0].read(b)
        if s < 256:
            r, bl, a = group[1].read(b), group[2].read(b), group[3].read(b)
            out[at] = a << 24 | r << 16 | s << 8 | bl
            at += 1
        elif s < 280:
            length = _prefixed(b, s - 256)
            back = _distance(_prefixed(b, group[4].read(b)), width)
            if back > at or at + length > total:
                raise ValueError("a back-reference beyond the image")
            for _ in range(length):
                out[at] = out[at - back]
                at += 1
        else:
            while known < at:
                cache[(_CACHE_MULTIPLIER * out[known] & 0xFFFFFFFF) >> shift] = out[known]
                known += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32).reshape(height, width)


# ---------------------------------------------------------------- transforms


def channels(argb: np.ndarray) -> np.ndarray:
    """height x width x 4 bytes: alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)).astype(np.uint8) for s in (24, 16, 8, 0)], axis=-1)


def joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _mean(a, b):
    return (a + b) >> 1


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction (int) from the pixels to the left, above, above to the right and above to the left (int, 4 channels last)."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode <= 9:
        return _mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        nearer = np.abs(top - corner).sum(axis=-1) < np.abs(left - corner).sum(axis=-1)
        return np.where(nearer[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = _mean(left, top)
    d = mean - corner
    return np.clip(mean + np.where(d < 0, -(-d // 2), d // 2), 0, 255)


_ABOVE_ONLY = {0, 2, 3, 4, 8, 9}


def _unpredict(res: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels from residuals (bytes, 4 channels): rows top down, a block's run at once where the mode allows."""
    h, w, _ = res.shape
    out = np.zeros((h, w, 4), np.int64)
    res = res.astype(np.int64)
    res[0, 0, 0] += 255
    out[0] = np.cumsum(res[0], axis=0) & 255
    for y in range(1, h):
        row, above = out[y], out[y - 1]
        row[0] = (res[y, 0] + above[0]) & 255
        x = 1
        while x < w:
            end = min(w, ((x >> bits) + 1) << bits)
            mode = int(modes[y >> bits, x >> bits])
            if mode == 1:
                row[x:end] = (row[x - 1] + np.cumsum(res[y, x:end], axis=0)) & 255
            else:
                step = end - x if mode in _ABOVE_ONLY or mode > 13 else 1
                for i in range(x, end, step):
                    j = i + step
                    right = above[i + 1 : j + 1] if j < w else np.concatenate([above[i + 1 :], row[:1]])
                    row[i:j] = (res[y, i:j] + predict(mode, row[i - 1 : j - 1], above[i:j], right, above[i - 1 : j - 1])) & 255
            x = end
    return out.astype(np.uint8)


def _residuals(c: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w, _ = c.shape
    c = c.astype(np.int64)
    out = np.empty_like(c)
    out[0, 0] = c[0, 0] - [255, 0, 0, 0]
    out[0, 1:] = c[0, 1:] - c[0, :-1]
    for y in range(1, h):
        out[y, 0] = c[y, 0] - c[y - 1, 0]
        for x in range(1, w):
            right = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
            out[y, x] = c[y, x] - predict(int(modes[y >> bits, x >> bits]), c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])
    return (out & 255).astype(np.uint8)


def _cross(c: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away what red and blue owe to green, and blue to red, block by block."""
    h, w, _ = c.shape
    e = channels(elements)[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits].astype(np.int8).astype(np.int64)
    byte = lambda x: x.astype(np.uint8).astype(np.int8).astype(np.int64)
    delta = lambda t, x: (t * byte(x)) >> 5
    out = c.astype(np.int64)
    green = out[..., 2]
    red = (out[..., 1] + sign * delta(e[..., 3], green)) & 255
    blue = out[..., 3] + sign * delta(e[..., 2], green) + sign * delta(e[..., 1], red if sign > 0 else out[..., 1])
    out[..., 1], out[..., 3] = red, blue & 255
    return out.astype(np.uint8)


def _bundle_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def _unbundle(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    b = _bundle_bits(len(palette))
    index = (argb >> np.uint32(8)) & np.uint32(255)
    if b:
        size = 8 >> b
        index = ((index[..., None] >> (np.arange(1 << b, dtype=np.uint32) * np.uint32(size))) & np.uint32((1 << size) - 1)).reshape(len(index), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file as height x width x 4 bytes: alpha, red, green, blue."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    b = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("an unknown version")
    transforms, full = [], width
    while b.read(1):
        kind = b.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = b.read(3) + 2
            transforms.append((kind, bits, _read_image(b, _blocks(width, bits), _blocks(height, bits), False), width))
        elif kind == PALETTE:
            n = b.read(8) + 1
            table = channels(_read_image(b, n, 1, False))[0]
            transforms.append((kind, 0, joined(np.cumsum(table, axis=0, dtype=np.uint8)), width))
            width = _blocks(width, _bundle_bits(n))
        else:
            transforms.append((kind, 0, None, width))
    argb = _read_image(b, width, height, True)
    for kind, bits, extra, w in reversed(transforms):
        if kind == PREDICTOR:
            argb = joined(_unpredict(channels(argb), (extra >> np.uint32(8)) & np.uint32(15), bits))
        elif kind == CROSS_COLOUR:
            argb = joined(_cross(channels(argb), extra, bits, 1))
        elif kind == SUBTRACT_GREEN:
            c = channels(argb)
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
            argb = joined(c)
        else:
            argb = _unbundle(argb, extra, w)
    assert argb.shape == (height, full)
    return channels(argb)


# ---------------------------------------------------------------- writing


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def symbols(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Many values of up to 31 bits: summed into 32-bit words in which they do not overlap."""
        for i in range(0, len(values), _SEGMENT * 16):
            self._symbols(values[i : i + _SEGMENT * 16], sizes[i : i + _SEGMENT * 16])

    def _symbols(self, values: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes, dtype=np.int64) + self.n
        begin = ends - sizes
        v = values.astype(np.uint64) << (begin & 31).astype(np.uint64)
        word = begin >> 5
        base = self.n >> 5
        total = np.zeros((int(ends[-1]) >> 5) + 2 - base, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total[word[first] - base] = np.add.reduceat(v, first)
        low = (total & np.uint64(0xFFFFFFFF)).astype("<u4")
        low[1:] += (total[:-1] >> np.uint64(32)).astype("<u4")
        self.value |= int.from_bytes(low.tobytes(), "little") << (base << 5)
        self.n = int(ends[-1])

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def code_lengths(counts: np.ndarray, limit: int = _LIMIT) -> np.ndarray:
    """Lengths of a prefix code of at most ``limit`` bits; rare symbols count as more where they would be longer."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    least = 1
    while True:
        heap = [(max(least, c), i) for i, c in enumerate(counts[used].tolist())]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for node in range(len(used), 2 * len(used) - 1):
            a, i = heapq.heappop(heap)
            c, j = heap[0]
            heapq.heapreplace(heap, (a + c, node))
            parent[i] = parent[j] = node
        depth = [0] * len(parent)
        for i in range(len(parent) - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= limit:
            lengths[used] = depth[: len(used)]
            return lengths
        least *= 2


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bits reversed for a stream that starts at the lowest bit."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if not len(used):
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    lens = lengths[order]
    bits = int(lens[-1])
    starts = np.concatenate([[0], np.cumsum(1 << (bits - lens))[:-1]])
    out[order] = _reversed(bits)[starts] & ((1 << lens) - 1)
    return out


def _write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        w.put(wide, 1)
        w.put(symbols[0], 8 if wide else 1)
        if len(symbols) > 1:
            w.put(symbols[1], 8)
        return
    ops: list[tuple[int, int, int]] = []  # (symbol, extra, extra bits)
    seq, i = lengths.tolist(), 0
    while i < len(seq):
        v, j = seq[i], i
        while j < len(seq) and seq[j] == v:
            j += 1
        run = j - i
        i = j
        if v:
            ops.append((v, 0, 0))
            run -= 1
        while run:
            if v == 0 and run >= 11:
                n = min(run, 138)
                ops.append((18, n - 11, 7))
            elif v == 0 and run >= 3:
                n = min(run, 10)
                ops.append((17, n - 3, 3))
            elif v and run >= 3:
                n = min(run, 6)
                ops.append((16, n - 3, 2))
            else:
                n = 1
                ops.append((v, 0, 0))
            run -= n
    counts = np.bincount([o[0] for o in ops], minlength=19)
    own = code_lengths(counts, 7)
    words = code_words(own).tolist()
    kept = own.tolist()
    n = max(4, max(k for k, s in enumerate(LENGTH_ORDER) if kept[s]) + 1)
    w.put(0, 1)
    w.put(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        w.put(kept[s], 3)
    w.put(0, 1)
    single = sum(1 for x in kept if x) == 1
    for s, extra, bits in ops:
        if not single:
            w.put(words[s], kept[s])
        if bits:
            w.put(extra, bits)


def _prefix_of(v: int) -> tuple[int, int, int]:
    """(prefix code, extra bits, their number) of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def _tokens(flat: list[int], width: int, lz: bool, cache_bits: int) -> list[tuple]:
    """Literals (pixel,), back-references (length, distance) and cache look-ups ('c', index)."""
    out: list[tuple] = []
    cache: dict[int, int] = {}
    places: dict[tuple, int] = {}
    at, n, shift = 0, len(flat), 32 - cache_bits

    def saw(i: int) -> None:
        if cache_bits:
            cache[(_CACHE_MULTIPLIER * flat[i] & 0xFFFFFFFF) >> shift] = flat[i]
        if lz and i + 3 <= n:
            places[tuple(flat[i : i + 3])] = i

    while at < n:
        if lz and at + 3 <= n and (p := places.get(tuple(flat[at : at + 3]))) is not None:
            length = 3
            while at + length < n and length < 4096 and flat[p + length] == flat[at + length]:
                length += 1
            out.append((length, at - p))
        elif cache_bits and cache.get(k := (_CACHE_MULTIPLIER * flat[at] & 0xFFFFFFFF) >> shift) == flat[at]:
            out.append(("c", k))
            length = 1
        else:
            out.append((flat[at],))
            length = 1
        for i in range(at, at + length):
            saw(i)
        at += length
    return out


def _write_image(w: Writer, argb: np.ndarray, main: bool, lz: bool = False, cache_bits: int = 0, group_bits: int = 0) -> None:
    height, width = argb.shape
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = None
    if main:
        w.put(1 if group_bits else 0, 1)
        if group_bits:
            groups = np.add.outer(np.arange(_blocks(height, group_bits)), np.arange(_blocks(width, group_bits))) % 2
            w.put(group_bits - 2, 3)
            _write_image(w, groups.astype(np.uint32) << np.uint32(8), False)
    n_groups = 2 if groups is not None and groups.max() else 1
    near = {}
    for i, (x, y) in enumerate(NEAR):
        near.setdefault(max(1, x + y * width), i + 1)
    at, items = 0, []  # (group, [(code, symbol, extra, bits)])
    for t in _tokens(argb.ravel().tolist(), width, lz, cache_bits):
        g = int(groups[(at // width) >> group_bits, (at % width) >> group_bits]) if groups is not None else 0
        if t[0] == "c":
            items.append((g, [(0, 280 + t[1], 0, 0)]))
            at += 1
        elif len(t) == 1:
            p = t[0]
            items.append((g, [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]))
            at += 1
        else:
            length, extra, bits = _prefix_of(t[0])
            d, dx, db = _prefix_of(near.get(t[1], t[1] + 120))
            items.append((g, [(0, 256 + length, extra, bits), (4, d, dx, db)]))
            at += t[0]
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(n_groups)]
    for g, parts in items:
        for c, s, _, _ in parts:
            counts[g][c][s] += 1
    lengths = [[code_lengths(c, 15) for c in group] for group in counts]
    for group in lengths:
        for x in group:
            _write_code(w, x)
    words = [[code_words(x) for x in group] for group in lengths]
    single = [[np.count_nonzero(x) < 2 for x in group] for group in lengths]
    for g, parts in items:
        for c, s, extra, bits in parts:
            if not single[g][c]:
                w.put(int(words[g][c][s]), int(lengths[g][c][s]))
            if bits:
                w.put(extra, bits)


def _file(w: Writer) -> bytes:
    body = b"\x2f" + w.bytes()
    body += bytes(len(body) & 1)
    size = len(body)
    return b"RIFF" + (12 + size).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body


def _start(width: int, height: int, alpha: bool) -> Writer:
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
        raise ValueError(f"an image of {width} by {height}")
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(alpha), 1)
    w.put(0, 3)
    return w


def encode(pixels: np.ndarray, *, palette: bool = False, subtract_green: bool = False, cross: np.ndarray | None = None, modes: np.ndarray | None = None, bits: int = 2, lz: bool = False, cache_bits: int = 0, group_bits: int = 0) -> bytes:
    """A lossless WebP file of height x width x 4 bytes (alpha, red, green, blue), with the features asked for.

    ``modes`` (predictors) and ``cross`` (elements) have an entry for each block of 2**bits by 2**bits pixels.
    """
    height, width, _ = pixels.shape
    w, argb = _start(width, height, bool((pixels[..., 0] != 255).any())), joined(pixels)
    if palette:
        table, index = np.unique(argb, return_inverse=True)
        if len(table) > 256:
            raise ValueError("more than 256 colours")
        argb = _write_palette(w, table, index.reshape(height, width))
    if cross is not None:
        w.put(1, 1)
        w.put(CROSS_COLOUR, 2)
        w.put(bits - 2, 3)
        _write_image(w, cross.astype(np.uint32), False)
        argb = joined(_cross(channels(argb), cross.astype(np.uint32), bits, -1))
    if subtract_green:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        c = channels(argb)
        c[..., 1] -= c[..., 2]
        c[..., 3] -= c[..., 2]
        argb = joined(c)
    if modes is not None:
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(bits - 2, 3)
        _write_image(w, modes.astype(np.uint32) << np.uint32(8), False)
        argb = joined(_residuals(channels(argb), modes, bits))
    w.put(0, 1)
    _write_image(w, argb, True, lz, cache_bits, group_bits)
    return _file(w)


def _write_palette(w: Writer, table: np.ndarray, index: np.ndarray) -> np.ndarray:
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(table) - 1, 8)
    c = channels(table[None, :])
    c[0, 1:] -= c[0, :-1].copy()
    _write_image(w, joined(c), False)
    b = _bundle_bits(len(table))
    height, width = index.shape
    if b:
        size, wide = 8 >> b, _blocks(width, b)
        padded = np.zeros((height, wide << b), np.uint32)
        padded[:, :width] = index
        index = (padded.reshape(height, wide, 1 << b) << (np.arange(1 << b, dtype=np.uint32) * np.uint32(size))).sum(axis=2)
    return np.uint32(0xFF000000) | index.astype(np.uint32) << np.uint32(8)


LEAST_RUN = 16


#: Pixels of the largest image.
MOST_PIXELS = MOST_SIDE * MOST_SIDE


def encode_bytes(payload: np.ndarray, width: int = 64, most: int = MOST_PIXELS) -> bytes:
    """A payload as images one behind the other, each of at most ``most`` samples (one, but for very long payloads)."""
    return b"".join(_encode_part(payload[at : at + most], width) for at in range(0, max(1, len(payload)), most))


def _encode_part(payload: np.ndarray, width: int) -> bytes:
    """Samples as the green channel of opaque black pixels, ``width`` or a multiple in a row, the last row filled with zeros.

    Up to 16 distinct bytes become a palette, several to a pixel; runs of a byte become back-references; the rest are
    literals of one prefix code.
    """
    while len(payload) > width * MOST_SIDE:
        width *= 2
    height = max(1, -(-len(payload) // width))
    flat = payload
    if len(flat) < width * height:
        flat = np.zeros(width * height, np.uint8)
        flat[: len(payload)] = payload
    w = _start(width, height, False)
    counts = np.bincount(flat, minlength=256)
    if np.count_nonzero(counts) <= 16:
        table = np.flatnonzero(counts)
        rank = np.cumsum(counts > 0) - 1
        argb = _write_palette(w, (np.uint32(0xFF000000) | table.astype(np.uint32) << np.uint32(8)).astype(np.uint32), rank[flat].reshape(height, width))
        width = argb.shape[1]
        flat = ((argb >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).ravel()
    w.put(0, 3)  # no further transform, no colour cache, one group of codes
    change = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    edges = np.concatenate([[0], change, [len(flat)]])
    sizes = np.diff(edges)
    long = np.flatnonzero(sizes > LEAST_RUN)
    symbols = flat.astype(np.int64)
    extra = np.zeros(0, np.int64)
    if len(long):
        keep = np.ones(len(flat), bool)
        refs: list[tuple[int, int]] = []
        for at, n in zip((edges[long] + 1).tolist(), (sizes[long] - 1).tolist()):
            keep[at : at + n] = False
            while n:
                part = min(n, 4096)
                refs.append((at, part))
                at, n = at + part, n - part
        place = np.concatenate([np.flatnonzero(keep), [r[0] for r in refs]])
        order = np.argsort(place, kind="stable")
        prefixed = [_prefix_of(r[1]) for r in refs]
        symbols = np.concatenate([symbols[keep], [256 + p[0] for p in prefixed]])[order]
        zeros = np.zeros(int(keep.sum()), np.int64)
        extra = np.concatenate([zeros, [p[1] for p in prefixed]])[order]
        more = np.concatenate([zeros, [p[2] for p in prefixed]])[order]
    lengths = code_lengths(np.bincount(symbols, minlength=280))
    _write_code(w, lengths)
    for only in (0, 0, 255):
        one = np.zeros(256, np.int64)
        one[only] = 1
        _write_code(w, one)
    back = np.zeros(40, np.int64)
    back[_prefix_of(2)[0]] = 1  # one pixel back is the second short distance
    _write_code(w, back)
    if np.count_nonzero(lengths) > 1:
        values, widths = code_words(lengths)[symbols], lengths[symbols]
        if len(extra):
            values, widths = values | extra << widths, widths + more
        w.symbols(values, widths)
    elif len(extra):
        w.symbols(extra, more)
    return _file(w)


def decode_bytes(data: bytes, n: int, most: int = MOST_PIXELS) -> np.ndarray:
    """The first n samples of what ``encode_bytes`` stored."""
    parts, at = [], 0
    while at < len(data):
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        parts.append(np.ascontiguousarray(decode(data[at:end])[..., 2]).ravel()[:most])
        at = end
    return (parts[0] if len(parts) == 1 else np.concatenate(parts))[:n]
