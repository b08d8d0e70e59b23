import itertools
import os
import pathlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import webp as W


def image(rnd, h, w, colours):
    table = rnd.integers(0, 256, (colours, 4), dtype=np.uint8)
    x = np.minimum(np.add.outer(np.arange(h) // 3, np.arange(w) // 2) % colours, colours - 1)
    noise = rnd.integers(0, colours, (h, w))
    return table[np.where(rnd.random((h, w)) < 0.3, noise, x)]


@pytest.mark.parametrize("seed", range(6))
def test_every_feature_round_trips(seed):
    rnd = np.random.default_rng(seed)
    for (h, w), colours in itertools.product([(1, 1), (1, 9), (7, 1), (13, 17), (33, 20)], [1, 2, 4, 13, 200]):
        px = image(rnd, h, w, colours)
        bits = int(rnd.integers(2, 4))
        blocks = ((h + (1 << bits) - 1) >> bits, (w + (1 << bits) - 1) >> bits)
        for palette, lz, cache in itertools.product([False, True], [False, True], [0, 1, 7]):
            options = {}
            if not palette and rnd.random() < 0.7:
                options["modes"] = rnd.integers(0, 14, blocks)
            if not palette and rnd.random() < 0.7:
                options["cross"] = W.joined(rnd.integers(0, 256, (*blocks, 4), dtype=np.uint8))
            if rnd.random() < 0.5:
                options["subtract_green"] = not palette
            group_bits = int(rnd.integers(2, 4)) if rnd.random() < 0.5 else 0
            data = W.encode(px, palette=palette, lz=lz, cache_bits=cache, bits=bits, group_bits=group_bits, **options)
            assert (W.decode(data) == px).all(), (h, w, colours, palette, lz, cache, options)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    rnd = np.random.default_rng(mode)
    px = rnd.integers(0, 256, (11, 14, 4), dtype=np.uint8)
    assert (W.decode(W.encode(px, modes=np.full((3, 4), mode))) == px).all()


def test_known_file():
    """A one-pixel file made by hand: opaque, red 1, green 2, blue 3, every code of one symbol."""
    bits = []
    put = lambda v, n: bits.extend((v >> i) & 1 for i in range(n))
    for v, n in ((0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        put(v, n)
    for v in (2, 1, 3, 255):
        put(1, 1), put(0, 1), put(1, 1), put(v, 8)
    put(1, 1), put(0, 1), put(0, 1), put(0, 1)
    body = b"\x2f" + np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert W.decode(data).tolist() == [[[255, 1, 2, 3]]]


PYTHON = pathlib.Path(os.__file__).parent / "test" / "test_email" / "data"


def png_alpha(data):
    """The alpha of an 8-bit PNG with a palette."""
    at, packed = 8, b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height = (int.from_bytes(body[i : i + 4], "big") for i in (0, 4))
        elif kind == b"tRNS":
            alpha = np.concatenate([np.frombuffer(body, np.uint8), np.full(256 - n, 255, np.uint8)])
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    assert not rows[:, 0].any()
    return alpha[rows[:, 1:]]


@pytest.mark.skipif(not (PYTHON / "python.webp").exists(), reason="this Python has no picture files")
def test_picture_of_another_encoder():
    """The transparency of a picture that comes with Python, a lossless stream without a header of its own."""
    data, at = (PYTHON / "python.webp").read_bytes(), 12
    while data[at : at + 4] != b"ALPH":
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1) // 2 * 2
    body = data[at + 9 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")]
    assert data[at + 8] == 1  # lossless, no filter
    body = b"\x2f" + (15 | 15 << 14).to_bytes(4, "little") + body
    body += bytes(len(body) & 1)
    px = W.decode(b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body)
    assert (px[..., 2] == png_alpha((PYTHON / "python.png").read_bytes())).all()


class Hand:
    """A bit writer that knows nothing of the module; each code is written by hand with symbols of one or two."""

    def __init__(self, width, height):
        self.bits = []
        self.put((width - 1, 14), (height - 1, 14), (0, 1), (0, 3))

    def put(self, *pairs):
        for v, n in pairs:
            self.bits += [(v >> i) & 1 for i in range(n)]

    def one(self, *symbols):
        """Codes of a single symbol each, which take no bits."""
        for s in symbols:
            self.put((1, 1), (0, 1), (1, 1), (s, 8))

    def two(self, a, b):
        """A code of two symbols: the smaller, a, is 0, b is 1."""
        self.put((1, 1), (1, 1), (1, 1), (a, 8), (b, 8))

    def file(self):
        body = b"\x2f" + np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        body += bytes(len(body) & 1)
        return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def test_transforms_of_files_made_by_hand():
    # Subtract green: stored red 1 and blue 3 gain green 2.
    h = Hand(1, 1)
    h.put((1, 1), (2, 2), (0, 1), (0, 1), (0, 1))
    h.one(2, 1, 3, 255, 0)
    assert W.decode(h.file()).tolist() == [[[255, 3, 2, 5]]]
    # Predictor 1 (left) in one block of 4 x 4 pixels: every residual is green 7; the first pixel adds opaque black, the top row the left one.
    h = Hand(3, 2)
    h.put((1, 1), (0, 2), (0, 3), (0, 1))
    h.one(1, 0, 0, 255, 0)
    h.put((0, 1), (0, 1), (0, 1))
    h.one(7, 0, 0, 0, 0)
    assert W.decode(h.file())[..., 2].tolist() == [[7, 14, 21], [14, 21, 28]]
    # Cross-colour: green to red 32 (one), green to blue 224 (minus one), red to blue 64 (two): red 10 + 5, blue 100 - 5 + 30.
    h = Hand(1, 1)
    h.put((1, 1), (1, 2), (0, 3), (0, 1))
    h.one(224, 64, 32, 255, 0)
    h.put((0, 1), (0, 1), (0, 1))
    h.one(5, 10, 100, 255, 0)
    assert W.decode(h.file()).tolist() == [[[255, 15, 5, 125]]]
    # A palette of two colours, stored as differences, eight pixels in a green byte: 0b01100101, lowest bit first.
    h = Hand(8, 1)
    h.put((1, 1), (3, 2), (1, 8), (0, 1))
    h.two(0, 9)
    h.one(1, 2, 3, 0)
    h.put((1, 1), (0, 1), (0, 1), (0, 1), (0, 1))
    h.one(0b01100101, 0, 0, 255, 0)
    first, second = [3, 1, 9, 2], [6, 2, 9, 4]
    assert W.decode(h.file()).tolist() == [[second, first, second, first, first, second, second, first]]
    # Colour cache of two entries: a literal, then its cache code. The slot is the top bit of 0x1e35a7bd times the colour.
    colour = 0xFF010203
    slot = (0x1E35A7BD * colour & 0xFFFFFFFF) >> 31
    h = Hand(3, 1)
    h.put((0, 1), (1, 1), (1, 4), (0, 1))
    # The green alphabet has 282 symbols, so its lengths are a code of their own: symbols 2 and 280 + slot have length 1.
    lengths = [0] * 282
    lengths[2] = lengths[280 + slot] = 1
    order = [17, 18, 0, 1]
    h.put((0, 1), (0, 4))
    for s in order:  # code lengths of 17, 18, 0, 1: the literal lengths 0 and 1 get one bit each
        h.put(({17: 0, 18: 0, 0: 1, 1: 1}[s], 3))
    h.put((0, 1))
    for n in lengths:
        h.put((n, 1))
    h.one(1, 3, 255, 0)
    h.put((0, 1), (1, 1), (1, 1))
    assert W.decode(h.file()).tolist() == [[[255, 1, 2, 3]] * 3]


def test_very_long_payloads_are_several_images():
    p = np.frombuffer(bytes(range(250)) * 40, np.uint8)
    data = W.encode_bytes(p, most=4096)
    assert data.count(b"WEBPVP8L") == 3 and (W.decode_bytes(data, len(p), most=4096) == p).all()


def test_payloads():
    rnd = random.Random(4)
    cases = [bytes(64), bytes(range(256)) * 3, b"ab" * 5000, b"x" * 70000, b"a" * 17 + b"b" * 18 + b"c" * 5000 + bytes(rnd.randrange(256) for _ in range(997)), "Ünïcode ☃ ".encode() * 300]
    cases += [bytes(int(abs(rnd.gauss(0, s))) % 256 for _ in range(n)) for s in (0.4, 2, 9, 80) for n in (64, 640, 6400)]
    cases += [bytes(min(255, int(rnd.expovariate(0.05))) for _ in range(1_200_000))]
    for p in cases:
        a = np.frombuffer(p, np.uint8)
        data = W.encode_bytes(a)
        assert W.decode_bytes(data, len(a)).tobytes() == p


def test_damage_is_told():
    with pytest.raises(ValueError):
        W.decode(b"RIFF1234WEBPVP8 abcd1234")
