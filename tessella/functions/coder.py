"""Sequential coders: the MQ arithmetic coder, the raw bit coder with byte stuffing, and the bit-plane block coder.

These depend on all that went before, so they are plain functions on one block's numbers, run by Arrow functions.
Each returns fresh bytes.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# fixed values: probability states (Qe, next if more probable, next if less probable, switch)
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
SIGN, REFINE, RUN, UNIFORM = 9, 14, 17, 18  # first context of each kind; significance has 0 to 8


def start_states(standard: bool = True) -> list[int]:
    """State of each of 19 contexts at a block's start: the published ones, or 0 for all but the uniform one."""
    out = [0] * 19
    out[UNIFORM] = 46
    if standard:
        out[0], out[RUN] = 4, 3
    return out


class Encoder:
    """MQ encoder over a set of contexts."""

    def __init__(self, states: list[int]):
        self.index, self.mps = list(states), [0] * len(states)
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, bytearray(b"\0")  # a byte before the first

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20)
            self.c &= 0xFFFFF
            self.ct = 7
        else:
            self.out.append(self.c >> 19)
            self.c &= 0x7FFFF
            self.ct = 8

    def bit(self, cx: int, d: int) -> int:
        qe, up, down, switch = STATES[self.index[cx]]
        self.a -= qe
        if d == self.mps[cx]:
            if self.a & 0x8000:
                self.c += qe
                return d
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            self.index[cx] = up
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            self.mps[cx] ^= switch
            self.index[cx] = down
        while True:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self._byte()
            if self.a & 0x8000:
                return d

    def flush(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        out = bytes(self.out[1:])
        return out[:-1] if out.endswith(b"\xff") else out


class Decoder:
    """MQ decoder; past the data's end it reads ones."""

    def __init__(self, data: bytes, states: list[int]):
        self.index, self.mps = list(states), [0] * len(states)
        self.data, self.at = data, 0
        self.c = (data[0] if data else 0xFF) << 16
        self._byte()
        self.c <<= 7
        self.ct -= 7
        self.a = 0x8000

    def _byte(self) -> None:
        data, at = self.data, self.at
        now, after = (data[i] if i < len(data) else 0xFF for i in (at, at + 1))
        if now == 0xFF:
            if after > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += after << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += after << 8
            self.ct = 8

    def bit(self, cx: int, d: int = 0) -> int:
        qe, up, down, switch = STATES[self.index[cx]]
        self.a -= qe
        d = self.mps[cx]
        if (self.c >> 16) & 0xFFFF < qe:
            likely = self.a < qe
            self.a = qe
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return d
            likely = self.a >= qe
        if likely:
            self.index[cx] = up
        else:
            d ^= 1
            self.mps[cx] ^= switch
            self.index[cx] = down
        while True:
            if not self.ct:
                self._byte()
            self.a <<= 1
            self.c = (self.c << 1) & 0xFFFFFFFF
            self.ct -= 1
            if self.a & 0x8000:
                return d


def raw_encode(bits: list[int]) -> bytes:
    """Bits, high first; the byte after 0xFF holds seven."""
    out, now, room = bytearray(), 0, 8
    for b in bits:
        room -= 1
        now |= b << room
        if not room:
            out.append(now)
            now, room = 0, 7 if now == 0xFF else 8
    if room != (7 if out[-1:] == b"\xff" else 8):
        out.append(now)
    return bytes(out)


def raw_decode(data: bytes, n: int) -> list[int]:
    out, last = [], 0
    for b in data:
        out += [b >> i & 1 for i in range(6 if last == 0xFF else 7, -1, -1)]
        last = b
    return out[:n] + [0] * (n - len(out))


def zero_context(h: int, v: int, d: int, band: str) -> int:
    """Context of a sample not yet significant from its significant neighbours: beside, above and below, and diagonal."""
    if band == "HH":
        s = min(h + v, 2)
        return 8 if d >= 3 else (7 if s else 6) if d == 2 else 3 + s if d == 1 else s
    if band == "HL":
        h, v = v, h
    if h == 2:
        return 8
    if h == 1:
        return 7 if v else 6 if d else 5
    return 4 if v == 2 else 3 if v == 1 else min(d, 2)


def sign_context(h: int, v: int) -> tuple[int, int]:
    """Context and predicted sign from the signs of the neighbours beside, and above and below: each -1, 0 or 1."""
    if h < 0 or h == 0 and v < 0:
        return sign_context(-h, -v)[0], 1
    return SIGN + (1 if v else 0) if h == 0 else SIGN + 3 + v, 0


class _Block:
    def __init__(self, coder, w: int, h: int, band: str, scan: str):
        self.coder, self.w, self.h, self.band = coder, w, h, band
        self.wide = w + 2
        size = self.wide * (h + 2)
        self.sig, self.neg, self.seen, self.fine, self.mag = bytearray(size), bytearray(size), bytearray(size), bytearray(size), [0] * size
        at = lambda x, y: (y + 1) * self.wide + x + 1
        self.raster = [at(x, y) for y in range(h) for x in range(w)]
        self.stripes = [[at(x, y) for y in range(top, min(h, top + 4))] for top in range(0, h, 4) for x in range(w)]
        self.order = self.raster if scan == "raster" else [i for s in self.stripes for i in s]

    def zero(self, i: int) -> int:
        s, n = self.sig, self.wide
        return zero_context(s[i - 1] + s[i + 1], s[i - n] + s[i + n], s[i - n - 1] + s[i - n + 1] + s[i + n - 1] + s[i + n + 1], self.band)

    def near(self, i: int) -> bool:
        s, n = self.sig, self.wide
        return bool(s[i - 1] or s[i + 1] or s[i - n] or s[i + n] or s[i - n - 1] or s[i - n + 1] or s[i + n - 1] or s[i + n + 1])

    def sign(self, i: int) -> None:
        s, g, n = self.sig, self.neg, self.wide
        of = lambda j: s[j] and 1 - 2 * g[j]
        cut = lambda x: max(-1, min(1, x))
        cx, flip = sign_context(cut(of(i - 1) + of(i + 1)), cut(of(i - n) + of(i + n)))
        g[i] = self.coder.bit(cx, g[i] ^ flip) ^ flip
        s[i] = 1

    def run(self, planes: int) -> None:
        """All passes of all planes. The coder's bit() takes the true bit and gives the coded one; a decoder ignores the former."""
        bit, mag, sig, seen, fine = self.coder.bit, self.mag, self.sig, self.seen, self.fine
        for p in range(planes - 1, -1, -1):
            one = 1 << p

            def code(i: int, cx: int, p=p, one=one) -> int:
                got = bit(cx, mag[i] >> p & 1)
                mag[i] = mag[i] | one if got else mag[i] & ~one
                return got

            if p < planes - 1:
                for i in self.order:
                    if not sig[i] and self.near(i):
                        seen[i] = 1
                        if code(i, self.zero(i)):
                            self.sign(i)
                for i in self.order:
                    if sig[i] and not seen[i]:
                        code(i, REFINE + 2 if fine[i] else REFINE + 1 if self.near(i) else REFINE)
                        fine[i] = 1
            for column in self.stripes:
                k = 0
                if len(column) == 4 and not any(sig[i] or seen[i] or self.near(i) for i in column):
                    first = next((j for j, i in enumerate(column) if mag[i] >> p & 1), 4)
                    if not bit(RUN, int(first < 4)):
                        for i in column:
                            mag[i] &= ~one
                        continue
                    first = bit(UNIFORM, first >> 1 & 1) << 1 | bit(UNIFORM, first & 1)
                    for i in column[:first]:
                        mag[i] &= ~one
                    mag[column[first]] |= one
                    self.sign(column[first])
                    k = first + 1
                for i in column[k:]:
                    if not sig[i] and not seen[i] and code(i, self.zero(i)):
                        self.sign(i)
            seen[:] = bytes(len(seen))


def encode_block(a: np.ndarray, band: str = "LL", scan: str = "stripe", standard: bool = True) -> tuple[int, bytes]:
    """(bit planes, bytes) of a block of signed numbers; a block of zeros has 0 planes and no bytes."""
    h, w = a.shape
    planes = int(np.abs(a).max(initial=0)).bit_length()
    if not planes:
        return 0, b""
    b = _Block(Encoder(start_states(standard)), w, h, band, scan)
    for i, v in zip(b.raster, a.ravel().tolist(), strict=True):
        b.mag[i], b.neg[i] = abs(v), int(v < 0)
    b.run(planes)
    return planes, b.coder.flush()


def decode_block(data: bytes, planes: int, w: int, h: int, band: str = "LL", scan: str = "stripe", standard: bool = True) -> np.ndarray:
    b = _Block(Decoder(data, start_states(standard)), w, h, band, scan)
    if planes:
        b.run(planes)
    return np.array([-b.mag[i] if b.neg[i] else b.mag[i] for i in b.raster], np.int64).reshape(h, w)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
