"""Whole images: planes to files and back, through transform, block coder and packets."""

from __future__ import annotations

import math
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tessella.functions import coder
from tessella.functions.pointwise import ICT_FORWARD, ICT_INVERSE
from tessella.operators import wavelet
from tessella.sources import codestream as cs


@dataclass(frozen=True)
class Options:
    """How to encode: format, reversible or with a quantiser step, levels, tile and block sides, comment."""

    jp2: bool = True
    reversible: bool = True
    step: float = 1 / 16
    levels: int = 5
    tile: int = 256
    block: int = 6  # sides of 2^6
    mct: bool = True
    comment: str = ""


def bands(w: int, h: int, levels: int) -> list[tuple[int, str, int, int, int, int]]:
    """(resolution, band, x0, y0, x1, y1) of a split plane, low band first."""
    at = wavelet.sizes(w, h, levels)
    low = ((at[-1][0] + 1) // 2, (at[-1][1] + 1) // 2) if at else (w, h)
    out = [(0, "LL", 0, 0, *low)]
    for res, (bw, bh) in enumerate(reversed(at), 1):
        hw, hh = (bw + 1) // 2, (bh + 1) // 2
        out += [(res, "HL", hw, 0, bw, hh), (res, "LH", 0, hh, hw, bh), (res, "HH", hw, hh, bw, bh)]
    return out


class _Bits:
    def __init__(self, data: bytes = b"", at: int = 0):
        self.out: list[int] = []
        self.data, self.at, self.used, self.last = data, at, 0, 0

    def put(self, value: int, width: int) -> None:
        self.out += [value >> i & 1 for i in range(width - 1, -1, -1)]

    def get(self, width: int) -> int:
        v = 0
        for _ in range(width):
            if not self.used:
                self.used = 7 if self.last == 0xFF else 8
                self.last = self.data[self.at]
                self.at += 1
            self.used -= 1
            v = v << 1 | self.last >> self.used & 1
        return v


def packet(blocks: list[tuple[int, bytes]], depth: int) -> bytes:
    """A packet of (bit planes, bytes) blocks: presence, then for each block inclusion, zero planes in unary, passes and length; then the bodies."""
    b = _Bits()
    present = any(p for p, _ in blocks)
    b.put(present, 1)
    if present:
        for planes, data in blocks:
            b.put(planes > 0, 1)
            if planes:
                b.put(1, depth - planes + 1)
                n = 3 * planes - 2
                if n == 1:
                    b.put(0, 1)
                elif n == 2:
                    b.put(2, 2)
                elif n <= 5:
                    b.put(12 + n - 3, 4)
                elif n <= 36:
                    b.put(15, 4)
                    b.put(n - 6, 5)
                else:
                    b.put(511, 9)
                    b.put(n - 37, 7)
                b.put(len(data).bit_length(), 5)
                b.put(len(data), len(data).bit_length())
    head = coder.raw_encode(b.out)
    if head.endswith(b"\xff"):
        head += b"\0"
    return len(head).to_bytes(4, "big") + head + b"".join(data for planes, data in blocks if planes)


def read_packet(data: bytes, at: int, n_blocks: int, depth: int) -> tuple[list[tuple[int, bytes]], int]:
    """The blocks of the packet at `at`, and where the next one begins."""
    head = int.from_bytes(data[at : at + 4], "big")
    b, body = _Bits(data[at + 4 : at + 4 + head]), at + 4 + head
    sizes: list[tuple[int, int]] = []
    present = b.get(1)
    for _ in range(n_blocks):
        if not (present and b.get(1)):
            sizes.append((0, 0))
            continue
        planes = depth
        while not b.get(1):
            planes -= 1
        if b.get(1) and b.get(1) and b.get(2) == 3 and b.get(5) == 31:
            b.get(7)
        sizes.append((planes, b.get(b.get(5))))
    out = []
    for planes, n in sizes:
        out.append((planes, data[body : body + n]))
        body += n
    return out, body


def _blocks(w: int, h: int, levels: int, side: int) -> Iterator[tuple[str, list[tuple[int, int, int, int]]]]:
    for _, band, x0, y0, x1, y1 in bands(w, h, levels):
        yield band, [(x, y, min(x + side, x1), min(y + side, y1)) for y in range(y0, y1, side) for x in range(x0, x1, side)]


def _tiles(w: int, h: int, side: int) -> list[tuple[int, int, int, int]]:
    return [(x, y, min(x + side, w), min(y + side, h)) for y in range(0, h, side) for x in range(0, w, side)]


def step_field(step: float, precision: int) -> int:
    """A quantiser step as QCD holds it: 5 bits of exponent e and 11 of mantissa m, step = 2^(precision - e) * (1 + m / 2048); the nearest there is."""
    power = math.floor(math.log2(step))
    m = round((step / 2.0**power - 1) * 2048)
    power, m = (power + 1, 0) if m == 2048 else (power, m)
    if not 0 <= precision - power <= 31:
        raise ValueError("a quantiser step beyond what the header can hold")
    return (precision - power) << 11 | m


def field_step(mantissa: int, exponent: int, precision: int) -> float:
    return 2.0 ** (precision - exponent) * (1 + mantissa / 2048)


def encode(planes: np.ndarray, precision: int, signed: bool = False, o: Options = Options()) -> bytes:
    """A file of planes[component, y, x]. Every tile is coded alone."""
    n, h, w = planes.shape
    mct = o.mct and n >= 3
    field = step_field(o.step, precision)
    step = field_step(field & 2047, field >> 11, precision)
    stream = cs.write_header(w, h, (o.tile, o.tile), [(precision, signed)] * n, o.levels, (o.block, o.block), o.reversible, mct=mct, comment=o.comment, steps=[field] * (3 * o.levels + 1))
    depth = precision + 8 if o.reversible else 37
    for t, (x0, y0, x1, y1) in enumerate(_tiles(w, h, o.tile)):
        a = planes[:, y0:y1, x0:x1].astype(np.int64)
        if not signed:
            a = a - (1 << (precision - 1))
        a = forward_components(a, o.reversible) if mct else a
        c = wavelet.np_decompose(a, o.levels, "53" if o.reversible else "97")
        if not o.reversible:
            c = (np.sign(c) * np.floor(np.abs(c) / step + 0.5)).astype(np.int64)
        out = b""
        for i in range(n):
            for band, blocks in _blocks(x1 - x0, y1 - y0, o.levels, 1 << o.block):
                out += packet([coder.encode_block(c[i, b[1] : b[3], b[0] : b[2]], band) for b in blocks], depth)
        stream += cs.tile_part(t, out)
    stream += cs.EOC.to_bytes(2, "big")
    return cs.wrap(stream, w, h, n, precision, 16 if n >= 3 else 17) if o.jp2 else stream


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """planes[component, y, x] and their precision; the quantiser step is the file's."""
    if cs.sniff(data) == "JP2":
        data = next(content for _, name, content in cs.boxes(data) if name == "jp2c")
    h = cs.main_header(data)
    n, precision, signed = len(h.components), h.components[0]["precision"], h.components[0]["signed"]
    reversible, levels, side = h.style["wavelet"] == 1, h.style["levels"], h.style["block_width"]
    depth = precision + 8 if reversible else 37
    step = 1.0 if reversible else field_step(*h.quantization["steps"][0], precision)
    out = np.zeros((n, h.height, h.width), np.int64)
    tiles = _tiles(h.width, h.height, h.tile_width)
    for t, _, _, body in cs.tile_parts(data, h):
        x0, y0, x1, y1 = tiles[t]
        c, at = np.zeros((n, y1 - y0, x1 - x0), np.int64), 0
        for i in range(n):
            for band, blocks in _blocks(x1 - x0, y1 - y0, levels, side):
                got, at = read_packet(body, at, len(blocks), depth)
                for b, (planes, bits) in zip(blocks, got, strict=True):
                    if planes:
                        c[i, b[1] : b[3], b[0] : b[2]] = coder.decode_block(bits, planes, b[2] - b[0], b[3] - b[1], band)
        a = wavelet.np_reconstruct(c if reversible else c * step, levels, "53" if reversible else "97")
        a = inverse_components(a, reversible) if h.style["mct"] else a
        a = np.rint(a).astype(np.int64)
        low, high = (-(1 << (precision - 1)), (1 << (precision - 1)) - 1) if signed else (0, (1 << precision) - 1)
        out[:, y0:y1, x0:x1] = np.clip(a if signed else a + (1 << (precision - 1)), low, high)
    return out, precision


def forward_components(a: np.ndarray, reversible: bool) -> np.ndarray:
    if reversible:
        r, g, b = a[0], a[1], a[2]
        first = np.stack([(r + 2 * g + b) >> 2, b - g, r - g])
    else:
        first = np.einsum("ij,jyx->iyx", np.array(ICT_FORWARD), a[:3].astype(np.float64))
    return np.concatenate([first, a[3:]])


def inverse_components(a: np.ndarray, reversible: bool) -> np.ndarray:
    if reversible:
        g = a[0] - ((a[1] + a[2]) >> 2)
        first = np.stack([a[2] + g, g, a[1] + g])
    else:
        first = np.einsum("ij,jyx->iyx", np.array(ICT_INVERSE), a[:3])
    return np.concatenate([first, a[3:]])


def encode_images(images: DataFrame, precision: int, options: Options = Options()) -> DataFrame:
    """(id, width, height, components, data array<int>, component by component) -> (id, content): one file per row, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, n, data in zip(*b.columns, strict=True):
                a = np.array(data.as_py(), np.int64).reshape(n.as_py(), h.as_py(), w.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array([encode(a, precision, o=options)], pa.binary())], names=["id", "content"])

    return images.select("id", "width", "height", "components", "data").mapInArrow(run, "id long, content binary")


def decode_images(files: DataFrame) -> DataFrame:
    """(id, content) -> (id, width, height, components, data, error): a file that cannot be read has nulls and the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, content in zip(*b.columns, strict=True):
                why, shape, samples = None, (None, None, None), None
                try:
                    a, _ = decode(content.as_py() or b"")
                    shape, samples = a.shape[::-1], a.ravel()
                except (cs.BadFile, ArithmeticError, LookupError, TypeError, ValueError, StopIteration, struct.error) as e:
                    why = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), *[pa.array([x], pa.int32()) for x in shape], pa.array([samples], pa.list_(pa.int32())), pa.array([why], pa.string())], names=["id", "width", "height", "components", "data", "error"])

    return files.select("id", "content").mapInArrow(run, "id long, width int, height int, components int, data array<int>, error string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
