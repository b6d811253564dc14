"""Image files: boxes, codestream headers, metadata; as functions of bytes, as table functions and as a data source."""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: markers
SOC, SIZ, COD, COC, QCD, QCC, POC, TLM = 0xFF4F, 0xFF51, 0xFF52, 0xFF53, 0xFF5C, 0xFF5D, 0xFF5F, 0xFF55
PLM, PPM, PPT, CRG, COM, CAP, SOT, SOD, EOC = 0xFF57, 0xFF60, 0xFF61, 0xFF63, 0xFF64, 0xFF50, 0xFF90, 0xFF93, 0xFFD9
MARKERS = {
    0xFF4F: "SOC", 0xFF90: "SOT", 0xFF93: "SOD", 0xFFD9: "EOC", 0xFF51: "SIZ", 0xFF52: "COD", 0xFF53: "COC", 0xFF5E: "RGN", 0xFF5C: "QCD", 0xFF5D: "QCC", 0xFF5F: "POC",
    0xFF55: "TLM", 0xFF57: "PLM", 0xFF58: "PLT", 0xFF60: "PPM", 0xFF61: "PPT", 0xFF91: "SOP", 0xFF92: "EPH", 0xFF63: "CRG", 0xFF64: "COM", 0xFF50: "CAP",
    0xFF78: "CBD", 0xFF74: "MCT", 0xFF75: "MCC", 0xFF77: "MCO",
}
DELIMITERS = ("SOC", "SOT", "SOD", "EOC")
BARE = ("SOC", "SOD", "EOC", "EPH")  # without a length
SIGNATURE = bytes.fromhex("0000000c6a5020200d0a870a")
FORMATS = ("J2K", "JP2", "JPX")
ORDERS = ("LRCP", "RLCP", "RPCL", "PCRL", "CPRL")
PROFILES = {0: "none", 0x8000: "part2", 3: "cinema2k", 4: "cinema4k", 5: "cinema_s2k", 6: "cinema_s4k", 7: "cinema_slte", 0x100: "broadcast_single", 0x200: "broadcast_multi", 0x400: "imf2k", 0x500: "imf4k", 0x600: "imf8k"}
# fixed values: a file's colour-space number to (number, name) of the library's own
COLOUR_SPACES = {
    0: (6, "bilevel"), 1: (3, "sycc"), 3: (7, "ycbcr2"), 4: (8, "ycbcr3"), 9: (9, "photoycc"), 11: (10, "cmy"), 12: (5, "cmyk"), 13: (11, "ycck"), 14: (12, "lab"), 15: (6, "bilevel"),
    16: (1, "srgb"), 17: (2, "gray"), 18: (3, "sycc"), 19: (13, "jab"), 20: (14, "esrgb"), 21: (15, "romm"), 22: (16, "ypbpr60"), 23: (17, "ypbpr50"), 24: (4, "eycc"),
}
UNKNOWN_SPACE, NO_SPACE = -1, 0
BOX_LIMIT = 1 << 30


class BadFile(ValueError):
    """What a file has that it must not."""


# ---------------------------------------------------------------- boxes


def boxes(data: bytes) -> Iterator[tuple[int, str, bytes]]:
    """(offset, type, content) of each box. Length 1 means a 64-bit length follows; 0, too short and over 1 GiB are errors."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise BadFile("box header cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > len(data):
                raise BadFile("box header cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        if size < head:
            raise BadFile(f"box length {size}")
        if size - head > BOX_LIMIT:
            raise BadFile("box over 1 GiB")
        if at + size > len(data):
            raise BadFile("box content cut off")
        yield at, kind.decode("latin-1"), data[at + head : at + size]
        at += size


def box(kind: str, content: bytes) -> bytes:
    n = len(content) + 8
    return struct.pack(">I4s", n, kind.encode()) + content if n < 1 << 32 else struct.pack(">I4sQ", 1, kind.encode(), n + 8) + content


def wrap(codestream: bytes, width: int, height: int, components: int, precision: int, space: int = 16, icc: bytes = b"") -> bytes:
    """A file of boxes around a codestream."""
    ihdr = box("ihdr", struct.pack(">IIHBBBB", height, width, components, precision - 1, 7, 0, 0))
    colr = box("colr", b"\x02\0\0" + icc if icc else struct.pack(">BBBI", 1, 0, 0, space))
    return SIGNATURE + box("ftyp", b"jp2 \0\0\0\0jp2 ") + box("jp2h", ihdr + colr) + box("jp2c", codestream)


def sniff(data: bytes) -> str | None:
    if data[:12] == SIGNATURE:
        return "JP2"
    return "J2K" if data[:4] == b"\xff\x4f\xff\x51" else None


# ---------------------------------------------------------------- headers


@dataclass
class Header:
    """A codestream's main header, or what a tile-part header changes."""

    profile: int = 0
    width: int = 0
    height: int = 0
    x_offset: int = 0
    y_offset: int = 0
    tile_width: int = 0
    tile_height: int = 0
    tile_x_offset: int = 0
    tile_y_offset: int = 0
    components: list[dict] = field(default_factory=list)
    style: dict | None = None
    styles: dict[int, dict] = field(default_factory=dict)
    quantization: dict | None = None
    quantizations: dict[int, dict] = field(default_factory=dict)
    order_changes: list[tuple[int, ...]] = field(default_factory=list)
    tile_lengths: list[tuple[int, int]] = field(default_factory=list)
    packet_lengths: list[int] = field(default_factory=list)
    packed_headers: bytes = b""
    comment: str = ""
    pcap: int | None = None
    ccap: list[int] = field(default_factory=list)
    end: int = 0  # where the marker that ended the header stands

    @property
    def tiles(self) -> tuple[int, int]:
        return -(-(self.width - self.tile_x_offset) // self.tile_width), -(-(self.height - self.tile_y_offset) // self.tile_height)

    @property
    def high_throughput(self) -> bool:
        return bool(self.pcap is not None and self.pcap >> 17 & 1) or any(s["block_style"] & 0x40 for s in [self.style or {"block_style": 0}, *self.styles.values()])


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, kind: str) -> int:
        n = struct.calcsize(">" + kind)
        if self.at + n > len(self.data):
            raise BadFile("cut off")
        self.at += n
        return struct.unpack_from(">" + kind, self.data, self.at - n)[0]

    def bytes(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise BadFile("cut off")
        self.at += n
        return self.data[self.at - n : self.at]


def vlq_read(r: _Reader) -> int:
    value = 0
    while True:
        b = r.take("B")
        value = value << 7 | b & 127
        if b < 128:
            return value


def _style(r: _Reader, precincts: bool) -> dict:
    out = {k: r.take("B") for k in ("levels", "block_width", "block_height", "block_style", "wavelet")}
    out["block_width"], out["block_height"] = 1 << out["block_width"] + 2, 1 << out["block_height"] + 2
    out["precincts"] = [r.take("B") for _ in range(out["levels"] + 1)] if precincts else []
    return out


def _quantization(r: _Reader, end: int) -> dict:
    s = r.take("B")
    kind, out = s & 31, {"kind": ("none", "derived", "expounded")[min(s & 31, 2)], "guard_bits": s >> 5, "steps": []}
    while r.at < end:
        if kind == 0:
            out["steps"].append((0, r.take("B") >> 3))
        else:
            v = r.take("H")
            out["steps"].append((v & 0x7FF, v >> 11))
        if kind == 1:
            break
    return out


def _segment(h: Header, marker: int, data: bytes) -> None:
    """One marker segment's content, after its length."""
    r, wide = _Reader(data), "H" if len(h.components) >= 257 else "B"
    if marker == COD:
        flags, order, layers, mct = r.take("B"), r.take("B"), r.take("H"), r.take("B")
        h.style = {"flags": flags, "order": order, "layers": layers, "mct": mct, **_style(r, bool(flags & 1))}
    elif marker == COC:
        c, flags = r.take(wide), r.take("B")
        h.styles[c] = {"flags": flags, **_style(r, bool(flags & 1))}
    elif marker == QCD:
        h.quantization = _quantization(r, len(data))
    elif marker == QCC:
        c = r.take(wide)
        h.quantizations[c] = _quantization(r, len(data))
    elif marker == POC:
        while r.at < len(data):
            h.order_changes.append((r.take("B"), r.take(wide), r.take("H"), r.take("B"), r.take(wide), r.take("B")))
    elif marker == TLM:
        r.take("B")
        s = r.take("B")
        if s >> 4 & 3 == 3:
            raise BadFile("TLM: index size 3")
        index, length = ("", "B", "H")[s >> 4 & 3], "I" if s >> 6 & 1 else "H"
        size = len(index and " " * struct.calcsize(index)) + struct.calcsize(length)
        for i in range((len(data) - 2) // size):
            h.tile_lengths.append((r.take(index) if index else i, r.take(length)))
    elif marker == PLM:
        r.take("B")
        while r.at < len(data):
            h.packet_lengths.append(vlq_read(r))
    elif marker in (PPM, PPT):
        h.packed_headers += data[1:]
    elif marker == COM:
        if r.take("H") == 1:
            h.comment = data[2:].decode("latin-1")
    elif marker == CAP:
        if len(data) < 4:
            raise BadFile("CAP too short")
        h.pcap, h.ccap = r.take("I"), [r.take("H") for _ in range((len(data) - 4) // 2)]


def _size(h: Header, data: bytes) -> None:
    r = _Reader(data)
    h.profile = r.take("H")
    for k in ("width", "height", "x_offset", "y_offset", "tile_width", "tile_height", "tile_x_offset", "tile_y_offset"):
        setattr(h, k, r.take("I"))
    n = r.take("H")
    if len(data) != 36 + 3 * n:
        raise BadFile(f"SIZ length: expected {38 + 3 * n}, got {len(data) + 2}")
    for _ in range(n):
        depth = r.take("B")
        h.components.append({"precision": (depth & 127) + 1, "signed": depth > 127, "dx": r.take("B"), "dy": r.take("B")})


def invalid(h: Header) -> str | None:
    """Why a header cannot be used, or None."""
    if not (h.width and h.height):
        return "no image area"
    if not (h.tile_width and h.tile_height):
        return "no tile area"
    if not 1 <= len(h.components) <= 16384:
        return "number of components"
    if any(not (c["dx"] and c["dy"]) for c in h.components):
        return "subsampling of 0"
    if any(not 1 <= c["precision"] <= 38 for c in h.components):
        return "precision"
    return None


def _until(r: _Reader, h: Header, stop: int) -> None:
    while True:
        marker = r.take("H")
        if marker == stop:
            h.end = r.at - 2
            return
        length = r.take("H")
        if length < 2:
            raise BadFile("segment length")
        _segment(h, marker, r.bytes(length - 2))


def main_header(data: bytes) -> Header:
    """SOC, SIZ, then segments up to the first tile-part; unknown ones are skipped."""
    r, h = _Reader(data), Header()
    if r.take("H") != SOC:
        raise BadFile("no SOC")
    if r.take("H") != SIZ:
        raise BadFile("SIZ must come first")
    _size(h, r.bytes(r.take("H") - 2))
    _until(r, h, SOT)
    if why := invalid(h):
        raise BadFile(why)
    return h


def tile_parts(data: bytes, main: Header) -> Iterator[tuple[int, int, Header, bytes]]:
    """(tile, part, its header, its data) of each tile-part."""
    at = main.end
    while True:
        if at + 2 > len(data):
            raise BadFile("cut off")
        if struct.unpack_from(">H", data, at)[0] != SOT:
            return
        r = _Reader(data, at + 2)
        if r.take("H") != 10:
            raise BadFile("SOT length")
        tile, size, part, _ = r.take("H"), r.take("I"), r.take("B"), r.take("B")
        h = Header(components=main.components)
        _until(r, h, SOD)
        end = at + size if size else len(data) - 2
        if end > len(data) or r.at > end:
            raise BadFile("cut off")
        yield tile, part, h, data[r.at : end]
        at = end


def segment(marker: int, content: bytes) -> bytes:
    return struct.pack(">HH", marker, len(content) + 2) + content


def write_header(width: int, height: int, tile: tuple[int, int], components: list[tuple[int, bool]], levels: int, block: tuple[int, int] = (6, 6), reversible: bool = True, order: int = 0, layers: int = 1, mct: bool = True, comment: str = "", profile: int = 0, high_throughput: bool = False, steps: list[int] | None = None) -> bytes:
    """SOC, SIZ, CAP where high throughput is asked for, COD, QCD, COM. Block sides are powers of two; components are (precision, signed)."""
    siz = struct.pack(">H8IH", profile, width, height, 0, 0, tile[0], tile[1], 0, 0, len(components)) + b"".join(struct.pack("BBB", p - 1 | s << 7, 1, 1) for p, s in components)
    cod = struct.pack(">BBHBBBBBB", 0, order, layers, mct, levels, block[0] - 2, block[1] - 2, 0x40 * high_throughput, int(reversible))
    bands = 3 * levels + 1
    exponents = [(components[0][0] + (0 if i == 0 else 2 if i % 3 == 0 else 1)) << 3 for i in range(bands)]
    qcd = bytes([0x40, *[min(x, 255) for x in exponents]]) if reversible else struct.pack(f">B{bands}H", 0x42, *(steps or [8 << 11] * bands))
    out = struct.pack(">H", SOC) + segment(SIZ, siz)
    if high_throughput:
        out += segment(CAP, struct.pack(">IH", 1 << 17, 0))
    out += segment(COD, cod) + segment(QCD, qcd)
    return out + (segment(COM, b"\0\x01" + comment.encode("latin-1", "replace")) if comment else b"")


def tile_part(tile: int, data: bytes) -> bytes:
    return struct.pack(">HHHIBBH", SOT, 10, tile, len(data) + 14, 0, 1, SOD) + data


# ---------------------------------------------------------------- relations

META = (
    "format string, width long, height long, num_components int, bits array<int>, signed array<boolean>, colour_space int, profile int, num_resolutions int, "
    "layers int, tile_width long, tile_height long, tiles_x long, tiles_y long, icc binary, comment string, high_throughput boolean, error string"
)


def metadata(data: bytes) -> tuple:
    """One record of META; what cannot be read gives a record with the error alone."""
    try:
        kind, space, icc = sniff(data), NO_SPACE, None
        if kind is None:
            raise BadFile("unknown format")
        stream = data
        if kind == "JP2":
            stream = b""
            for _, name, content in boxes(data):
                if name == "jp2h":
                    for _, inner, c in boxes(content):
                        if inner == "colr" and len(c) >= 3:
                            if c[0] == 1:
                                space = COLOUR_SPACES.get(struct.unpack_from(">I", c, 3)[0], (UNKNOWN_SPACE, ""))[0]
                            else:
                                icc = c[3:]
                elif name == "jp2c":
                    stream = content
                    break
        h = main_header(stream)
        style = h.style or {"levels": 0, "layers": 0}
        return (kind, h.width, h.height, len(h.components), [c["precision"] for c in h.components], [c["signed"] for c in h.components], space, h.profile, style["levels"] + 1,
                style["layers"], h.tile_width, h.tile_height, *h.tiles, icc, h.comment, h.high_throughput, None)
    except (BadFile, struct.error) as e:
        return (*[None] * 17, str(e))


def read_metadata(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, content) -> key and one record of META for each file; pixels are never touched."""
    kind = dict(files.dtypes)[key]
    names = [x.split()[0] for x in META.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.bool_()), *[pa.int32()] * 4, *[pa.int64()] * 4, pa.binary(), pa.string(), pa.bool_(), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                cols = zip(*[metadata(x or b"") for x in b.column(1).slice(at, 64).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 64), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[key, *names])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {kind}, {META}")


def read_boxes(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, content) -> a row per box: key, offset, type, length, content; a bad box ends the file's rows with an error."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data in zip(b.column(0), b.column(1), strict=True):
                rows = []
                try:
                    for at, name, content in boxes(data.as_py() or b""):
                        rows.append((at, name, len(content), content, None))
                except BadFile as e:
                    rows.append((None, None, None, None, str(e)))
                if rows:
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), b.column(0).type), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)]], names=[key, "offset", "type", "length", "content", "error"])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {kind}, offset long, type string, length long, content binary, error string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, content); read in the JVM, so any store that Spark reads will do."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def colour_spaces(spark: SparkSession) -> DataFrame:
    """Lookup of colour-space numbers, small and fixed."""
    return F.broadcast(spark.createDataFrame([(k, *v) for k, v in COLOUR_SPACES.items()], "file_space int, colour_space int, name string"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
