"""Coders, headers, boxes and whole images: exact round trips and bad input."""

import numpy as np
import pytest

from tessella.functions import coder
from tessella.operators import codec, wavelet
from tessella.operators.codec import Options
from tessella.sources import codestream as cs


@pytest.mark.parametrize("n", [1, 10, 1000])
def test_mq_and_raw(n):
    r = np.random.default_rng(n)
    bits = [(int(x < 0.2), int(c)) for x, c in zip(r.random(n), r.integers(0, 19, n), strict=True)]
    e = coder.Encoder(coder.start_states())
    for b, c in bits:
        e.bit(c, b)
    d = coder.Decoder(e.flush(), coder.start_states())
    assert [d.bit(c) for _, c in bits] == [b for b, _ in bits]
    for raw in ([b for b, _ in bits], [1] * n):
        assert coder.raw_decode(coder.raw_encode(raw), n) == raw


@pytest.mark.parametrize("band", ["LL", "HL", "LH", "HH"])
@pytest.mark.parametrize("scan", ["stripe", "raster"])
def test_blocks(band, scan):
    r = np.random.default_rng(1)
    for w, h in ((1, 1), (3, 5), (7, 9), (16, 4), (4, 13)):
        for scale in (0, 0.5, 40, 3000):
            a = np.rint(r.standard_normal((h, w)) * scale).astype(int)
            for standard in (True, False):
                planes, data = coder.encode_block(a, band, scan, standard)
                assert (coder.decode_block(data, planes, w, h, band, scan, standard) == a).all()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8])
def test_wavelets(n):
    r = np.random.default_rng(n)
    a = r.integers(-500, 500, (2, 5, n))
    for levels in (0, 1, 3):
        assert (wavelet.np_reconstruct(wavelet.np_decompose(a, levels), levels) == a).all()
        assert np.abs(wavelet.np_reconstruct(wavelet.np_decompose(a, levels, "97"), levels, "97") - a).max() < 1e-8


@pytest.mark.parametrize(
    ("shape", "precision", "o"),
    [((1, 8, 8), 8, Options()), ((3, 17, 23), 8, Options(tile=16, block=3, levels=2, comment="é")), ((4, 9, 5), 12, Options(jp2=False, levels=0)), ((1, 1, 1), 8, Options()), ((3, 40, 33), 16, Options(levels=3, tile=20, block=4, mct=False))],
)
def test_images(shape, precision, o):
    a = np.random.default_rng(0).integers(0, 1 << precision, shape)
    data = codec.encode(a, precision, o=o)
    back, p = codec.decode(data)
    assert (back == a).all() and p == precision
    m = cs.metadata(data)
    assert m[:4] == ("JP2" if o.jp2 else "J2K", shape[2], shape[1], shape[0]) and m[-1] is None and m[-3] == o.comment


def test_lossy():
    a = (np.add.outer(np.arange(64), np.arange(64)) * 2)[None].repeat(3, 0)
    back, _ = codec.decode(codec.encode(a, 8, o=Options(reversible=False)))
    assert np.abs(back - a).max() <= 1


def test_broken_files_give_errors():
    data = codec.encode(np.zeros((1, 8, 8), int), 8)
    r = np.random.default_rng(2)
    for k in range(0, len(data)):
        assert cs.metadata(data[:k])[-1] or k > 77
    for _ in range(500):
        x = bytearray(data)
        x[r.integers(0, len(x))] = r.integers(0, 256)
        cs.metadata(bytes(x))
    for bad in (b"\0\0\0\0abcd", b"\0\0\0\1abcd\0\0\0\0\x80\0\0\0", b"\0\0\0\x07abc", b"\0\0\0\x20abcd"):
        with pytest.raises(cs.BadFile):
            list(cs.boxes(bad))


def test_headers():
    head = cs.write_header(100, 50, (64, 64), [(12, True)] * 3, 2, high_throughput=True)
    more = cs.segment(cs.COC, bytes([1, 0, 3, 4, 4, 0, 1])) + cs.segment(cs.QCC, bytes([2, 0x21, 0x48, 0x03])) + cs.segment(cs.POC, bytes([0, 0, 0, 1, 2, 3, 4]))
    more += cs.segment(cs.PLM, bytes([0, 0x81, 0x00, 0x05])) + cs.segment(cs.PPM, b"\0abc") + cs.segment(cs.CRG, bytes(12)) + cs.segment(0xFF30, b"??")
    data = head + more + cs.tile_part(0, b"body") + b"\xff\xd9"
    h = cs.main_header(data)
    assert h.tiles == (2, 1) and h.high_throughput and h.components[0] == {"precision": 12, "signed": True, "dx": 1, "dy": 1}
    assert h.styles[1]["levels"] == 3 and h.quantizations[2] == {"kind": "derived", "guard_bits": 1, "steps": [(3, 9)]}
    assert h.order_changes == [(0, 0, 1, 2, 3, 4)] and h.packet_lengths == [128, 5] and h.packed_headers == b"abc"
    assert [(t, p, b) for t, p, _, b in cs.tile_parts(data, h)] == [(0, 0, b"body")]
    for bad in (head[:20], b"\xff\x4f" + head[30:], head + cs.segment(cs.TLM, bytes([0, 0x30])) + cs.tile_part(0, b"")):
        with pytest.raises(cs.BadFile):
            cs.main_header(bad)


def test_sources(spark, tmp_path):
    from tessella.sources.datasource import CodestreamMeta
    from tessella.streaming.metadata import count_formats, stream_metadata

    for i, jp2 in enumerate((True, True, False)):
        (tmp_path / f"{i}.bin").write_bytes(codec.encode(np.zeros((1, 4, 5), int), 8, o=Options(jp2=jp2)))
    (tmp_path / "3.bin").write_bytes(b"not an image")
    got = cs.read_metadata(cs.read_files(spark, str(tmp_path))).collect()
    assert sorted(str(r.format) for r in got) == ["J2K", "JP2", "JP2", "None"] and sum(r.error is not None for r in got) == 1
    spark.dataSource.register(CodestreamMeta)
    assert sorted(str(r.format) for r in spark.read.format("codestream_meta").load(str(tmp_path)).collect()) == ["J2K", "JP2", "JP2", "None"]
    query = count_formats(stream_metadata(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("formats").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.format, r.files, r.pixels) for r in spark.table("formats").collect()} == {("JP2", 2, 40), ("J2K", 1, 20), (None, 1, None)}
    from pyspark.sql import functions as F

    windows = stream_metadata(spark, str(tmp_path)).groupBy(F.window("arrived", "1 hour")).count()  # append mode asks for the watermark
    query = windows.writeStream.outputMode("append").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert query.exception() is None


@pytest.mark.parametrize("step", [1 / 64, 1 / 16, 1 / 4, 0.3, 1.0, 1.9999])
def test_step_is_the_files(step):
    a = np.random.default_rng(1).integers(0, 256, (1, 20, 24))
    back, _ = codec.decode(codec.encode(a, 8, o=Options(reversible=False, step=step, levels=2)))
    assert np.abs(back - a).max() <= 1 + 3 * step
    field = codec.step_field(step, 8)
    assert abs(codec.field_step(field & 2047, field >> 11, 8) / step - 1) < 1 / 2048


def test_files_cut_short(spark):
    whole = codec.encode(np.arange(400).reshape(1, 20, 20) % 256, 8)
    rows = [(1, whole), (2, whole[:-40]), (3, whole[:60]), (4, b""), (5, None), (6, whole[:-2])]
    got = {r.id: r for r in codec.decode_images(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert got[1].error is None and list(got[1].data) == [i % 256 for i in range(400)]
    assert all(got[i].error and got[i].data is None for i in (2, 3, 4, 5, 6))
