"""Queries over bytes: packets, codewords, headers, coders and whole images; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.functions import codewords, coder
from tessella.operators import codec, geometry, packets
from tessella.plans.relations import EMB_PLANE, EV_SIGNAL, emb_plane, ev_signal, table
from tessella.sources import codestream as cs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f: Callable):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- packets

_GRID = """(SELECT id, layer, res, comp, prec FROM (SELECT *, CAST(unnest(range(p_size % 3 + 1)) AS INT) AS prec FROM (SELECT *, CAST(unnest(range(id % 3 + 1)) AS INT) AS comp FROM
 (SELECT *, CAST(unnest(range(id % 4 + 1)) AS INT) AS res FROM (SELECT *, CAST(unnest(range(id % 2 + 1)) AS INT) AS layer FROM (SELECT p_partkey AS id, p_size FROM part))))))"""


def _grid(spark, d):
    k = F.col("p_partkey")
    return packets.packet_grid(table(spark, d, "part").select(k.alias("id"), (k % 2 + 1).cast("int").alias("layers"), (k % 4 + 1).cast("int").alias("resolutions"), (k % 3 + 1).cast("int").alias("components"), (F.col("p_size") % 3 + 1).alias("precincts")))


def _order(name: str):
    return lambda spark, d: packets.in_order(_grid(spark, d), name)


for _name, _cols in packets.ORDERS.items():
    QUERIES[f"packet_order_{_name}"] = _order(_name)
    ORACLE_SQL[f"packet_order_{_name}"] = f"SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY {', '.join(_cols)}) - 1 AS INT) AS place FROM {_GRID}"


def _bin(e: str, width: int) -> str:
    return f"right(repeat('0', {width}) || bin({e}), {width})"


@query(
    f"SELECT o_orderkey AS id, CASE WHEN n = 1 THEN '0' WHEN n = 2 THEN '10' WHEN n <= 5 THEN '11' || {_bin('n - 3', 2)} WHEN n <= 36 THEN '1111' || {_bin('n - 6', 5)} ELSE '111111111' || {_bin('n - 37', 7)} END AS code"
    " FROM (SELECT o_orderkey, o_orderkey % 164 + 1 AS n FROM orders)"
)
def numpasses_codeword(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), codewords.pass_count(F.col("o_orderkey") % 164 + 1).alias("code"))


@query(f"SELECT o_orderkey AS id, {_bin('CASE WHEN n = 0 THEN 0 ELSE length(bin(n)) END', 5)} || CASE WHEN n = 0 THEN '' ELSE bin(n) END AS code FROM (SELECT o_orderkey, o_orderkey * 37 % 70000 AS n FROM orders)")
def length_codeword(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), codewords.length_code(F.col("o_orderkey") * 37 % 70000).alias("code"))


@query("SELECT p_partkey AS id, repeat('0', p_size) || '1' AS code FROM part")
def unary_codeword(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), codewords.unary(F.col("p_size")).alias("code"))


_VLQ = """(SELECT id, n, CASE WHEN n >= 1 << 28 THEN printf('%02X', ((n >> 28) & 127) + 128) ELSE '' END || CASE WHEN n >= 1 << 21 THEN printf('%02X', ((n >> 21) & 127) + 128) ELSE '' END
 || CASE WHEN n >= 1 << 14 THEN printf('%02X', ((n >> 14) & 127) + 128) ELSE '' END || CASE WHEN n >= 1 << 7 THEN printf('%02X', ((n >> 7) & 127) + 128) ELSE '' END || printf('%02X', n & 127) AS code
 FROM (SELECT o_orderkey AS id, o_orderkey * o_orderkey % 4000000007 AS n FROM orders))"""


def _vlq_rows(spark, d):
    n = F.col("o_orderkey") * F.col("o_orderkey") % F.lit(4000000007)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), n.alias("n")).withColumn("code", codewords.vlq_hex(F.col("n")))


@query(f"SELECT id, code FROM {_VLQ}")
def vlq_encode(spark, d):
    return _vlq_rows(spark, d).select("id", "code")


@query("SELECT o_orderkey AS id, o_orderkey * o_orderkey % 4000000007 AS n FROM orders")
def vlq_decode(spark, d):
    return _vlq_rows(spark, d).select("id", codewords.vlq_value(F.col("code")).alias("n"))


@query("SELECT id, CAST(i AS INT) AS place FROM (SELECT o_orderkey AS id, md5(CAST(o_orderkey AS VARCHAR)) AS h, unnest(range(1, 16)) AS i FROM orders) WHERE substr(h, CAST(2 * i - 1 AS INT), 2) = 'ff'")
def stuffed_byte_positions(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderkey").cast("string")).alias("h"), F.explode(F.sequence(F.lit(1), F.lit(15))).alias("place"))
    return t.where(F.substring("h", F.col("place") * 2 - 1, F.lit(2)) == "ff").select("id", "place")


# ---------------------------------------------------------------- headers

def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    """Rows, none too, as a batch."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


_PART = "(SELECT p_partkey AS id, p_size * 16 + 3 AS w, p_size * 9 + 5 AS h, p_partkey % 4 + 1 AS n, p_partkey % 16 + 1 AS p, p_partkey % 6 AS l FROM part)"


def _parts(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (F.col("p_size") * 16 + 3).alias("w"), (F.col("p_size") * 9 + 5).alias("h"), (k % 4 + 1).cast("int").alias("n"), (k % 16 + 1).cast("int").alias("p"), (k % 6).cast("int").alias("l"))


def _hex(c, digits: int):
    return F.lpad(F.hex(c), digits, "0")


def _headers(df, fn, schema: str, kinds: tuple, names: list[str]):
    """(id, w, h, n, p, l) -> what fn tells of each row, of a header that the library writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([fn(*x) for x in zip(*[c.to_pylist() for c in b.columns], strict=True)], kinds, names)

    return df.mapInArrow(run, schema)


@query(f"SELECT id, 'FF51' || printf('%04X', 38 + 3 * n) || '0000' || printf('%08X%08X', w, h) || '0000000000000000' || printf('%08X%08X', w, h) || '0000000000000000' || printf('%04X', n) || repeat(printf('%02X', p - 1) || '0101', CAST(n AS INT)) AS segment FROM {_PART}")
def siz_write(spark, d):
    def segment(k, w, h, n, p, levels):
        head = cs.write_header(w, h, (w, h), [(p, False)] * n, levels)
        return k, head[2 : 4 + int.from_bytes(head[4:6], "big")].hex().upper()

    return _headers(_parts(spark, d), segment, "id long, segment string", (pa.int64(), pa.string()), ["id", "segment"])


@query(f"SELECT id, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST(n AS INT) AS components, CAST(p AS INT) AS bits FROM {_PART}")
def siz_parse(spark, d):
    def parsed(k, w, h, n, p, levels):
        got = cs.main_header(cs.write_header(w, h, (w, h), [(p, False)] * n, levels) + cs.tile_part(0, b""))
        return k, got.width, got.height, len(got.components), got.components[-1]["precision"]

    return _headers(_parts(spark, d), parsed, "id long, width long, height long, components int, bits int", (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), ["id", "width", "height", "components", "bits"])


def _header_files(rows):
    """(id, w, h, n, p, l) -> (id, content): a codestream's header, and an empty tile-part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, w, h, n, p, levels in zip(*[c.to_pylist() for c in b.columns], strict=True):
                head = cs.write_header(w, h, (128, 96), [(p, p % 2 == 0)] * n, levels, comment=f"{w} x {h}")
                tlm = cs.segment(cs.TLM, bytes([0, 0x50]) + b"".join(bytes([i]) + (14 + i * n).to_bytes(4, "big") for i in range(levels + 1)))
                stream = head + tlm + cs.tile_part(0, b"") + b"\xff\xd9"
                out.append(cs.wrap(stream, w, h, n, p, (16, 17, 18, 12)[n - 1]) if k % 2 else stream)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "content"])

    return rows.mapInArrow(run, "id long, content binary")


@query(
    f"""SELECT id, CASE WHEN id % 2 = 1 THEN 'JP2' ELSE 'J2K' END AS format, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST(n AS INT) AS num_components, CAST(p AS INT) AS bits, p % 2 = 0 AS signed,
 CAST(CASE WHEN id % 2 = 0 THEN 0 WHEN n = 1 THEN 1 WHEN n = 2 THEN 2 WHEN n = 3 THEN 3 ELSE 5 END AS INT) AS colour_space, CAST(l + 1 AS INT) AS num_resolutions, CAST((w + 127) // 128 AS BIGINT) AS tiles_x,
 CAST((h + 95) // 96 AS BIGINT) AS tiles_y, w || ' x ' || h AS comment FROM {_PART}"""
)
def metadata_scan(spark, d):
    m = cs.read_metadata(_header_files(_parts(spark, d)), "id")
    return m.select("id", "format", "width", "height", "num_components", F.col("bits")[0].alias("bits"), F.col("signed")[0].alias("signed"), "colour_space", "num_resolutions", "tiles_x", "tiles_y", "comment")


@query(f"SELECT id, CAST(unnest([0, 12, 32, 77]) AS BIGINT) AS \"offset\", unnest(['jP  ', 'ftyp', 'jp2h', 'jp2c']) AS type FROM {_PART} WHERE id % 2 = 1")
def box_walk(spark, d):
    files = _header_files(_parts(spark, d))  # raw codestreams, every second one, have no boxes
    return cs.read_boxes(files, "id").where("type is not null").select("id", "offset", "type")


@query(f"SELECT id, CAST(i AS INT) AS tile, CAST(14 + i * n AS BIGINT) AS length FROM (SELECT *, unnest(range(l + 1)) AS i FROM {_PART})")
def tlm_explode(spark, d):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                stream = next((c for _, name, c in cs.boxes(data) if name == "jp2c"), b"") if cs.sniff(data) == "JP2" else data
                rows += [(k, t, n) for t, n in cs.main_header(stream).tile_lengths]
            yield _batch(rows, (pa.int64(), pa.int32(), pa.int64()), ["id", "tile", "length"])

    return _header_files(_parts(spark, d)).mapInArrow(run, "id long, tile int, length long")


@query(
    "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'no image area' WHEN p_partkey % 7 = 0 THEN 'number of components' WHEN p_partkey % 41 > 38 OR p_partkey % 41 = 0 THEN 'precision' END AS why FROM part"
)
def header_validate(spark, d):
    def why(k, size):
        p = k % 41 or 128  # the field holds 1 to 128
        head = cs.write_header(size % 5, 7, (128, 96), [(p, False)], 1)
        if k % 7 == 0:  # no component: the segment without its last three bytes
            head = head[:2] + cs.segment(cs.SIZ, head[6:40] + bytes(2)) + head[45:]
        try:
            cs.main_header(head + cs.tile_part(0, b""))
        except cs.BadFile as e:
            return k, str(e)
        return k, None

    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return _headers(t, why, "id long, why string", (pa.int64(), pa.string()), ["id", "why"])


_SPACES = ", ".join(f"({k}, {v[0]}, '{v[1]}')" for k, v in cs.COLOUR_SPACES.items())


@query(f"SELECT p_partkey AS id, CAST(coalesce(s.space, -1) AS INT) AS colour_space, coalesce(s.name, 'unknown') AS name FROM part LEFT JOIN (VALUES {_SPACES}) AS s(file_space, space, name) ON p_partkey % 26 = s.file_space")
def colorspace_lookup(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 26).cast("int").alias("file_space"))
    return t.join(cs.colour_spaces(spark), "file_space", "left").select("id", F.coalesce("colour_space", F.lit(cs.UNKNOWN_SPACE)).alias("colour_space"), F.coalesce("name", F.lit("unknown")).alias("name"))


_MARKERS = ", ".join(f"({k}, '{v}')" for k, v in cs.MARKERS.items())


@query(f"SELECT CAST(m AS INT) AS marker, name, name NOT IN ('SOC', 'SOD', 'EOC', 'EPH') AS has_length, name IN ('SOC', 'SOT', 'SOD', 'EOC') AS delimiter FROM (VALUES {_MARKERS}) AS t(m, name)")
def marker_names(spark, d):
    return spark.createDataFrame([(k, v, v not in cs.BARE, v in cs.DELIMITERS) for k, v in cs.MARKERS.items()], "marker int, name string, has_length boolean, delimiter boolean")


# ---------------------------------------------------------------- coders: what comes back is the input


def _symbols(spark, d):
    s = ev_signal(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    return s.select("user_id", F.transform("s", lambda t: F.abs(t["v"])).alias("v"))


def _mapped(df, fn):
    """(user_id, v array) -> (user_id, i, v) through a function of a list of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, x) for k, v in zip(*[c.to_pylist() for c in b.columns], strict=True) for i, x in enumerate(fn(v))]
            yield _batch(rows, (pa.int64(), pa.int32(), pa.int32()), ["user_id", "i", "v"])

    return df.mapInArrow(run, "user_id long, i int, v int")


@query(f"SELECT user_id, i, CAST(abs(v) AS INT) % 2 AS v FROM {EV_SIGNAL}")
def mq_identity(spark, d):
    def there_and_back(v: list[int]) -> list[int]:
        e = coder.Encoder(coder.start_states())
        for x in v:
            e.bit(x // 2 % 19, x % 2)
        back = coder.Decoder(e.flush(), coder.start_states())
        return [back.bit(x // 2 % 19) for x in v]

    return _mapped(_symbols(spark, d), there_and_back)


@query(f"SELECT user_id, i, CAST(abs(v) AS INT) % 2 AS v FROM {EV_SIGNAL}")
def raw_identity(spark, d):
    return _mapped(_symbols(spark, d), lambda v: coder.raw_decode(coder.raw_encode([x % 2 for x in v]), len(v)))


@query(f"SELECT image_id, y, x, v FROM {EMB_PLANE}")
def t1_identity(spark, d):
    blocks = geometry.to_blocks(emb_plane(spark, d), ["image_id"], 8, 8).select("image_id", "by", "bx", "w", "h", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, by, bx, w, h, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                band = ("LL", "HL", "LH", "HH")[i % 4]
                planes, code = coder.encode_block(np.array(data).reshape(h, w), band)
                a = coder.decode_block(code, planes, w, h, band)
                rows += [(i, by * 8 + y, bx * 8 + x, int(a[y, x])) for y in range(h) for x in range(w)]
            yield _batch(rows, (pa.int64(), *[pa.int32()] * 3), ["image_id", "y", "x", "v"])

    return blocks.mapInArrow(run, "image_id long, y int, x int, v int")


def _images(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("components"), "embedding")
    return e.withColumn("data", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("int") + 2048)).drop("embedding")


@query(f"SELECT image_id, y, x, v FROM {EMB_PLANE}")
def codec_lossless_identity(spark, d):
    back = codec.decode_images(codec.encode_images(_images(spark, d), 12, codec.Options(levels=2, tile=8, block=3)))
    p = back.select(F.col("id").alias("image_id"), F.posexplode("data").alias("p", "v"))
    return p.select("image_id", F.expr("int(p div 8)").alias("y"), (F.col("p") % 8).alias("x"), (F.col("v") - 2048).alias("v"))


@query("SELECT vec_id AS id, true AS near FROM embeddings")
def codec_lossy_error(spark, d):
    """Quantised with a step of 3/10 no sample is off by more than 2."""
    images = _images(spark, d)
    back = codec.decode_images(codec.encode_images(images, 12, codec.Options(levels=2, tile=8, block=3, reversible=False, step=0.3)))
    both = images.select("id", F.col("data").alias("a")).join(back.select("id", F.col("data").alias("b")), "id")
    return both.select("id", (F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))) <= 2).alias("near"))
