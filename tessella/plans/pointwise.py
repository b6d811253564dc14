"""Queries over single samples: shifts, component and colour transforms, quantiser; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import color, pointwise
from tessella.plans.relations import EMB_PLANE, LI_RGB, LI_SAMPLES, emb_plane, li_rgb, li_samples

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(*cols):
    return [(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in cols]


@query(f"SELECT image_id, y, x, CAST(v - 1024 AS INT) AS v FROM {EMB_PLANE}")
def level_shift(spark, d):
    return emb_plane(spark, d).withColumn("v", pointwise.level_shift(F.col("v"), 11))


@query(f"SELECT image_id, y, x, CAST(v + 1024 AS INT) AS v FROM {EMB_PLANE}")
def level_shift_inv(spark, d):
    return emb_plane(spark, d).withColumn("v", pointwise.level_unshift(F.col("v"), 11))


@query(f"SELECT CAST((r + 2 * g + b) >> 2 AS INT) AS y, CAST(b - g AS INT) AS u, CAST(r - g AS INT) AS v FROM {LI_RGB}")
def rct_fwd(spark, d):
    y, u, v = pointwise.rct_forward(*[F.col(c) for c in "rgb"])
    return li_rgb(spark, d).select(y.alias("y"), u.alias("u"), v.alias("v"))


@query(f"SELECT CAST(b + r - ((g + b) >> 2) AS INT) AS r, CAST(r - ((g + b) >> 2) AS INT) AS g, CAST(g + r - ((g + b) >> 2) AS INT) AS b FROM {LI_RGB}")
def rct_inv(spark, d):
    r, g, b = pointwise.rct_inverse(*[F.col(c) for c in "rgb"])
    return li_rgb(spark, d).select(r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"SELECT r, g, b FROM {LI_RGB}")
def rct_identity(spark, d):
    y, u, v = pointwise.rct_forward(*[F.col(c) for c in "rgb"])
    r, g, b = pointwise.rct_inverse(F.col("y"), F.col("u"), F.col("v"))
    return li_rgb(spark, d).select(y.alias("y"), u.alias("u"), v.alias("v")).select(r.alias("r"), g.alias("g"), b.alias("b"))


@query(
    f"SELECT round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) + 0.0 AS y, round(-0.16875::DOUBLE * r - 0.33126::DOUBLE * g + 0.5::DOUBLE * b, 6) + 0.0 AS cb,"
    f" round(0.5::DOUBLE * r - 0.41869::DOUBLE * g - 0.08131::DOUBLE * b, 6) + 0.0 AS cr FROM {LI_RGB}"
)
def ict_fwd(spark, d):
    return li_rgb(spark, d).select(*_rounded(*zip(("y", "cb", "cr"), pointwise.matrix(pointwise.ICT_FORWARD, [F.col(c) for c in "rgb"]), strict=True)))


@query(
    f"SELECT round(r + 1.402::DOUBLE * b, 6) + 0.0 AS r, round(r - 0.34413::DOUBLE * g - 0.71414::DOUBLE * b, 6) + 0.0 AS g, round(r + 1.772::DOUBLE * g, 6) + 0.0 AS b"
    f" FROM (SELECT CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM {LI_RGB})"
)
def ict_inv(spark, d):
    return li_rgb(spark, d).select(*_rounded(*zip("rgb", pointwise.matrix(pointwise.ICT_INVERSE, [F.col(c) for c in "rgb"]), strict=True)))


CUSTOM = ((0.5, 0.25, 0.25), (1.0, -1.0, 0.0), (-0.5, -0.5, 1.0))


@query(
    f"""WITH s AS (SELECT row_number() OVER () AS id, * FROM {LI_RGB}), m(o, i, c) AS (VALUES (0,0,0.5::DOUBLE),(0,1,0.25),(0,2,0.25),(1,0,1.0),(1,1,-1.0),(1,2,0.0),(2,0,-0.5),(2,1,-0.5),(2,2,1.0)),
t AS (SELECT s.id, m.o, sum(m.c * CASE m.i WHEN 0 THEN s.r WHEN 1 THEN s.g ELSE s.b END) AS v FROM s, m GROUP BY ALL)
SELECT round(max(CASE o WHEN 0 THEN v END), 6) + 0.0 AS c0, round(max(CASE o WHEN 1 THEN v END), 6) + 0.0 AS c1, round(max(CASE o WHEN 2 THEN v END), 6) + 0.0 AS c2 FROM t GROUP BY id"""
)
def custom_mct_apply(spark, d):
    return li_rgb(spark, d).select(*_rounded(*zip(("c0", "c1", "c2"), pointwise.matrix(CUSTOM, [F.col(c) for c in "rgb"]), strict=True)))


@query(f"SELECT round(CAST(r AS DOUBLE), 6) + 0.0 AS r, round(CAST(g AS DOUBLE), 6) + 0.0 AS g, round(CAST(b AS DOUBLE), 6) + 0.0 AS b FROM {LI_RGB}")
def custom_mct_identity(spark, d):
    import numpy as np

    there = li_rgb(spark, d).select(*[c.alias(f"c{i}") for i, c in enumerate(pointwise.matrix(CUSTOM, [F.col(c) for c in "rgb"]))])
    back = pointwise.matrix(np.linalg.inv(np.array(CUSTOM)).tolist(), [F.col(f"c{i}") for i in range(3)])
    return there.select(*_rounded(*zip("rgb", back, strict=True)))


@query(f"SELECT image_id, y, x, CAST(least(greatest(v, -64), 63) AS INT) AS s7, CAST(least(greatest(v, 0), 127) AS INT) AS u7 FROM {EMB_PLANE}")
def clamp_precision(spark, d):
    return emb_plane(spark, d).select("image_id", "y", "x", pointwise.clamp_precision(F.col("v"), 7, True).alias("s7"), pointwise.clamp_precision(F.col("v"), 7, False).alias("u7"))


@query(f"SELECT CAST((c0::BIGINT * 65535) // 255 AS INT) AS c0, CAST((c1::BIGINT * 4095) // 255 AS INT) AS c1, CAST((c2::BIGINT * 15) // 255 AS INT) AS c2 FROM {LI_SAMPLES}")
def rescale_precision(spark, d):
    return li_samples(spark, d).select(*[pointwise.rescale(F.col(c), 8, p).alias(c) for c, p in (("c0", 16), ("c1", 12), ("c2", 4))])


_HALVES = f"(SELECT image_id, y, x, CAST(v AS DOUBLE) / 8 AS f FROM {EMB_PLANE})"


@query(f"SELECT image_id, y, x, CAST(CASE WHEN f >= 0 THEN trunc(f + 0.5) ELSE trunc(f - 0.5) END AS INT) AS v FROM {_HALVES}")
def round_half_away(spark, d):
    return emb_plane(spark, d).select("image_id", "y", "x", pointwise.round_half_away(F.col("v") / F.lit(8.0)).alias("v"))


@query(f"SELECT image_id, y, x, CAST(CASE WHEN f >= 0 THEN floor(f * 2.0::DOUBLE + 0.5) ELSE ceil(f * 2.0::DOUBLE - 0.5) END AS INT) AS q FROM {_HALVES}")
def quantize(spark, d):
    return emb_plane(spark, d).select("image_id", "y", "x", pointwise.quantize(F.col("v") / F.lit(8.0), 0.5).alias("q"))


@query(f"SELECT image_id, y, x, round(v * 0.125::DOUBLE, 6) + 0.0 AS v FROM {EMB_PLANE}")
def dequantize(spark, d):
    return emb_plane(spark, d).select("image_id", "y", "x", *_rounded(("v", pointwise.dequantize(F.col("v"), 0.125))))


@query("SELECT p_partkey AS id, round((1 + (p_partkey % 2048) / 2048.0::DOUBLE) * pow(2.0::DOUBLE, 31 - p_size % 32), 6) AS step FROM part")
def step_size_value(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet")
    return t.select(F.col("p_partkey").alias("id"), *_rounded(("step", pointwise.step_value(F.col("p_partkey") % 2048, F.col("p_size") % 32))))


def _whole(e: str) -> str:
    return f"CAST(CASE WHEN {e} < 0 THEN 0 WHEN {e} > 255 THEN 255 ELSE trunc({e} + 0.5) END AS INT)"


def _colour_sql(r: str, g: str, b: str, source: str | None = None) -> str:
    base = source or f"(SELECT CAST(c0 AS DOUBLE) AS a, CAST(c1 AS DOUBLE) AS b, CAST(c2 AS DOUBLE) AS c, CAST(c3 AS DOUBLE) AS k FROM {LI_SAMPLES})"
    return f"SELECT {_whole('r')} AS r, {_whole('g')} AS g, {_whole('bl')} AS b FROM (SELECT {r} AS r, {g} AS g, {b} AS bl FROM {base})"


def _num(x: float) -> str:
    return f"{x!r}::DOUBLE"


_709 = _colour_sql(f"a + {_num(1.5748)} * (c - 128)", f"a - {_num(0.1873)} * (b - 128) - {_num(0.4681)} * (c - 128)", f"a + {_num(1.8556)} * (b - 128)")
_601 = _colour_sql(f"a + {_num(1.402)} * (c - 128)", f"a - {_num(0.344136)} * (b - 128) - {_num(0.714136)} * (c - 128)", f"a + {_num(1.772)} * (b - 128)")
_PH = [f"(a + {_num(1.3584)} * (c - 156))", f"(a - {_num(0.4302)} * (b - 156) - {_num(0.7915)} * (c - 156))", f"(a + {_num(2.2179)} * (b - 156))"]


def _gamma(e: str) -> str:
    return f"(CASE WHEN {e} <= 0.0031308::DOUBLE THEN {e} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({e}, 1.0::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE END)"


def _unlab(e: str) -> str:
    return f"(CASE WHEN {e} > 6.0::DOUBLE / 29.0::DOUBLE THEN {e} * {e} * {e} ELSE 3 * (6.0::DOUBLE / 29) * (6.0::DOUBLE / 29) * ({e} - 4.0::DOUBLE / 29) END)"


_XYZ = [[3.2404542, -1.5371385, -0.4985314], [-0.9692660, 1.8760108, 0.0415560], [0.0556434, -0.2040259, 1.0572252]]
_LINEAR = ", ".join(f"{_num(m[0])} * x + {_num(m[1])} * y + {_num(m[2])} * z AS l{i}" for i, m in enumerate(_XYZ))
_SAMPLES = f"(SELECT CAST(c0 AS DOUBLE) AS a, CAST(c1 AS DOUBLE) AS b, CAST(c2 AS DOUBLE) AS c FROM {LI_SAMPLES})"
_LAB_F = f"(SELECT (a / 255 * 100 + 16) / 116 AS fy, (b / 255 * 255 - 128) / 500 AS da, (c / 255 * 255 - 128) / 200 AS db FROM {_SAMPLES})"
_LAB_XYZ = f"(SELECT {_num(0.96422)} * {_unlab('(da + fy)')} AS x, {_unlab('fy')} AS y, {_num(0.82521)} * {_unlab('(fy - db)')} AS z FROM {_LAB_F})"
_LAB = _colour_sql(*[f"{_gamma(f'l{i}')} * 255" for i in range(3)], source=f"(SELECT {_LINEAR} FROM {_LAB_XYZ})")
_ROMM_P = f"(SELECT pow(a / 255, 1.8::DOUBLE) AS a, pow(b / 255, 1.8::DOUBLE) AS b, pow(c / 255, 1.8::DOUBLE) AS c FROM {_SAMPLES})"
_ROMM_XYZ = f"(SELECT {_num(0.7977)} * a + {_num(0.1352)} * b + {_num(0.0313)} * c AS x, {_num(0.288)} * a + {_num(0.7119)} * b + {_num(0.0001)} * c AS y, {_num(0.8249)} * c AS z FROM {_ROMM_P})"
_CUT = "least(greatest({0}, 0.0::DOUBLE), 1.0::DOUBLE)"
_ROMM = _colour_sql(*[f"{_gamma(_CUT.format(f'l{i}'))} * 255" for i in range(3)], source=f"(SELECT {_LINEAR} FROM {_ROMM_XYZ})")
_ESRGB = _colour_sql(*[f"{_gamma(_CUT.format(f'({c} / 255 * 1.25::DOUBLE - 0.25::DOUBLE)'))} * 255" for c in "abc"])
_CMYK = _colour_sql(*[f"(1 - {c} / 255) * (1 - k / 255) * 255" for c in "abc"])
_COLOUR_SQL = {
    "sycc": _709, "ypbpr": _709, "eycc": _709, "bt601": _601, "photoycc": _colour_sql(*_PH), "cmy": _colour_sql("255 - a", "255 - b", "255 - c"), "cmyk": _CMYK,
    "ycck": _colour_sql(*[f"{e} * (1 - k / 255)" for e in _PH]), "lab": _LAB, "jab": _LAB, "esrgb": _ESRGB, "romm": _ROMM,
}


def _colour(space: str):
    def run(spark, d):
        r, g, b = color.to_srgb(space, [F.col(f"c{i}") for i in range(4)], 8)
        return li_samples(spark, d).select(r.alias("r"), g.alias("g"), b.alias("b"))

    return run


for _space, _sql in _COLOUR_SQL.items():
    QUERIES[f"color_{_space}"], ORACLE_SQL[f"color_{_space}"] = _colour(_space), _sql


@query(f"SELECT round(CAST(c0 AS DOUBLE) / 255, 6) + 0.0 AS v FROM {LI_SAMPLES}")
def gamma_roundtrip(spark, d):
    return li_samples(spark, d).select(*_rounded(("v", color.gamma(color.gamma_inverse(F.col("c0") / F.lit(255.0))))))
