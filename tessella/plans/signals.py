"""Queries over signals and planes: wavelets, bands, blocks, bit planes, contexts; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tessella.functions import codewords
from tessella.operators import contexts, geometry, wavelet
from tessella.plans.relations import EMB_PLANE, EV_SIGNAL, GRIDS, emb_plane, ev_signal, grids

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f: Callable):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(c):
    return F.round(c, 6) + F.lit(0.0)


# ---------------------------------------------------------------- SQL of lifting

_UP53 = ((1, "-((p + q) >> 1)"), (0, "((p + q + 2) >> 2)"))
_DOWN53 = ((0, "-((p + q + 2) >> 2)"), (1, "((p + q) >> 1)"))
_C97 = ("-1.586134342059924", "-0.052980118572961", "0.882911075530934", "0.443506852043971")
_UP97 = tuple((1 - i % 2, f"({c})::DOUBLE * (p + q)") for i, c in enumerate(_C97))
_DOWN97 = tuple((i % 2, f"(-1 * ({c})::DOUBLE) * (p + q)") for i, c in enumerate(reversed(_C97)))


def _lifts(src: str, part: str, i: str, steps) -> str:
    for parity, update in steps:
        pq = f"(SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM {src} WINDOW w AS (PARTITION BY {part} ORDER BY {i}))"
        pq = f"(SELECT * EXCLUDE (a, b), coalesce(b, a) AS p, coalesce(a, b) AS q FROM {pq})"
        src = f"(SELECT * EXCLUDE (v, p, q), CASE WHEN {i} % 2 = {parity} AND p IS NOT NULL THEN v + {update} ELSE v END AS v FROM {pq})"
    return src


def _fwd(src: str, part: str, i: str, kind: str = "53") -> str:
    src = f"(SELECT * EXCLUDE (v), {'v' if kind == '53' else 'CAST(v AS DOUBLE)'} AS v, count(*) OVER (PARTITION BY {part}) AS n FROM {src})"
    src = _lifts(src, part, i, _UP53 if kind == "53" else _UP97)
    v = "CAST(v AS INT)" if kind == "53" else f"v * CASE WHEN n < 2 THEN 1.0::DOUBLE WHEN {i} % 2 = 0 THEN 0.812893066115961::DOUBLE ELSE 1.230174104914001::DOUBLE END"
    return f"(SELECT * EXCLUDE ({i}, n, v), CAST(CASE WHEN {i} % 2 = 0 THEN {i} // 2 ELSE (n + 1) // 2 + {i} // 2 END AS INT) AS {i}, {v} AS v FROM {src})"


def _inv(src: str, part: str, i: str, kind: str = "53") -> str:
    src = f"(SELECT *, count(*) OVER (PARTITION BY {part}) AS n FROM {src})"
    src = f"(SELECT * EXCLUDE ({i}), CAST(CASE WHEN {i} < (n + 1) // 2 THEN 2 * {i} ELSE 2 * ({i} - (n + 1) // 2) + 1 END AS INT) AS {i} FROM {src})"
    if kind == "97":
        src = f"(SELECT * EXCLUDE (v), v * CASE WHEN n < 2 THEN 1.0::DOUBLE WHEN {i} % 2 = 0 THEN 1.230174104914001::DOUBLE ELSE 0.812893066115961::DOUBLE END AS v FROM {src})"
    src = _lifts(src, part, i, _DOWN53 if kind == "53" else _DOWN97)
    return f"(SELECT * EXCLUDE (n, v), {'CAST(v AS INT)' if kind == '53' else 'v'} AS v FROM {src})"


def _fwd2(src: str, kind: str = "53") -> str:
    return _fwd(_fwd(src, "image_id, y", "x", kind), "image_id, x", "y", kind)


def _inv2(src: str, kind: str = "53") -> str:
    return _inv(_inv(src, "image_id, x", "y", kind), "image_id, y", "x", kind)


# ---------------------------------------------------------------- wavelets


@query(f"SELECT user_id, i, v FROM {_fwd(EV_SIGNAL, 'user_id', 'i')}")
def dwt53_signal(spark, d):
    return wavelet.forward_1d(ev_signal(spark, d), ["user_id"], "i")


@query(f"SELECT user_id, i, v FROM {_inv(EV_SIGNAL, 'user_id', 'i')}")
def dwt53_signal_inv(spark, d):
    return wavelet.inverse_1d(ev_signal(spark, d), ["user_id"], "i")


@query(f"SELECT user_id, i, v FROM {EV_SIGNAL}")
def dwt53_signal_identity(spark, d):
    return wavelet.inverse_1d(wavelet.forward_1d(ev_signal(spark, d), ["user_id"], "i"), ["user_id"], "i")


@query(f"SELECT user_id, i, round(v, 6) + 0.0 AS v FROM {_fwd(EV_SIGNAL, 'user_id', 'i', '97')}")
def dwt97_signal(spark, d):
    return wavelet.forward_1d(ev_signal(spark, d), ["user_id"], "i", "97").withColumn("v", _rounded(F.col("v")))


@query(f"SELECT user_id, i, round(v, 6) + 0.0 AS v FROM {_inv(_fwd(EV_SIGNAL, 'user_id', 'i', '97'), 'user_id', 'i', '97')}")
def dwt97_signal_inv(spark, d):
    return wavelet.inverse_1d(wavelet.forward_1d(ev_signal(spark, d), ["user_id"], "i", "97"), ["user_id"], "i", "97").withColumn("v", _rounded(F.col("v")))


_N = f"(SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {EV_SIGNAL})"


@query(f"SELECT user_id, CAST(CASE WHEN i % 2 = 0 THEN i // 2 ELSE (n + 1) // 2 + i // 2 END AS INT) AS i, v FROM {_N}")
def deinterleave(spark, d):
    from pyspark.sql import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy("user_id")).cast("int")
    return ev_signal(spark, d).withColumn("n", n).select("user_id", wavelet.split_index(F.col("i"), F.col("n")).alias("i"), "v")


@query(f"SELECT user_id, CAST(CASE WHEN i < (n + 1) // 2 THEN 2 * i ELSE 2 * (i - (n + 1) // 2) + 1 END AS INT) AS i, v FROM {_N}")
def interleave(spark, d):
    from pyspark.sql import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy("user_id")).cast("int")
    return ev_signal(spark, d).withColumn("n", n).select("user_id", wavelet.merge_index(F.col("i"), F.col("n")).alias("i"), "v")


@query(f"SELECT image_id, y, x, v FROM {_fwd2(EMB_PLANE)}")
def dwt53_plane(spark, d):
    return wavelet.forward_2d(emb_plane(spark, d), ["image_id"])


@query(f"SELECT image_id, y, x, v FROM {_inv2(EMB_PLANE)}")
def dwt53_plane_inv(spark, d):
    return wavelet.inverse_2d(emb_plane(spark, d), ["image_id"])


@query(f"SELECT image_id, y, x, round(v, 6) + 0.0 AS v FROM {_fwd2(EMB_PLANE, '97')}")
def dwt97_plane(spark, d):
    return wavelet.forward_2d(emb_plane(spark, d), ["image_id"], "97").withColumn("v", _rounded(F.col("v")))


@query(f"SELECT image_id, y, x, CAST(v AS DOUBLE) AS v FROM {EMB_PLANE}")
def dwt97_plane_identity(spark, d):
    out = wavelet.inverse_2d(wavelet.forward_2d(emb_plane(spark, d), ["image_id"], "97"), ["image_id"], "97")
    return out.withColumn("v", _rounded(F.col("v")))


def _levels() -> str:
    """Three levels, one step of one level after another."""
    steps, low = [f"p AS MATERIALIZED (SELECT image_id, y, x, v FROM {EMB_PLANE})"], "p"
    for i, n in enumerate((8, 4, 2)):
        if i:
            steps.append(f"low{i} AS MATERIALIZED (SELECT * FROM l{i - 1} WHERE x < {n} AND y < {n})")
            low = f"low{i}"
        steps.append(f"r{i} AS MATERIALIZED (SELECT image_id, y, x, v FROM {_fwd(low, 'image_id, y', 'x')})")
        steps.append(f"l{i} AS MATERIALIZED (SELECT image_id, y, x, v FROM {_fwd(f'r{i}', 'image_id, x', 'y')})")
    return f"WITH {', '.join(steps)} SELECT * FROM l0 WHERE x >= 4 OR y >= 4 UNION ALL SELECT * FROM l1 WHERE x >= 2 OR y >= 2 UNION ALL SELECT * FROM l2"


@query(_levels())
def dwt53_multilevel(spark, d):
    return wavelet.decompose(emb_plane(spark, d), ["image_id"], 8, 8, 3)


@query(f"SELECT image_id, y, x, v FROM {EMB_PLANE}")
def dwt53_multilevel_identity(spark, d):
    p = emb_plane(spark, d)
    return wavelet.reconstruct(wavelet.decompose(p, ["image_id"], 8, 8, 3), ["image_id"], 8, 8, 3)


def _planes(spark, d):
    """Planes as arrays, for the form that shuffles nothing."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("int")).alias("data"))


def _exploded(df):
    p = df.select(F.col("id").alias("image_id"), F.posexplode("data").alias("p", "v"))
    return p.select("image_id", F.expr("int(p div 8)").alias("y"), (F.col("p") % 8).alias("x"), "v")


@query("")
def dwt53_arrays(spark, d):
    return _exploded(wavelet.decompose_arrays(_planes(spark, d), 8, 8, 3))


@query(f"SELECT image_id, y, x, round(v, 6) + 0.0 AS v FROM {_fwd2(EMB_PLANE, '97')}")
def dwt97_arrays(spark, d):
    return _exploded(wavelet.decompose_arrays(_planes(spark, d), 8, 8, 1, "97")).withColumn("v", _rounded(F.col("v")))


ORACLE_SQL["dwt53_arrays"] = ORACLE_SQL["dwt53_multilevel"]


@query(f"SELECT image_id, y, x, v FROM {_fwd2(EMB_PLANE)} WHERE x < 4 AND y < 4")
def reduce_resolution(spark, d):
    p = wavelet.decompose(emb_plane(spark, d), ["image_id"], 8, 8, 3)
    return wavelet.reconstruct(p, ["image_id"], 8, 8, 3, stop=1)


# ---------------------------------------------------------------- geometry

_TILES = f"""(SELECT *, least(x0 + tw, w) AS x1, least(y0 + th, h) AS y1 FROM (SELECT *, CAST(tile % ntx * tw AS INT) AS x0, CAST(tile // ntx * th AS INT) AS y0 FROM
 (SELECT *, CAST(unnest(range(ntx * nty)) AS INT) AS tile FROM (SELECT *, (w + tw - 1) // tw AS ntx, (h + th - 1) // th AS nty FROM {GRIDS}))))"""


@query(f"SELECT id, tile, x0, y0, x1, y1 FROM {_TILES}")
def tile_grid(spark, d):
    return geometry.tile_grid(grids(spark, d)).select("id", "tile", "x0", "y0", "x1", "y1")


@query(f"SELECT id, tile, CAST((x0 + dx - 1) // dx AS INT) AS x0, CAST((y0 + dy - 1) // dy AS INT) AS y0, CAST((x1 + dx - 1) // dx AS INT) AS x1, CAST((y1 + dy - 1) // dy AS INT) AS y1 FROM {_TILES}")
def component_subsample(spark, d):
    return geometry.subsampled(geometry.tile_grid(grids(spark, d)), F.col("dx"), F.col("dy")).select("id", "tile", "x0", "y0", "x1", "y1")


_RES = f"(SELECT *, CAST(1 << (levels - res) AS INT) AS s FROM (SELECT *, CAST(unnest(range(levels + 1)) AS INT) AS res FROM {_TILES}))"


@query(f"SELECT id, tile, res, " + ", ".join(f"CAST(({c} + s - 1) // s AS INT) AS {c}" for c in ("x0", "y0", "x1", "y1")) + f" FROM {_RES}")
def resolution_bounds(spark, d):
    return geometry.resolutions(geometry.tile_grid(grids(spark, d)), F.col("levels")).select("id", "tile", "res", "x0", "y0", "x1", "y1")


@query(
    f"""SELECT id, band, CAST(CASE WHEN band IN ('HL','HH') THEN (w + 1) // 2 ELSE 0 END AS INT) AS x0, CAST(CASE WHEN band IN ('LH','HH') THEN (h + 1) // 2 ELSE 0 END AS INT) AS y0,
 CAST(CASE WHEN band IN ('HL','HH') THEN w ELSE (w + 1) // 2 END AS INT) AS x1, CAST(CASE WHEN band IN ('LH','HH') THEN h ELSE (h + 1) // 2 END AS INT) AS y1
 FROM {GRIDS}, (VALUES ('LL'), ('HL'), ('LH'), ('HH')) AS b(band)"""
)
def subband_bounds(spark, d):
    return geometry.band_bounds(grids(spark, d)).select("id", "band", "x0", "y0", "x1", "y1")


@query(
    f"""SELECT id, block, x0, y0, CAST(least(x0 + 64, w) AS INT) AS x1, CAST(least(y0 + 64, h) AS INT) AS y1 FROM (SELECT *, CAST(block % nx * 64 AS INT) AS x0, CAST(block // nx * 64 AS INT) AS y0 FROM
 (SELECT *, CAST(unnest(range(nx * ny)) AS INT) AS block FROM (SELECT *, (w + 63) // 64 AS nx, (h + 63) // 64 AS ny FROM {GRIDS})))"""
)
def block_grid(spark, d):
    return geometry.block_grid(grids(spark, d), 64, 64).select("id", "block", "x0", "y0", "x1", "y1")


@query(f"SELECT image_id, y, x, v FROM {EMB_PLANE} WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")
def area_of_interest(spark, d):
    return geometry.area(emb_plane(spark, d), 2, 1, 6, 7)


# ---------------------------------------------------------------- blocks and contexts

_COEF = f"(SELECT image_id, y, x, v FROM {_fwd2(EMB_PLANE)})"


def _coefficients(spark, d):
    return wavelet.forward_2d(emb_plane(spark, d), ["image_id"])


@query(f"SELECT image_id, CAST(y // 4 AS INT) AS \"by\", CAST(x // 4 AS INT) AS bx, CAST(max(abs(v)) AS INT) AS most, CAST(CASE WHEN max(abs(v)) = 0 THEN 0 ELSE length(bin(max(abs(v)))) END AS INT) AS planes FROM {_COEF} GROUP BY 1, 2, 3")
def block_bitplanes(spark, d):
    c = _coefficients(spark, d).groupBy("image_id", F.expr("int(y div 4)").alias("by"), F.expr("int(x div 4)").alias("bx")).agg(F.max(F.abs("v")).alias("most"))
    return c.withColumn("planes", codewords.bit_length(F.col("most")))


@query(f"SELECT image_id, CAST(y // 2 AS INT) AS \"by\", CAST(x // 2 AS INT) AS bx FROM {_COEF} GROUP BY 1, 2, 3 HAVING max(abs(v)) > 8")
def zero_block_filter(spark, d):
    c = _coefficients(spark, d).groupBy("image_id", F.expr("int(y div 2)").alias("by"), F.expr("int(x div 2)").alias("bx")).agg(F.max(F.abs("v")).alias("most"))
    return c.where("most > 8").drop("most")


@query(f"SELECT image_id, y, x, CAST(p AS INT) AS plane, CAST((abs(v) >> p) & 1 AS INT) AS bit FROM {EMB_PLANE}, range(0, 10) AS r(p)")
def bitplane_explode(spark, d):
    p = emb_plane(spark, d).withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return p.select("image_id", "y", "x", "plane", F.expr("(abs(v) >> plane) & 1").alias("bit"))


_LEAF = f"(SELECT image_id, y, x, v FROM {EMB_PLANE})"


@query(
    f"WITH l AS (SELECT * FROM {_LEAF}) SELECT image_id, y, x, v, 0 AS level FROM l UNION ALL SELECT image_id, CAST(y // 2 AS INT), CAST(x // 2 AS INT), CAST(min(v) AS INT), 1 FROM l GROUP BY 1, 2, 3"
    " UNION ALL SELECT image_id, CAST(y // 4 AS INT), CAST(x // 4 AS INT), CAST(min(v) AS INT), 2 FROM l GROUP BY 1, 2, 3"
)
def tag_tree_pyramid(spark, d):
    return geometry.tag_tree(emb_plane(spark, d), ["image_id"], 2)


_SIG = f"(SELECT image_id, y, x, CAST(abs(v) >= 64 AS INT) AS s, CASE WHEN abs(v) >= 64 THEN sign(v) ELSE 0 END AS g, v FROM {EMB_PLANE})"
_ROW = f"(SELECT *, coalesce(lag(s) OVER w, 0) AS s_l, coalesce(lead(s) OVER w, 0) AS s_r, coalesce(lag(g) OVER w, 0) AS g_l, coalesce(lead(g) OVER w, 0) AS g_r FROM {_SIG} WINDOW w AS (PARTITION BY image_id, y ORDER BY x))"
_NEIGHBOURS = f"""(SELECT image_id, y, x, v, s, s_l + s_r AS h, coalesce(lag(s) OVER w, 0) + coalesce(lead(s) OVER w, 0) AS vv,
 coalesce(lag(s_l + s_r) OVER w, 0) + coalesce(lead(s_l + s_r) OVER w, 0) AS dd, least(greatest(g_l + g_r, -1), 1) AS gh, least(greatest(coalesce(lag(g) OVER w, 0) + coalesce(lead(g) OVER w, 0), -1), 1) AS gv
 FROM {_ROW} WINDOW w AS (PARTITION BY image_id, x ORDER BY y))"""


@query(
    f"""SELECT image_id, y, x, CAST(CASE WHEN h = 2 THEN 8 WHEN h = 1 AND vv >= 1 THEN 7 WHEN h = 1 AND dd >= 1 THEN 6 WHEN h = 1 THEN 5 WHEN vv = 2 THEN 4 WHEN vv = 1 THEN 3 WHEN dd >= 2 THEN 2 ELSE dd END AS INT) AS ll,
 CAST(CASE WHEN vv = 2 THEN 8 WHEN vv = 1 AND h >= 1 THEN 7 WHEN vv = 1 AND dd >= 1 THEN 6 WHEN vv = 1 THEN 5 WHEN h = 2 THEN 4 WHEN h = 1 THEN 3 WHEN dd >= 2 THEN 2 ELSE dd END AS INT) AS hl,
 CAST(CASE WHEN dd >= 3 THEN 8 WHEN dd = 2 THEN CASE WHEN h + vv >= 1 THEN 7 ELSE 6 END WHEN dd = 1 THEN 3 + least(h + vv, 2) ELSE least(h + vv, 2) END AS INT) AS hh FROM {_NEIGHBOURS}"""
)
def zc_context_snapshot(spark, d):
    n = contexts.neighbours(emb_plane(spark, d), ["image_id"], 64)
    return n.select("image_id", "y", "x", *[contexts.zero(F.col("h"), F.col("vv"), F.col("dd"), b).alias(b.lower()) for b in ("LL", "HL", "HH")])


@query(
    f"""SELECT image_id, y, x, CAST(CASE WHEN gh = 0 THEN 9 + abs(gv) ELSE 12 + gh * gv END AS INT) AS context, CAST(gh < 0 OR (gh = 0 AND gv < 0) AS INT) AS flip FROM {_NEIGHBOURS}"""
)
def sc_context_snapshot(spark, d):
    cx, flip = contexts.sign(F.col("gh"), F.col("gv"))
    return contexts.neighbours(emb_plane(spark, d), ["image_id"], 64).select("image_id", "y", "x", cx.alias("context"), flip.alias("flip"))


@query(f"SELECT image_id, y, x, CAST(CASE WHEN abs(v) >= 128 THEN 16 WHEN h + vv + dd > 0 THEN 15 ELSE 14 END AS INT) AS context FROM {_NEIGHBOURS} WHERE s = 1")
def mr_context_snapshot(spark, d):
    n = contexts.neighbours(emb_plane(spark, d), ["image_id"], 64).where("s = 1")
    return n.select("image_id", "y", "x", contexts.refine(F.abs("v") >= 128, F.col("h") + F.col("vv") + F.col("dd") > 0).alias("context"))
