"""Tiles, resolutions, bands and code-blocks as generated grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import ceil_div, int_div


def _counted(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def tile_grid(images: DataFrame) -> DataFrame:
    """(id, w, h, tw, th) -> one row per tile with its half-open bounds, cut at the image's edge."""
    out = images.withColumn("ntx", ceil_div(F.col("w"), F.col("tw"))).withColumn("nty", ceil_div(F.col("h"), F.col("th")))
    out = out.withColumn("tile", _counted(F.col("ntx") * F.col("nty")))
    tx, ty = F.col("tile") % F.col("ntx"), int_div(F.col("tile"), F.col("ntx")).cast("int")
    out = out.withColumn("x0", tx * F.col("tw")).withColumn("y0", ty * F.col("th"))
    return out.withColumn("x1", F.least(F.col("x0") + F.col("tw"), F.col("w"))).withColumn("y1", F.least(F.col("y0") + F.col("th"), F.col("h"))).drop("ntx", "nty")


def subsampled(df: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Bounds in a component's own samples: rounded up."""
    return df.withColumns({"x0": ceil_div(F.col("x0"), dx), "x1": ceil_div(F.col("x1"), dx), "y0": ceil_div(F.col("y0"), dy), "y1": ceil_div(F.col("y1"), dy)})


def resolutions(df: DataFrame, levels: Column) -> DataFrame:
    """One row per resolution 0 .. levels with the bounds at its scale."""
    out = df.withColumn("res", F.explode(F.sequence(F.lit(0), levels)))
    scale = F.expr("1 << (levels - res)") if "levels" in df.columns else F.shiftleft(F.lit(1), (levels - F.col("res")))
    return out.withColumns({c: ceil_div(F.col(c), scale) for c in ("x0", "y0", "x1", "y1")})


def band_bounds(df: DataFrame) -> DataFrame:
    """(w, h) -> a row for each of LL, HL, LH, HH of one transform, with its bounds in the split plane (halves rounded up, as the transform does)."""
    out = df.withColumn("band", F.explode(F.array(*[F.lit(b) for b in ("LL", "HL", "LH", "HH")])))
    hw, hh = ceil_div(F.col("w"), F.lit(2)), ceil_div(F.col("h"), F.lit(2))
    right, down = F.col("band").isin("HL", "HH"), F.col("band").isin("LH", "HH")
    return out.withColumns({"x0": F.when(right, hw).otherwise(0), "y0": F.when(down, hh).otherwise(0), "x1": F.when(right, F.col("w")).otherwise(hw), "y1": F.when(down, F.col("h")).otherwise(hh)})


def block_grid(df: DataFrame, bw: int, bh: int) -> DataFrame:
    """(w, h) -> a row per code-block of bw x bh, the last ones cut."""
    out = df.withColumn("nbx", ceil_div(F.col("w"), F.lit(bw))).withColumn("nby", ceil_div(F.col("h"), F.lit(bh)))
    out = out.withColumn("block", _counted(F.col("nbx") * F.col("nby")))
    out = out.withColumn("x0", F.col("block") % F.col("nbx") * bw).withColumn("y0", int_div(F.col("block"), F.col("nbx")).cast("int") * bh)
    return out.withColumns({"x1": F.least(F.col("x0") + bw, F.col("w")), "y1": F.least(F.col("y0") + bh, F.col("h"))}).drop("nbx", "nby")


def area(samples: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Samples in a half-open rectangle."""
    return samples.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def to_blocks(samples: DataFrame, keys: list[str], bw: int, bh: int) -> DataFrame:
    """(keys, y, x, v) -> (keys, by, bx, data): each block's samples in raster order."""
    s = samples.withColumn("by", int_div(F.col("y"), F.lit(bh)).cast("int")).withColumn("bx", int_div(F.col("x"), F.lit(bw)).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return s.groupBy(*keys, "by", "bx").agg(F.transform(ordered, lambda t: t["v"]).alias("data"), F.countDistinct("x").cast("int").alias("w"), F.countDistinct("y").cast("int").alias("h"))


def tag_tree(leaves: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, y, x, v) -> the pyramid of minima: level 0 is the leaves, each level halves both sides."""
    out = leaves.withColumn("level", F.lit(0))
    up = leaves
    for level in range(1, levels + 1):
        up = up.groupBy(*keys, int_div(F.col("y"), F.lit(2)).cast("int").alias("y"), int_div(F.col("x"), F.lit(2)).cast("int").alias("x")).agg(F.min("v").alias("v"))
        out = out.unionByName(up.withColumn("level", F.lit(level)))
    return out
