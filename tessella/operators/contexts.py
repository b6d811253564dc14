"""Coding contexts of all samples at one threshold, from their neighbours, by windows over rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def neighbours(samples: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """(keys, y, x, v) with s: significant or not; h, vv, dd: significant neighbours beside, above and below, diagonal; gh, gv: their signs, cut to -1 .. 1."""
    s = (F.abs("v") >= threshold).cast("int")
    out = samples.withColumn("s", s).withColumn("g", F.when(F.col("s") == 1, F.signum("v").cast("int")).otherwise(0))
    row, column = W.partitionBy(*keys, "y").orderBy("x"), W.partitionBy(*keys, "x").orderBy("y")

    def both(c: str, w) -> Column:
        return F.coalesce(F.lag(c).over(w), F.lit(0)) + F.coalesce(F.lead(c).over(w), F.lit(0))

    out = out.withColumns({"h": both("s", row), "gh": both("g", row)})
    out = out.withColumns({"vv": both("s", column), "dd": both("h", column), "gv": both("g", column)})
    return out.withColumns({c: F.greatest(F.least(F.col(c), F.lit(1)), F.lit(-1)) for c in ("gh", "gv")})


def zero(h: Column, v: Column, d: Column, band: str) -> Column:
    """0 to 8, for a sample not yet significant."""
    if band == "HH":
        s = F.least(h + v, F.lit(2))
        return F.when(d >= 3, 8).when(d == 2, F.when(s > 0, 7).otherwise(6)).when(d == 1, s + 3).otherwise(s).cast("int")
    if band == "HL":
        h, v = v, h
    beside = F.when(v >= 1, 7).when(d >= 1, 6).otherwise(5)
    return F.when(h == 2, 8).when(h == 1, beside).when(v == 2, 4).when(v == 1, 3).otherwise(F.least(d, F.lit(2))).cast("int")


def sign(gh: Column, gv: Column) -> tuple[Column, Column]:
    """Context 9 to 13 and whether the predicted sign is negative."""
    return F.when(gh == 0, F.abs(gv) + 9).otherwise(gh * gv + 12).cast("int"), ((gh < 0) | ((gh == 0) & (gv < 0))).cast("int")


def refine(refined: Column, near: Column) -> Column:
    """14 to 16, for a significant sample's next bit."""
    return F.when(refined, 16).when(near, 15).otherwise(14)
