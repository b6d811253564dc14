"""Packets of a codestream as a generated grid, in any of the five orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDERS = {
    "lrcp": ("layer", "res", "comp", "prec"),
    "rlcp": ("res", "layer", "comp", "prec"),
    "rpcl": ("res", "prec", "comp", "layer"),
    "pcrl": ("prec", "comp", "res", "layer"),
    "cprl": ("comp", "prec", "res", "layer"),
}


def packet_grid(images: DataFrame) -> DataFrame:
    """(id, layers, resolutions, components, precincts) -> a row for each packet that exists."""
    out = images
    for name, count in (("layer", "layers"), ("res", "resolutions"), ("comp", "components"), ("prec", "precincts")):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    return out.select("id", "layer", "res", "comp", "prec")


def in_order(packets: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """With `place`, from 0: where each packet of an image stands."""
    w = W.partitionBy(*(keys or ["id"])).orderBy(*ORDERS[order])
    return packets.withColumn("place", F.row_number().over(w) - 1)
