"""Rasters and signals made from the driver's tables, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def int_floor(c: Column) -> Column:
    return F.floor(c).cast("int")


def emb_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, v): an embedding's 64 numbers as an 8 x 8 plane of thousandths."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
    return e.select("image_id", F.expr("int(p div 8)").alias("y"), (F.col("p") % 8).alias("x"), int_floor(F.col("e").cast("double") * 1000 + 0.5).alias("v"))


EMB_PLANE = """(SELECT image_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, CAST(floor(CAST(e AS DOUBLE) * 1000 + 0.5) AS INT) AS v
 FROM (SELECT vec_id AS image_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""


def ev_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, v): a user's event values in order of time, in hundredths."""
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", i.alias("i"), int_floor(F.col("value") * 100).alias("v"))


EV_SIGNAL = """(SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i,
 CAST(floor(value * 100) AS INT) AS v FROM events)"""


def li_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, g, b): an order line's quantity, discount and tax as whole numbers."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_quantity").cast("int").alias("r"), F.round(F.col("l_discount") * 100).cast("int").alias("g"), F.round(F.col("l_tax") * 100).cast("int").alias("b"))


LI_RGB = "(SELECT CAST(trunc(l_quantity) AS INT) AS r, CAST(round(l_discount * 100) AS INT) AS g, CAST(round(l_tax * 100) AS INT) AS b FROM lineitem)"


def li_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c0, c1, c2, c3): four 8-bit components of an order line."""
    t = li_rgb(spark, sf_dir)
    return t.select((F.col("r") * 5 % 256).alias("c0"), (F.col("g") * 25 % 256).alias("c1"), (F.col("b") * 31 % 256).alias("c2"), (F.col("r") * F.col("g") % 256).alias("c3"))


LI_SAMPLES = f"(SELECT CAST(r * 5 % 256 AS INT) AS c0, CAST(g * 25 % 256 AS INT) AS c1, CAST(b * 31 % 256 AS INT) AS c2, CAST(r * g % 256 AS INT) AS c3 FROM {LI_RGB})"


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, w, h, tw, th, dx, dy, levels): the sizes of an image and of its tiles, for each part."""
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (s * 16 + 3).cast("int").alias("w"), (s * 9 + 5).cast("int").alias("h"), F.lit(128).alias("tw"), F.lit(96).alias("th"), (k % 2 + 1).cast("int").alias("dx"), (k % 3 + 1).cast("int").alias("dy"), (k % 4 + 1).cast("int").alias("levels"))


GRIDS = """(SELECT p_partkey AS id, CAST(p_size * 16 + 3 AS INT) AS w, CAST(p_size * 9 + 5 AS INT) AS h, 128 AS tw, 96 AS th, CAST(p_partkey % 2 + 1 AS INT) AS dx,
 CAST(p_partkey % 3 + 1 AS INT) AS dy, CAST(p_partkey % 4 + 1 AS INT) AS levels FROM part)"""
