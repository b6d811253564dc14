"""Metadata of image files as they arrive: an unbounded scan of a folder, one record per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.codestream import read_metadata

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_metadata(spark: SparkSession, folder: str, *, late: str = "1 hour") -> DataFrame:
    """A stream of (path, arrived, metadata); each file is read once, and `arrived`, parsed back from the key, carries a watermark."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder)
    key = F.struct("path", "modificationTime").alias("key")
    got = read_metadata(files.select(F.to_json(key).alias("key"), "content"), "key")
    parsed = F.from_json("key", "path string, modificationTime timestamp")
    out = got.withColumn("k", parsed).select(F.col("k.path").alias("path"), F.col("k.modificationTime").alias("arrived"), *[c for c in got.columns if c != "key"])
    return out.withWatermark("arrived", late)


def count_formats(stream: DataFrame) -> DataFrame:
    """Files and pixels by format, kept up to date."""
    return stream.groupBy("format").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("width") * F.col("height")).alias("pixels"))
