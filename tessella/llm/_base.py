"""What the operators share: reading tables, the shared work folder, shipping code to the workers."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and the five controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def ship(name: str) -> None:
    """Pickle a module's functions by value, so that executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python at most that many rows at once, unless the session says otherwise: documents can be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (tests) gets /tmp/checkpoints; a cluster session must name one.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file:///tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; to be called when its results have been saved."""
    removed(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def note(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over what is there."""
    at, fs = _file(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def noted(spark: SparkSession, path: str) -> str | None:
    """What note wrote at path; None if nothing is there."""
    at, fs = _file(spark, path)
    if not fs.exists(at):
        return None
    got = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(got)).decode()
    finally:
        got.close()


def removed(spark: SparkSession, path: str) -> None:
    at, fs = _file(spark, path)
    fs.delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it differ from all columns of df, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-white-space, in one pass of one expression: each run and the space after it become one letter."""
    bare = F.ltrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(bare, f"[^{SPACE}]+[{SPACE}]*", "x")).cast("long")


HOT_SHARE, HOT_LEAST = 1000, 500


def lookup(rows: DataFrame, keyed: DataFrame, key: str, rows_of: str) -> DataFrame:
    """rows joined with keyed, which has each key once and, in the column rows_of, how many rows have it.

    Keys with more than 1/1000 of the rows (500 at least) are joined by broadcast; there are fewer than 1000 of them.
    The rest meet in a shuffle, in which no key is large.
    """
    total = keyed.agg(F.coalesce(F.sum(rows_of), F.lit(0))).first()[0]
    hot = F.col(rows_of) > max(HOT_LEAST, total // HOT_SHARE)
    by_hot = rows.join(F.broadcast(keyed.where(hot)), key)
    cold = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti")
    return by_hot.unionByName(cold.join(keyed.where(~hot), key))


BROADCAST_ROWS = 500_000


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """docs but for the rows whose keys (expressions over docs) equal those of a row of dropped; nulls equal nulls.

    A list of up to BROADCAST_ROWS is broadcast, so that documents need not be shuffled; a longer one is joined.
    """
    mine, others = ({k: unused(docs, f"{side}_{k}") for k in keys} for side in ("own", "gone"))
    gone = stored(dropped.select(*[F.col(k).alias(others[k]) for k in keys]).distinct(), "gone")
    own = docs.withColumns({mine[k]: c for k, c in keys.items()})
    same = None
    for k in keys:
        one = F.col(mine[k]).eqNullSafe(F.col(others[k]))
        same = one if same is None else same & one
    small = gone.count() <= BROADCAST_ROWS
    return own.join(F.broadcast(gone) if small else gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ship(__name__)
