"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm._base import n_words, stored, table, text_or_empty, unused

BITS, LEVELS = 12, 3  # 36 bits of hash, seen 12 at a time
BROADCAST_SOURCES = 50_000  # sources whose table of thresholds may be broadcast; beyond, a shuffled join


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size) -> weight, target, repeats, budget.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    most * source_size; the excess goes to the others by weight. With sources in order of cap / weight this is one
    level: the largest (total - caps before) / (weights from here) that is not above its own cap / weight.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", "place")
    ring = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.element_at(ring, (F.col("place") - 1) % len(weights) + 1))
    t = t.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(W.partitionBy())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("level", (total - before) / after)
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(W.partitionBy()))
    target = F.when(F.col("level") >= F.col("ratio"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    t = t.withColumn("target", F.coalesce(target, F.col("cap").cast("double")))
    repeats = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    t = t.withColumn("repeats", repeats.cast("long")).withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
    return t.select("source", "source_size", "target", "repeats", "budget")


def _on_source(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    s = sources.withColumnRenamed("source", "s_source")
    if not small:  # many sources: a few may still hold most rows
        same = F.col("source").eqNullSafe(F.col("s_source"))
        n = stored(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-sources")
        most = (n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // 1000
        names = n.where(F.col("n") > most).select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"))  # fewer than 1000
        hot = lambda df, c: df.join(F.broadcast(names), (F.coalesce(c, F.lit("")) == F.col("name")) & (F.isnull(c) == F.col("none")), "left_semi")
        cold = lambda df, c: df.join(F.broadcast(names), (F.coalesce(c, F.lit("")) == F.col("name")) & (F.isnull(c) == F.col("none")), "left_anti")
        return hot(rows, "source").join(F.broadcast(hot(s, "s_source")), same).drop("s_source").unionByName(cold(rows, "source").join(cold(s, "s_source"), same).drop("s_source"))
    return rows.join(F.broadcast(s) if small else s, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")


def _hash(bits: int, levels: int) -> Column:
    """The first bits of the MD5 of doc_id; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, bits * levels // 4), 16, 10).cast("long")


def source_cuts(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), most: int = 3, bits: int = BITS, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, source, size, hash) of every document; (source, source_size, target, repeats, cut) of every source; whether the sources may be broadcast.

    A document is taken `repeats` times, and once more if its hash lies below `cut`. The cut is found without sorting:
    a histogram of words over source and the first `bits` of the hash gives the bucket where the budget ends; only
    that bucket is split by the next bits, `levels` times; the last bucket goes in if that comes nearer.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text_or_empty()).alias("size"), _hash(bits, levels).alias("hash"))
    rows = stored(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    edge = stored(source_targets(sizes, weights, most), "mix-targets")
    small = edge.count() <= BROADCAST_SOURCES
    edge = edge.withColumn("prefix", F.lit(0).cast("long")).withColumn("spent", F.lit(0).cast("long")).withColumn("last", F.lit(0).cast("long"))
    for level in range(levels):
        # rows whose hash begins with the prefix of their source's boundary bucket, summed by the next bits
        shift = bits * (levels - 1 - level)
        inside = _on_source(rows, edge.select("source", "prefix"), small).where(F.shiftright("hash", shift + bits) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        hist = _on_source(hist, edge.select("source", "budget", "spent"), small)
        upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket")) + F.col("spent")
        hist = hist.withColumn("upto", upto).where((F.col("upto") - F.col("words") <= F.col("budget")) & (F.col("budget") < F.col("upto")))
        found = hist.select(F.col("source").alias("f_source"), F.col("bucket").alias("f_prefix"), (F.col("upto") - F.col("words")).alias("f_spent"), F.col("words").alias("f_last"))
        edge = edge.join(found, F.col("source").eqNullSafe(F.col("f_source")), "left").select("source", "source_size", "target", "repeats", "budget", F.coalesce("f_prefix", F.lit(-1)).alias("prefix"), F.coalesce("f_spent", F.lit(0)).alias("spent"), F.coalesce("f_last", F.lit(0)).alias("last"))
        edge = stored(edge, f"mix-edge{level}")
    with_last = F.col("spent") + F.col("last") - F.col("budget") < F.col("budget") - F.col("spent")
    cut = F.when(F.col("prefix") < 0, 0).otherwise(F.col("prefix") + F.when(with_last, 1).otherwise(0))
    return rows, edge.select("source", "source_size", "target", "repeats", cut.alias("cut")), small


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """How often each document is taken so that each source's words come near its target.

    docs: doc_id, text, source; other columns are ignored. Returns doc_id, source, size, source_size, target, repeats,
    taken. Options as for source_cuts. Thresholds are nested: a larger budget takes a superset.

    Null text has size 0 and null source is a source of its own. The hash is of doc_id alone, so rows that repeat a
    doc_id are taken alike; reruns agree. A source of size 0 has target 0; an empty table gives an empty result. A
    bucket is summed before any shuffle, so a source that holds most rows costs no more than another. Targets are put
    in order in one task, of one narrow row for each source; beyond BROADCAST_SOURCES of them documents meet their
    source's row in a shuffled join, but for sources of more than 1/1000 of the rows, which are still broadcast.
    """
    rows, cuts, small = source_cuts(docs, **options)
    out = _on_source(rows, cuts, small)
    out = out.withColumn("repeats", F.col("repeats") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame, *, bits: int = BITS, levels: int = LEVELS, **options) -> DataFrame:
    """docs with all their columns, each row as often as the mix takes it. Edge cases as for mix_sources."""
    _, cuts, small = source_cuts(docs, bits=bits, levels=levels, **options)
    source, repeats, cut, hashed, time = (unused(docs, f"mix_{x}") for x in ("source", "repeats", "cut", "hash", "time"))
    c = cuts.select(F.col("source").alias(source), F.col("repeats").alias(repeats), F.col("cut").alias(cut))
    out = docs.withColumn(hashed, _hash(bits, levels)).join(F.broadcast(c) if small else c, F.col("source").cast("string").eqNullSafe(F.col(source)))
    times = (F.col(repeats) + F.when(F.col(hashed) < F.col(cut), 1).otherwise(0)).cast("int")
    return out.withColumn(time, F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{x}`") for x in docs.columns])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS place FROM s),
w AS (SELECT *, CAST((place - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3 AS cap FROM p),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM r),
m AS (SELECT *, max(CASE WHEN own_level <= ratio THEN own_level END) OVER () AS level FROM l),
t AS (SELECT *, CASE WHEN level < ratio THEN level * weight ELSE CAST(cap AS DOUBLE) END AS target FROM m),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS k FROM t),
h AS (SELECT source, hash, sum(size) AS words FROM d GROUP BY ALL),
c AS (SELECT h.source, h.hash, h.words, b.target - b.k * b.source_size AS budget, sum(h.words) OVER (PARTITION BY h.source ORDER BY h.hash) AS upto
      FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source, hash + CASE WHEN upto - budget < budget - (upto - words) THEN 1 ELSE 0 END AS cut
      FROM c WHERE upto - words <= budget AND budget < upto)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(d.size * (b.k + CASE WHEN d.hash < coalesce(e.cut, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
