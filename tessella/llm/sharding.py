"""Sharding through fixed virtual slots and a versioned slot-to-shard map (DataFrame functions only)."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm._base import stored, table, text_or_empty, work_path

SLOTS = 8192  # virtual slots; fixed for the life of a data set
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, rows long, first long"


def _numbered(version: int, placed: list[tuple[int, int, int, int]]) -> list[tuple]:
    """(vslot, shard, bytes, rows) -> rows of the map; `first` is the place of the slot's first record in its shard."""
    used: dict[int, int] = {}
    out = []
    for vslot, shard, size, rows in sorted(placed):
        out.append((version, vslot, shard, size, rows, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + rows
    return out


def assign(sizes: list[tuple[int, int, int]], shards: int) -> list[tuple]:
    """(vslot, bytes, rows), at most SLOTS of them -> version 0 of the map: largest slot first, to the lightest shard, ties to the smaller number."""
    heap = [(0, s) for s in range(shards)]
    placed = []
    for vslot, size, rows in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
        placed.append((vslot, shard, size, rows))
    return _numbered(0, placed)


def rebalance(old: list[tuple], sizes: list[tuple[int, int, int]], shards: int) -> list[tuple]:
    """The next version of a map for new slot sizes or another shard count: slots move only from shards above the mean (or gone) to the lightest one.

    Where no shard differs from the mean by more than the largest slot none moves.
    """
    at = {vslot: shard for _, vslot, shard, *_ in old}
    by = {vslot: (size, rows) for vslot, size, rows in sizes}
    mean = sum(s for s, _ in by.values()) / shards
    now = [0] * shards
    for vslot, (size, _) in by.items():
        if at.get(vslot, shards) < shards:
            now[at[vslot]] += size
    level = all(abs(x - mean) <= max(s for s, _ in by.values()) for x in now) and all(at.get(v, shards) < shards for v in by)
    load = [0] * shards
    loose = []
    for vslot, (size, _) in sorted(by.items(), key=lambda x: (-x[1][0], x[0])):
        shard = at.get(vslot, shards)
        if level or shard < shards and load[shard] + size <= mean:
            load[shard] += size
        else:
            at[vslot] = -1
            loose.append(vslot)
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for vslot in loose:
        x, shard = heapq.heappop(heap)
        heapq.heappush(heap, (x + by[vslot][0], shard))
        at[vslot] = shard
    return _numbered(max((r[0] for r in old), default=-1) + 1, [(v, at[v], *by[v]) for v in by])


def save_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Append one version to the map at path; older versions stay readable."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    t = spark.read.schema(MAP_SCHEMA).parquet(path)
    return t.where(F.col("version") == (F.lit(version) if version is not None else t.agg(F.max("version")).first()[0]))


def latest_map(spark: SparkSession, path: str) -> list[tuple]:
    """The rows of the newest version at path, at most one for each slot; none if nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    t = spark.read.schema(MAP_SCHEMA).parquet(path)
    newest = t.agg(F.max("version")).first()[0]
    return [] if newest is None else [tuple(r) for r in load_map(spark, path, newest).collect()]


def shard_documents(docs: DataFrame, *, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every document into a shard of near equal bytes.

    docs: doc_id, text; other columns are ignored. Returns doc_id, size, text_crc32, vslot, shard, slot. A record's
    virtual slot is a hash of its doc_id; slots are summed (bytes and rows), the at most `slots` sums make the map,
    which is appended as a version under map_path; a record's shard is its slot's. If map_path holds a map, its newest
    version is rebalanced for the sums of docs, which is the whole data set as it is now, so that few slots move; slots
    without documents keep their shard while it exists. Without one, the map is made anew. A run that changes nothing
    appends no version. `slot` is its place in the shard, from 0 without gaps: where its virtual slot begins plus its
    place in that, by checksum, doc_id and size; a virtual slot is numbered in 16 parts by checksum.

    Null text counts as empty (8 bytes), null doc_id hashes as "~" and the text's checksum, so that rows without an id
    spread. Rows that repeat a doc_id share a virtual slot; rows that are equal throughout get neighbouring places in
    either order. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    checksum = F.crc32(text.cast("binary"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), checksum.cast("string")))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        checksum.alias("text_crc32"),
        (F.conv(F.substring(F.md5(id_text), 1, 8), 16, 10).cast("long") % slots).cast("int").alias("vslot"),
    )
    rows = stored(rows.withColumn("part", F.shiftright("text_crc32", 28).cast("int")), "shard-rows")
    sums = stored(rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-sums")
    path = map_path or work_path(spark, "shard-map")
    old = latest_map(spark, path)
    now = [tuple(r) for r in sums.groupBy("vslot").agg(F.sum("bytes"), F.sum("rows")).collect()]  # at most `slots`
    if old:
        seen = {vslot for vslot, *_ in now}
        now += [(vslot, 0, 0) for _, vslot, *_ in old if vslot not in seen]
    new = rebalance(old, now, shards) if old else assign(now, shards)
    if sorted(r[1:] for r in new) == sorted(r[1:] for r in old):
        version = old[0][0] if old else 0  # as it was: no new version
    else:
        save_map(spark, new, path)
        version = new[0][0]
    if not new:
        placed = spark.createDataFrame([], MAP_SCHEMA)
    else:
        placed = load_map(spark, path, version)
    before = F.coalesce(F.sum("rows").over(W.partitionBy("vslot").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("vslot", "part", before.alias("before")).join(F.broadcast(placed.select("vslot", "shard", "first")), "vslot")
    starts = starts.select("vslot", "part", "shard", (F.col("first") + F.col("before")).alias("begin"))  # at most 16 for each virtual slot
    place = F.row_number().over(W.partitionBy("vslot", "part").orderBy("text_crc32", "doc_id", "size")) - 1
    out = rows.withColumn("place", place).join(F.broadcast(starts), ["vslot", "part"])
    return out.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("begin") + F.col("place")).alias("slot"))


def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP10_SQL = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
y AS (SELECT doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size, 
      CAST(xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS INT), 2)) AS BIGINT))), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) AS BIGINT) AS text_crc32
      FROM b, tab),
x AS (SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~' || text_crc32)), 1, 8)) AS BIGINT) % 8192 AS vslot FROM y),
v AS (SELECT vslot, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n, row_number() OVER (ORDER BY sum(size) DESC, vslot) AS turn FROM x GROUP BY vslot),
lpt(turn, loads, vslot, shard) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range(24), lambda i: CAST(0 AS BIGINT)), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT v.turn, list_transform(range(24), lambda i: loads[i + 1] + CASE WHEN i = list_position(loads, list_min(loads)) - 1 THEN v.bytes ELSE 0 END), v.vslot, CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT)
  FROM lpt JOIN v ON v.turn = lpt.turn + 1),
m AS (SELECT lpt.vslot, shard, sum(v.n) OVER (PARTITION BY shard ORDER BY lpt.vslot) - v.n AS first FROM lpt JOIN v ON v.vslot = lpt.vslot)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
       CAST(first + row_number() OVER (PARTITION BY x.vslot ORDER BY text_crc32, doc_id NULLS FIRST, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM x JOIN m ON m.vslot = x.vslot
"""
