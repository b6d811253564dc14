"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm._base import ship, stored, table, work_path

BLOCK_ROWS = 8192  # vectors whose sorted lists one row of the index holds
QUERY_BYTES = 32 << 20  # vectors of queries that are sent to all tasks at once
BLOCK_SCHEMA = "dim int, n int, ids binary, vectors binary, lists binary"
LONG = 2**63 - 1


def _block(rows: pa.Table) -> pa.Table:
    """All vectors of a block as one row: ids ascending, vectors by row, and for each dimension the rows in order of value."""
    ids = rows.column("vec_id").to_numpy()
    x = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype("<i4"))
    return pa.table({"dim": rows.column("dim")[:1], "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "vectors": [x.tobytes()], "lists": [lists.tobytes()]})


def threshold_search(ids: np.ndarray, x: np.ndarray, lists: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, seen: list | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best rows of one block, ties to the smaller id; ids ascend.

    Each dimension's list is read from the end where the query gains most, to a depth that grows from round to round;
    a dimension in which the query is 0 is not read. Rows that a round brings for the first time are scored, and the
    kth best score so far is the floor. The bound at a depth is the score of a row that had, in each dimension, the
    value found there: no row unseen by then beats it. Reading stops at the first depth whose bound is below the
    floor; below, not at it, as an unseen row of equal score may have the smaller id. The number of rows that a query
    saw is appended to `seen`.

    Scores are exact: products of doubles while they are whole numbers below 2^53, else of Python's own numbers, and
    beyond the limits of a long they are those limits.
    """
    n, dim = x.shape
    big = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) * int(max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0))))) * dim
    kind = np.float64 if big < 2**53 else np.int64 if big < 2**62 else object
    xk, qk = x.astype(kind), q.astype(kind)
    depths = [min(n, max(1, 256 // dim))]
    while depths[-1] < n:
        depths.append(min(n, depths[-1] + max(1, depths[-1] // 2)))
    at = np.array(depths)
    place = np.empty((2, dim, n), np.int32)  # how deep each row lies in each list, from its low end and from its high end
    np.put_along_axis(place[0], lists, np.broadcast_to(np.arange(n, dtype=np.int32), (dim, n)), axis=1)
    place[1] = n - 1 - place[0]
    place = place.reshape(2 * dim, n)
    ranked = np.take_along_axis(x, lists.T, axis=0)  # column j: values of dimension j, ascending
    low, high = ranked[at - 1].astype(kind), ranked[n - at].astype(kind)
    bounds = np.maximum(qk, 0) @ high.T + np.minimum(qk, 0) @ low.T  # by query and depth
    out: list[tuple[int, int, int]] = []
    for i, me in enumerate(q_ids.tolist()):
        read = np.flatnonzero(q[i])
        first = place[read + dim * (q[i, read] > 0)].min(axis=0) if len(read) else np.zeros(n, np.int32)
        first[np.searchsorted(ids, me) : np.searchsorted(ids, me, side="right")] = n  # a query's own rows are no candidates
        rows, scores, before = np.empty(0, np.int64), np.empty(0, kind), 0
        for j, depth in enumerate(depths):
            new = np.flatnonzero((first >= before) & (first < depth))
            before = depth
            if len(new):
                fresh = (xk @ qk[i])[new] if 2 * len(new) > n else xk[new] @ qk[i]
                if kind is object:
                    fresh = np.clip(fresh, -LONG - 1, LONG)
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, fresh])
            if len(rows) >= k and (bounds[i, j] < (np.partition(scores, len(scores) - k) if kind is not object else np.sort(scores))[len(scores) - k]):
                break
        if seen is not None:
            seen.append(len(rows))
        best = np.lexsort((rows, -scores))[:k] if kind is not object else sorted(range(len(rows)), key=lambda r: (-scores[r], rows[r]))[:k]
        out.extend((me, int(ids[rows[r]]), int(scores[r])) for r in best)
    return out


def _best(found: dict[int, list[tuple[int, int]]], more: list[tuple[int, int, int]], k: int) -> None:
    """Adds (query, candidate, score) to each query's (-score, candidate), of which the k least stay."""
    for i, c, s in more:
        found.setdefault(i, []).append((-s, c))
    for i in {r[0] for r in more}:
        found[i] = sorted(found[i])[:k]


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact k best inner products of each query among all other rows: query_id, rank, vec_id, score.

    vectors: vec_id long, vector array<long>; other columns are ignored. Rows go by hash into blocks of about
    block_rows; a block is one row of an index, written to the shared folder, that holds its vectors and their sorted
    lists. Queries are sent to all tasks in turns of about query_bytes, whatever their number; a task searches its
    blocks where they lie and sends on no more than k rows of each query. Each turn's answer is written before the next.

    A query's candidates are the rows with another vec_id and as many components; rows that repeat are candidates each.
    Queries that repeat in id and vector count once; one id with several vectors has the best of all of them. With
    fewer than k candidates all are returned. Rows with a null vec_id, a null vector or null components take no part.
    An empty table or no query gives an empty result. Scores beyond the limits of a long are those limits.
    """
    spark = vectors.sparkSession
    good = vectors.select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("ask")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull()) & (F.size("vector") > 0))
    good = stored(good.select("vec_id", "vector", F.size("vector").alias("dim"), "ask"), "topk-vectors")
    n_blocks = max(1, -(-good.count() // block_rows))
    blocks = good.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks)))
    index = stored(blocks.select("dim", "block", "vec_id", "vector").groupBy("dim", "block").applyInArrow(_block, BLOCK_SCHEMA), "topk-lists")
    asks = stored(good.where("ask").select("vec_id", "vector", "dim").distinct(), "topk-queries")
    turns = max(1, -(-(asks.agg(F.coalesce(F.sum(8 * F.col("dim") + 64), F.lit(0))).first()[0]) // query_bytes))
    paths = []
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "4")  # rows of the index are large
    try:
        for turn in range(turns):
            by_dim: dict[int, list] = {}
            for r in asks.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(turns)) == turn).collect():  # about query_bytes
                by_dim.setdefault(r.dim, []).append((r.vec_id, r.vector))
            sent = spark.sparkContext.broadcast({dim: (np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.int64)) for dim, rows in by_dim.items()})

            def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                found: dict[int, list[tuple[int, int]]] = {}
                for b in batches:
                    for r in b.to_pylist():
                        if r["dim"] in sent.value:
                            ids, x, lists = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(-1, r["dim"]), np.frombuffer(r["lists"], "<i4").reshape(r["dim"], -1)
                            _best(found, threshold_search(ids, x, lists, *sent.value[r["dim"]], k), k)
                flat = [(i, c, -s) for i, rows in found.items() for s, c in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

            near = index.mapInArrow(search, "query_id long, vec_id long, score long")
            rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
            near = near.withColumn("rank", rank).where(F.col("rank") <= k)
            paths.append(work_path(spark, "topk-found"))
            near.select("query_id", "vec_id", "score").write.parquet(paths[-1])
            sent.destroy()
    finally:
        spark.conf.set(setting, usual)
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(*paths)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))  # an id with several vectors may be in several turns
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    t = table(spark, sf_dir, "embeddings").where(e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    t = t.select("vec_id", F.transform(e, lambda v: F.floor(v.cast("double") * F.lit(256.0))).alias("vector"))
    return top_k(t, F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ship(__name__)
