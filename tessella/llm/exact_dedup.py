"""Exact dedup against a persistent digest index, bucketed and sorted by digest (DataFrame functions only)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._base import SPACE, note, noted, removed, stored, table, text_or_empty, unused, without, work_path

HOT_SHARE = 1000  # a digest with more than 1/1000 of the rows is joined by broadcast; there are at most 1000 of those
HOT_LEAST = 500


def text_digest(name: str = "text"):
    """SHA-256 of the text with each run of white space made one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(name), f"[{SPACE}]+", " "), 256))


class DigestIndex:
    """An append-only table of the digests seen so far: digest, keep_id, batch.

    The files lie under `path` in buckets of the digest, sorted by it, so a batch meets the index in a sort-merge
    anti-join that shuffles the batch's digests only. A file beside them holds the number of buckets, the version of
    the files and how many batches they have taken; an index that is there is taken up again as it is. After
    compact_after batches the files are rewritten as a new version, one sorted file for each bucket. One batch at a
    time may be added.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, *, compact_after: int = 16):
        self.spark, self.path, self.compact_after = spark, path or work_path(spark, "digest-index"), compact_after
        state = noted(spark, f"{self.path}/_state")
        self.state = json.loads(state) if state else {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "version": 0, "batches": 0}
        if buckets not in (None, self.state["buckets"]):
            raise ValueError(f"the index has {self.state['buckets']} buckets, not {buckets}")
        self._note()
        self.name = self._table(self.state["version"])

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    def _note(self) -> None:
        note(self.spark, f"{self.path}/_state", json.dumps(self.state))

    def _table(self, version: int) -> str:
        name = f"digest_index_{uuid.uuid4().hex[:12]}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/version-{version}'"
        )
        return name

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Drop the name from the session's catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _append(self, rows: DataFrame, name: str) -> None:
        rows = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    def compact(self) -> None:
        """Rewrite all rows as the next version and only then point to it; what a lost run has left of that version goes first."""
        version = self.state["version"] + 1
        removed(self.spark, f"{self.path}/version-{version}")
        name = self._table(version)
        files = self.spark.read.schema(self.rows().schema).parquet(f"{self.path}/version-{version - 1}")  # without its buckets, or Spark takes the rows for dealt out already
        self._append(files, name)
        old, before = self.name, self.state["version"]
        self.state |= {"version": version, "batches": 1}
        self._note()
        self.name = name
        self.spark.sql(f"DROP TABLE {old}")
        removed(self.spark, f"{self.path}/version-{before}")

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate docs against the index and themselves, append the new digests, return one row per document.

        docs: doc_id, text; other columns are ignored. Returns doc_id, row, digest, keep_id, group_size, kept. Of equal
        texts, one that the index has stays; else the row with the smallest doc_id, null last; of rows that repeat a
        doc_id too, the first. group_size counts this batch's rows. An empty table adds nothing.

        batch names the batch. Digests that the index has from a batch of this name are the batch's own: if a run is
        lost after its append, or in it, the same call once more appends what is missing and gives the same answer.
        """
        batch = batch or uuid.uuid4().hex
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_digest().alias("digest"))
        d = stored(d, "dedup-digests")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first")
        groups = d.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))
        groups = stored(groups.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "n"), "dedup-groups")
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._append(new.select("digest", "keep_id", F.lit(batch).alias("batch")), self.name)
        index = self.rows().select("digest", "keep_id", (F.col("batch") == batch).alias("here"))
        found = stored(groups.select("digest", "keep_row", "n").join(index.hint("merge"), "digest"), "dedup-found")
        self.state["batches"] += 1
        self._note()
        if self.state["batches"] > self.compact_after:
            self.compact()
        most = max(HOT_LEAST, d.count() // HOT_SHARE)
        hot = F.broadcast(found.where(F.col("n") > most))
        by_hot = d.join(hot, "digest")
        by_rest = d.join(F.broadcast(found.where(F.col("n") > most).select("digest")), "digest", "left_anti").join(found.where(F.col("n") <= most), "digest")
        out = by_hot.unionByName(by_rest)
        return out.select("doc_id", "row", "digest", "keep_id", F.col("n").alias("group_size"), (F.col("here") & (F.col("row") == F.col("keep_row"))).alias("kept"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, row, digest, keep_id, group_size, kept. Without an index a new one is begun. See DigestIndex.add."""
    if index:
        return index.add(docs, batch)
    index = DigestIndex(docs.sparkSession)
    out = index.add(docs, batch)
    index.close()
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with all their columns, but of equal texts only the row with the smallest doc_id. Null ids come last; of rows that repeat both, one stays."""
    seen = exact_dedup(docs.select("doc_id", "text"))
    keys = {"id": F.col("doc_id").cast("long"), "digest": text_digest()}
    seen = seen.select(F.col("doc_id").alias("id"), "digest", "kept")
    # of rows with one id and one digest, the kept one has twins that its key would not tell from it
    by_key = stored(seen.groupBy("id", "digest").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "dedup-keys")
    out = without(docs, by_key.where(~F.col("kept")), keys)
    twins = by_key.where(F.col("kept") & (F.col("rows") > 1)).select("id", "digest")
    if twins.isEmpty():
        return out
    rest = without(out, twins, keys)
    names = {k: unused(docs, f"key_{k}") for k in keys}
    marked = out.withColumns({names[k]: c for k, c in keys.items()})
    t = twins.select(F.col("id").alias(names["id"] + "_t"), F.col("digest").alias(names["digest"] + "_t"))
    one = marked.join(t, F.col(names["id"]).eqNullSafe(F.col(names["id"] + "_t")) & (F.col(names["digest"]) == F.col(names["digest"] + "_t")), "left_semi").dropDuplicates(list(names.values()))
    return rest.unionByName(one.select(*[F.col(f"`{c}`") for c in docs.columns]))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
