"""Mixing, exact dedup and sharding against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing
from tessella.llm.exact_dedup import DigestIndex, exact_dedup, keep_first
from tessella.llm.mixing import mix_sources, mixed
from tessella.llm.sharding import assign, load_map, rebalance, save_map, shard_documents

SPACE = re.compile("[\x20\x09-\x0d]+")


def size(t):
    return len((t or "").encode().split())


def targets(by):
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, left, out = set(names), sum(by.values()), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 3 * by[s] + 1e-9]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * by[s]
            left -= 3 * by[s]
            open_.discard(s)


def test_mix(docs, rows):
    got = mix_sources(docs).collect()
    by = defaultdict(int)
    for _, t, _, s, _ in rows:
        by[s] += size(t)
    want = targets(by)
    taken = defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        assert r.source_size == by[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.size * r.repeats and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert sorted(r.size for r in got) == sorted(size(t) for _, t, *_ in rows)
    for s, target in want.items():
        assert abs(taken[s] - target) <= largest[s]
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs).collect()))


def test_mixed_rows(crowded, docs):
    want = sorted((r.doc_id or -1) for r in mix_sources(docs).collect() for _ in range(r.repeats))
    out = mixed(crowded)
    assert out.columns == crowded.columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == want


def test_mix_one_empty_source(spark):
    d = spark.createDataFrame([(1, "", "a"), (2, None, "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mix_sources(d).collect()] == [(0.0, 0), (0.0, 0)]


def groups(rows):
    out = defaultdict(list)
    for i, t, *_ in rows:
        out[SPACE.sub(" ", t or "")].append(i)
    return out


def test_dedup(docs, rows, crowded):
    want = groups(rows)
    for d in (docs, crowded.select("doc_id", "text", "digest")):
        got = exact_dedup(d).collect()
        assert len(got) == len(rows)
        sha = {hashlib.sha256(k.encode()).digest(): v for k, v in want.items()}
        for r in got:
            ids = sha[bytes(r.digest)]
            assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        assert sum(r.kept for r in got) == len(want)


def test_dedup_hot_group(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'same' else concat('t', id) end as text")
    got = exact_dedup(d).collect()
    assert sum(r.kept for r in got) == 1501 and {r.group_size for r in got} == {1, 1500}


def test_keep_first(crowded, rows):
    out = keep_first(crowded)
    assert out.columns == crowded.columns
    got = [(r.doc_id, SPACE.sub(" ", r.text or "")) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(str((min((i for i in v if i is not None), default=None), k)) for k, v in groups(rows).items())


def test_index_is_kept(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    index = DigestIndex(spark, path, 4)
    assert sum(r.kept for r in index.add(docs).collect()) > 0
    index.close()
    again = DigestIndex(spark, path)
    assert again.buckets == 4
    with pytest.raises(ValueError, match="4 buckets"):
        DigestIndex(spark, path, 8)
    second = again.add(docs.unionByName(spark.createDataFrame([(900, "brand new", "en", "s", 1)], docs.schema))).collect()
    assert [r.doc_id for r in second if r.kept] == [900]
    again.close()
    assert not [t for t in spark.catalog.listTables() if t.name in (index.name, again.name)]


def test_batch_once_more(spark, docs, empty, tmp_path):
    """A named batch gives the same answer again, dealt otherwise, and after its append was cut short."""
    seen = lambda df: sorted(str((r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept)) for r in df.collect())
    index = DigestIndex(spark, f"file://{tmp_path}/index", 3)
    first = seen(index.add(docs, "monday"))
    assert seen(index.add(docs.repartition(5), "monday")) == first and "True" in "".join(first)
    assert not any(r.kept for r in index.add(docs, "tuesday").collect()) and index.add(empty, "none").count() == 0
    rows = index.rows().count()
    assert rows == index.rows().select("digest").distinct().count() == sum("True" in x for x in first)
    half = DigestIndex(spark, f"file://{tmp_path}/half", 3)
    part = index.rows().where("batch = 'monday'").orderBy("digest").limit(rows // 2)
    half._append(spark.createDataFrame(part.collect(), part.schema), half.name)
    assert seen(half.add(docs, "monday")) == first


def test_compaction(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    index = DigestIndex(spark, path, 2, compact_after=2)
    out = [index.add(docs.where(F.col("doc_id") % 3 == i), f"b{i}") for i in range(3)]
    kept = [sum(r.kept for r in x.collect()) for x in out]  # read after the files were rewritten
    assert index.state == {"buckets": 2, "version": 1, "batches": 1} and index.rows().count() == sum(kept)
    assert len(index.rows().inputFiles()) <= 2
    assert not any(r.kept for r in DigestIndex(spark, path).add(docs.where("doc_id is not null"), "later").collect())


def test_shards(docs, rows, crowded):
    got = shard_documents(docs, shards=5).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    places = defaultdict(list)
    load = defaultdict(int)
    for r in got:
        places[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(r.size for r in got)
    rest = sorted(load.values())[:-1]  # one text is larger than a shard's share
    assert max(rest) - min(rest) <= sorted(r.size for r in got)[-2] + 8 and max(load.values()) < largest + max(rest)
    assert sorted(map(str, got)) == sorted(map(str, shard_documents(crowded, shards=5).collect()))


def test_rebalance(spark, tmp_path):
    sizes = [(v, 100 + v % 7, 1 + v % 3) for v in range(500)]
    old = assign(sizes, 5)
    new = rebalance(old, sizes, 6)
    moved = [b for a, b in zip(old, new, strict=True) if a[2] != b[2]]
    load = defaultdict(int)
    for r in new:
        load[r[2]] += r[3]
    assert {b[2] for b in moved} == {5} or len(moved) < 120
    assert max(load.values()) - min(load.values()) < 220
    save_map(spark, old, f"file://{tmp_path}/map")
    save_map(spark, new, f"file://{tmp_path}/map")
    assert load_map(spark, f"file://{tmp_path}/map").count() == 500 and load_map(spark, f"file://{tmp_path}/map", 0).first().version == 0


def test_two_runs_on_one_map(spark, docs, rows, tmp_path):
    """A second run edits the map: no row is doubled, slots stay where they may, places have no gaps, old versions stay."""
    path = f"file://{tmp_path}/slots"
    d = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(50 + id % 7 as int)) as text")
    runs = [shard_documents(x, shards=n, slots=500, map_path=path).collect() for x, n in ((d.where("doc_id < 2500"), 5), (d, 6), (d.where("doc_id % 50 = 0"), 6), (d, 6))]
    assert [len(r) for r in runs] == [2500, 3000, 60, 3000]
    for got in runs:
        places = defaultdict(list)
        for r in got:
            places[r.shard].append(r.slot)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
    first, second = ({r.vslot: r.shard for r in got} for got in runs[:2])
    moved = [v for v in first if first[v] != second[v]]
    assert set(second.values()) == set(range(6)) and len(moved) < len(first) / 3
    load = defaultdict(int)
    for r in runs[1]:
        load[r.shard] += r.size
    assert max(load.values()) < 1.05 * min(load.values())
    assert [load_map(spark, path, v).first().version for v in range(4)] == [0, 1, 2, 3]
    again = shard_documents(d, shards=6, slots=500, map_path=path).collect()
    assert sorted(map(str, again)) == sorted(map(str, runs[3])) and load_map(spark, path).first().version == 3
    assert {r.vslot: r.shard for r in load_map(spark, path, 0).collect()} == first


def test_rows_without_an_id_spread(spark):
    d = spark.range(4000).selectExpr("if(id % 2 = 0, null, id) as doc_id", "concat('text ', id) as text")
    got = shard_documents(d, shards=4).collect()
    load = Counter(r.shard for r in got)
    assert len(got) == 4000 and max(load.values()) < 1.1 * min(load.values()) and len({r.vslot for r in got if r.doc_id is None}) > 1500
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(load[s]))


def test_many_sources(spark, docs, monkeypatch):
    """Beyond the bound of the broadcast the answer is the same."""
    seen = lambda: sorted(map(str, mix_sources(docs).collect()))
    want = seen()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert seen() == want


def test_clashing_names(docs):
    names = ("mix_source", "mix_repeats", "mix_cut", "mix_hash", "mix_time", "key_id", "key_digest", "own_id", "gone_id", "own_digest", "f_source", "s_source", "part", "begin")
    wide = docs.withColumns({c: F.lit(1) for c in names})
    for stage in (mixed, keep_first):
        out = stage(wide)
        assert out.columns == wide.columns and sorted(map(str, out.select(docs.columns).collect())) == sorted(map(str, stage(docs).collect()))
    assert exact_dedup(wide).count() == mix_sources(wide).count() == shard_documents(wide).count() == docs.count()


def test_empty(empty):
    assert mix_sources(empty).count() == 0 and mixed(empty).count() == 0
    assert exact_dedup(empty).count() == 0 and keep_first(empty).count() == 0
    assert shard_documents(empty).count() == 0
