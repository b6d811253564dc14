"""Exact top-k and the n-gram join against brute force."""

import random
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import topk
from tessella.llm import ngram_join
from tessella.llm.ngram_join import Near, PartEnum, candidate_lists, components, keep_one, ngram_components, similar, sketch
from tessella.llm.topk import op1_top_k, top_k


def best(vectors, asks, k):
    """Rows that repeat are candidates each; queries that repeat count once."""
    out = []
    for q in {a for a, _ in asks}:
        found = [(-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(x, y)))), v) for x in {tuple(b) for a, b in asks if a == q} for v, y in vectors if v != q and len(y) == len(x)]
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "low", "block"), [(300, 6, -40, 64), (200, 2, -3, 32), (4, 3, -9, 8), (600, 1, -50, 700), (500, 3, 0, 900)])
def test_top_k(spark, n, dim, low, block):
    r = random.Random(n)
    rows = [(i, [r.randint(low, 40) for _ in range(dim)]) for i in range(n)]
    rows += [rows[1], rows[1], rows[0], (7, [9] * dim), (n, None), (n + 1, [1, None]), (None, [1] * dim), (n + 2, [5, 5, 5, 5, 5, 5, 5]), (n + 3, []), (14 * n, [0] * dim)]
    d = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumns({c: F.lit(1) for c in ("dim", "ask", "block", "rank", "score", "query_id")})
    got = top_k(d, F.col("vec_id") % 7 == 0, block_rows=block, query_bytes=1000)
    good = [(i, v) for i, v in rows if i is not None and v and None not in v]
    assert sorted(tuple(x) for x in got.collect()) == best(good, [x for x in good if x[0] % 7 == 0], 5)


@pytest.mark.parametrize("size", [2**20, 2**28, 2**40, 2**62])
def test_large_values(spark, size):
    r = random.Random(size)
    rows = [(i, [r.randint(-size, size) for _ in range(3)]) for i in range(120)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") % 7 == 0, block_rows=50)
    assert sorted(tuple(x) for x in got.collect()) == best(rows, [x for x in rows if x[0] % 7 == 0], 5)


def test_top_k_stops_early():
    """On skewed data the bound falls before all rows are seen, and the answer is still exact; on dense data of like weight it falls late, and is exact too."""
    r = np.random.default_rng(0)
    ids = np.arange(4000)
    for x, most in (((r.exponential(20, (4000, 2)) ** 2).astype(np.int64), 1500), (r.integers(-256, 256, (4000, 24)), 4000)):
        lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype("<i4"))
        q = r.integers(1, 9, (3, x.shape[1]))
        seen = []
        got = topk.threshold_search(ids, x, lists, np.array([0, 1, 2]), q, 5, seen)
        for i in range(3):
            s = x @ q[i]
            s[i] = -(10**9)
            assert [g[1] for g in got if g[0] == i] == np.lexsort((ids, -s))[:5].tolist()
        assert len(seen) == 3 and max(seen) < most


def test_top_k_empty(spark):
    d = spark.createDataFrame([], "vec_id long, vector array<long>")
    assert top_k(d, F.col("vec_id") % 50 == 0).count() == 0


def test_op1_skips_bad_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.1]), (1, [0.25, -0.3]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [0.1, None]), (6, [0.5, 0.1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in op1_top_k(spark, str(tmp_path)).orderBy("rank").collect()] == [(0, 1, 6, 128 * 128 + 25 * 25), (0, 2, 1, 128 * 64 - 25 * 77)]


def test_op1_against_its_sql(spark, tmp_path):
    """Rows that repeat, ids that repeat with another vector, and components of 1e30."""
    r = random.Random(8)
    rows = [(i % 90, [float(np.float32(r.uniform(-1, 1))) for _ in range(4)]) for i in range(120)]
    rows += [(0, [0.5, 0.5, 0.5, 0.5]), (1, [0.25] * 4), (1, [0.25] * 4), rows[5], rows[5], (50, rows[50][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, op1_top_k(spark, str(tmp_path)).collect())) == sorted(c.execute(topk.OP1_SQL).fetchall())
    spark.createDataFrame([*rows, (200, [1e30, -1e30, 0.0, 1.0]), (201, [1e30] * 4)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/huge/embeddings.parquet")
    got = op1_top_k(spark, f"{tmp_path}/huge").collect()
    assert max(x.score for x in got if x.query_id == 200) == 2**63 - 1 and len(got) == 5 * len({x.query_id for x in got})


# ---------------------------------------------------------------- n-grams


def sets(rows, width):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    return out


def brute(rows, width, percent):
    s = sets(rows, width)
    up = list(range(len(s)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i][1] and s[j][1] and 100 * len(s[i][1] & s[j][1]) >= percent * len(s[i][1] | s[j][1]):
                up[find(i)] = find(j)
    least = {}
    for i in range(len(s)):
        ids = least.setdefault(find(i), [])
        if s[i][0] is not None:
            ids.append(s[i][0])
    return sorted((str(s[i][0]), len(s[i][1]), str(min(least[find(i)], default=None))) for i in range(len(s)))


def drifting(seed, n):
    """Texts that drift from one another, so that links form chains and stars, and some that share a passage."""
    r = random.Random(seed)
    out, w = [], [f"a{r.randrange(999)}" for _ in range(r.choice([5, 9, 30, 120]))]
    passage = [f"p{i}" for i in range(50)]
    for i in range(n):
        if r.random() < 0.2:
            w = [f"a{r.randrange(999)}" for _ in range(r.choice([1, 3, 5, 9, 30, 120, 400]))]
        for _ in range(r.randint(0, 3)):
            w = list(w)
            w[r.randrange(len(w))] = f"b{r.randrange(999)}"
        out.append((i, " ".join([*w, *passage] if r.random() < 0.3 else w)))
    return out


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 70)])
def test_components(spark, seed, width, percent):
    rows = drifting(seed, 250)
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, width, percent)


@pytest.mark.parametrize("most", [(0, 10**9), (0, 3000)])
def test_large_components(spark, monkeypatch, most):
    """With components that are too large to be settled many at a time, or by one task."""
    monkeypatch.setattr(ngram_join, "SMALL_BYTES", most[0])
    monkeypatch.setattr(ngram_join, "LIST_BYTES", most[1])
    monkeypatch.setattr(ngram_join, "TASK_BYTES", most[1])
    rows = drifting(7, 200)
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 4, 85)


def test_components_edge_cases(docs, rows, crowded):
    for d in (docs, crowded):
        got = ngram_components(d).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 4, 85)


def test_keep_one(crowded, rows):
    out = keep_one(crowded)
    assert out.columns == crowded.columns
    got = sorted(str(r.doc_id) for r in out.collect())
    components_ = {c for _, n, c in brute(rows, 5, 80) if n}
    empties = [str(i) for i, s in sets(rows, 5) if not s]
    twice = [str(i) for i, s in sets(rows, 5) if s and rows.count(next(x for x in rows if x[0] == i)) > 1]
    assert set(got) == components_ | set(empties) and len(got) <= len(components_) + len(empties) + len(twice)


def test_signatures_of_similar_sets_meet():
    r = np.random.default_rng(1)
    for percent in (85, 80, 60):
        e = PartEnum(percent)
        for _ in range(400):
            n = int(np.exp(r.uniform(0, 7)))
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            k = int(r.integers(0, max(1, int(e.apart(n, n))) + 1))
            b = np.unique(np.concatenate([a[r.permutation(len(a))[k // 2 :]], r.integers(0, 2**64, k - k // 2, dtype=np.uint64)]))
            if len(b) and similar(a, b, percent) and not (len(a) == len(b) and (a == b).all()):
                assert set(e.signatures(a).tolist()) & set(e.signatures(b).tolist()), (percent, n, k)
            may, far = Near(e, [len(a), len(b)], [sketch(a), sketch(b)]).before(1)
            assert far[0] <= len(np.setxor1d(a, b)) and (len(may) or not len(b) or not similar(a, b, percent))


def test_long_texts(monkeypatch):
    """A text longer than what is hashed at once has the same set, and words longer than the table of factors count whole."""
    r = random.Random(2)
    t = "\n".join(f"w{r.randrange(400)} {'x' * r.randrange(60)}" for _ in range(3000)).encode() + b" " + b"y" * 9000 + b" " + b"y" * 9001
    whole = ngram_join.shingle_sets([t], 4)[0]
    monkeypatch.setattr(ngram_join, "PART_BYTES", 777)
    assert (ngram_join.shingle_sets([t], 4)[0] == whole).all()
    assert len(set(ngram_join.word_hashes([b"y" * 9000, b"y" * 9001])[0].tolist())) == 2


def test_long_lists_are_cut():
    sigs, refs = np.repeat(np.arange(64, 128 * 2, 64, dtype=np.uint64), 50), np.tile(np.arange(50), 3)
    (pieces,) = candidate_lists(sigs, refs, [8] * 64)
    assert all(len(x) <= 4 for x in pieces) and np.concatenate(pieces).tolist() == list(range(50))
    assert [len(x) for x in candidate_lists(sigs, refs, [50] * 64)[0]] == [50]


def test_one_signature_of_many_sets():
    """50,000 sets under one signature leave the task as one list in pieces, in memory that grows with the list, not with its square."""
    sigs, refs = np.full(50_000, 64, np.uint64), np.arange(50_000)
    tracemalloc.start()
    (pieces,) = candidate_lists(sigs, refs, [512] * 64)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6 and max(map(len, pieces)) <= 256 and sum(map(len, pieces)) == 50_000


def test_long_lists_meet(spark, monkeypatch):
    """With lists that are cut into pieces of two sets, and components that no task settles whole, the answer is the same."""
    for name, value in (("LIST_MOST", 4), ("LIST_BYTES", 1), ("TASK_MOST", 3), ("SMALL_BYTES", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "LEAST_CUT", 4)
    rows = drifting(9, 120) + [(1000 + i, " ".join([*(f"c{j}" for j in range(60)), f"own{i}"])) for i in range(40)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 4, 85)


def test_stars(spark):
    r = random.Random(4)
    edges = {(r.randrange(200), r.randrange(200)) for _ in range(150)} | {(i, i + 1) for i in range(300, 340)}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.comp for r in components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in up} == {x: find(x) for x in up}


def test_join_empty(empty):
    assert ngram_components(empty).count() == 0 and keep_one(empty).count() == 0
