"""The stages of the pipeline, one after another, against brute force on the smallest tables."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as c
from tessella.llm import quality as q
from tessella.llm._base import stored

SF = "/root/testdata/sf0.001"


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is c.run
    assert [n for n, _ in c.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in __spark_entry__.queries() if re.match(r"op\d+_", x)}


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in c.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
    raw, good, first, one, mixed, packed = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((i in kept) == bool(labels[i]) for i in held) or np.mean([(i in kept) == bool(labels[i]) for i in held]) > 0.9
    least = {}
    for r in good:
        k = re.sub("[\x20\x09-\x0d]+", " ", r.text)
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in first) == sorted(least.values())
    s = [(r.doc_id, shingles(r.text)) for r in sorted(first)]
    up = {i: i for i, _ in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in s:
        for j, b in s:
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[max(find(i), find(j))] = min(find(i), find(j))
    assert sorted(r.doc_id for r in one) == sorted({find(i) for i, _ in s})
    times = Counter(r.doc_id for r in mixed)
    total = sum(len(r.text.encode().split()) for r in one)
    taken = sum(times[r.doc_id] * len(r.text.encode().split()) for r in one)
    assert set(times) <= {r.doc_id for r in one} and max(times.values()) <= 3 and abs(taken - total) < 0.2 * total
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in one}
    length = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert sum(p.length for p in packed) == sum(length[i] * n for i, n in times.items())
    assert len({p.sequence_id for p in packed}) == -(-sum(p.length for p in packed) // 4096)


def test_classifier_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in q.keep_good(docs, labels, q.fold() != 0).collect()}
    assert all(r.doc_id in kept for r in labels.where("quality = 1").collect())


def test_stages_on_odd_rows(spark, docs, empty, crowded):
    """Nulls, empty, long and repeated texts, columns of any name, and no rows at all, through every stage."""
    names = ("_score", "own_doc_id", "gone_doc_id", "text_hash", "trusted", "half", "mix_hash", "key_id", "component")
    wide = crowded.withColumns({n: F.lit(1) for n in names})
    left = {}
    for name, df in (("plain", docs), ("wide", wide), ("empty", empty)):
        for stage, run in c.STAGES:
            out = run(spark, df, SF)
            if stage != "pack":
                assert out.columns == df.columns
                df = stored(out, f"odd-{name}-{stage}")
            left[name, stage] = out.count() if stage == "pack" else df.count()
    for stage, _ in c.STAGES:
        assert left["plain", stage] == left["wide", stage] and left["empty", stage] == 0
    assert docs.count() >= left["plain", "quality"] >= left["plain", "exact_dedup"] >= left["plain", "near_dedup"] > 0
