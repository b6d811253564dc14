"""Language-model scores: a log-bilinear model of word classes, trained by noise-contrastive estimation in numpy."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._base import lookup, ship, small_batches, stored, table, text_or_empty

END = b" "  # the token after a text's last word; no word holds a space
SHAPES = 256  # classes of the words that are none of their own
OWN_LEAST, OWN_TOKENS, OWN_POWER = 768, 300_000, 6  # see own_words
KNOWN = 100_000  # most frequent words whose counts every task holds; the rest meet the counts in a join
COUNTER_WORDS = 500_000  # words that a task counts before it sends them on
FAN_IN = 256  # tables of pair counts added up in one task
SPARSE = 2_000_000  # pairs that a task gathers before it adds up equal ones
BAND = 64  # contexts whose pairs are one row
PRIOR = 3.0  # weight of the vectors' squares against the tokens


def shape(word: bytes) -> int:
    """The class of a word that is not frequent: a hash of its first two bytes and its last, if that is no ASCII letter."""
    last = word[-1:]
    return zlib.crc32(word[:2] + (b"" if last.isalpha() else last)) % SHAPES


def own_words(tokens: int) -> int:
    """How many of the most frequent words have vectors of their own: OWN_LEAST, and from OWN_TOKENS training tokens on more, by the OWN_POWERth root of the tokens."""
    return int(OWN_LEAST * max(1.0, tokens / OWN_TOKENS) ** (1 / OWN_POWER))


# ---------------------------------------------------------------- counts


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of texts(text): words in lower case, counted in the task before they are shuffled, and the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush():
            words, counts = list(seen), list(seen.values())
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()).cast(pa.string()), pa.array(counts[at : at + 50_000], pa.int64())], names=["word", "n"])
            seen.clear()

        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                seen.update(text.lower().split())
            seen[END] += b.num_rows
            if len(seen) > COUNTER_WORDS:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words, at most KNOWN of them, most frequent first: all words from a count on that a histogram of the counts' logarithms gives."""
    size = F.floor(F.log2("n") * 16).cast("int")
    room, least = KNOWN, None
    for bucket, words in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):  # about 1000 at most
        room -= words
        if room < 0:
            break
        least = bucket
    rows = counts.where(size >= least).collect() if least is not None else []
    return sorted(((r[0].encode(), r[1]) for r in rows), key=lambda x: (-x[1], x[0]))


def shape_sums(counts: DataFrame, own: frozenset[bytes]) -> dict[int, tuple[int, int]]:
    """For each shape: tokens and distinct words, of all counted words but those that are classes of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((SHAPES, 2), np.int64)
        for b in batches:
            words = b.column(0).cast(pa.binary()).to_pylist()
            at = np.array([-1 if w in own else shape(w) for w in words], np.int64)
            n = b.column(1).to_numpy(zero_copy_only=False)
            ok = at >= 0
            sums[:, 0] += np.bincount(at[ok], n[ok], SHAPES).astype(np.int64)
            sums[:, 1] += np.bincount(at[ok], minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["shape", "tokens", "words"])

    rows = counts.mapInArrow(run, "shape int, tokens long, words long").groupBy("shape").agg(F.sum("tokens"), F.sum("words")).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def classed(docs: DataFrame, known: dict[bytes, tuple[int, float, float]], own: int) -> DataFrame:
    """Each document's class ids, what the known words give, and the other words for the join; to the shared folder.

    known: word -> (class, log10(count + 1/2), log10 of its share of its class); classes below `own` are words. The
    other words of up to 200 documents are sent on once each, with the rows that have them and how often, in the
    column `rest` of the first of these documents.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)  # at most KNOWN words, or as many as are classes of their own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = sent.value
        index = {w: i for i, w in enumerate(table_of)}
        cls = np.array([v[0] for v in table_of.values()] + [0], np.uint16)
        base = np.array([v[1] for v in table_of.values()] + [0.0])
        share = np.array([v[2] for v in table_of.values()] + [0.0])
        end, rest_at, part, row = index.get(END, -1), len(table_of), TaskContext.get().partitionId(), 0
        get = index.get
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 200):
                out: list[tuple] = []
                others: dict[bytes, Counter[int]] = {}
                for text in texts[at : at + 200]:
                    words = text.lower().split()
                    ids = np.fromiter([get(w, rest_at) for w in words] + [end if end >= 0 else rest_at], np.int64, len(words) + 1)
                    c = cls[ids]
                    where = np.flatnonzero(ids == rest_at)
                    name = (part << 33) + row
                    for i in where.tolist():
                        if i == len(words):  # no end token in training: class 0 stands for it, uncounted
                            continue
                        c[i] = own + shape(words[i])
                        others.setdefault(words[i], Counter())[name] += 1
                    lone = int(end < 0)
                    out.append((name, len(ids), len(ids) - len(where), float(base[ids].sum()) + lone * float(np.log10(0.5)), float(share[ids].sum()), c.tobytes(), []))
                    row += 1
                out[0] = (*out[0][:-1], [{"w": w.decode(), "k": shape(w), "rows": list(x), "times": list(x.values())} for w, x in others.items()])
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("w", pa.string()), ("k", pa.int32()), ("rows", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]))]
                arrays = [pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]
                some = slice(at, at + len(out))
                yield pa.RecordBatch.from_arrays([b.column(0)[some], b.column(1)[some], *arrays], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "share", "ids", "rest"])

    return stored(docs.mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, share double, ids binary, rest array<struct<w:string,k:int,rows:array<long>,times:array<int>>>"), "lm-ids")


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts summed."""
    k, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, counts))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(ids: DataFrame, classes: int) -> np.ndarray:
    """n[check, lag, context class, class] for lags 1 and 2 over all rows of ids(ids, check); before a text's start stands class 0.

    Tasks send on the pairs they have, not tables of all; a row is the pairs of BAND contexts.
    """
    kind = "band int, part int, pairs binary, n binary"

    def rows(k: np.ndarray, n: np.ndarray, part: int) -> pa.RecordBatch:
        band = k // (classes * BAND)
        at = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1]))) if len(k) else np.empty(0, np.int64)
        cut = list(zip(at, np.append(at[1:], len(k)), strict=True)) if len(k) else []
        pack = lambda x: zlib.compress(np.ascontiguousarray(x).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([int(band[i]) for i, _ in cut], pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array([pack(np.diff(k[i:j], prepend=0)) for i, j in cut], pa.binary()), pa.array([pack(n[i:j]) for i, j in cut], pa.binary())], names=["band", "part", "pairs", "n"])

    def read(pairs: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(np.frombuffer(zlib.decompress(pairs), np.int64)), np.frombuffer(zlib.decompress(n), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for b in batches:
            checks = np.array(b.column(1).to_pylist(), bool)
            for check in (0, 1):
                _, a, lag1, lag2 = contexts([x for x, c in zip(b.column(0).to_pylist(), checks, strict=True) if c == check])
                for i, c in enumerate((lag1, lag2)):
                    k, n = np.unique(((2 * check + i) * classes + c) * classes + a, return_counts=True)
                    keys.append(k)
                    counts.append(n)
                    held += len(k)
            if held > SPARSE:
                k, n = _added(keys, counts)
                keys, counts, held = [k], [n], len(k) // 2
        yield rows(*_added(keys, counts), TaskContext.get().partitionId() // FAN_IN)

    def add(group: pa.Table) -> pa.Table:
        got = [read(x.as_py(), n.as_py()) for x, n in zip(group.column("pairs"), group.column("n"), strict=True)]
        return pa.Table.from_batches([rows(*_added([k for k, _ in got], [n for _, n in got]), group.column("part")[0].as_py())])

    got = ids.mapInArrow(run, kind).groupBy("band", "part").applyInArrow(add, kind)
    got = got.withColumn("part", F.lit(0)).groupBy("band").applyInArrow(add, kind)
    out = np.zeros(4 * classes * classes, np.float32)
    for r in got.collect():  # the distinct pairs: at most 4 * classes * classes
        k, n = read(r.pairs, r.n)
        out[k] = n
    return out.reshape(2, 2, classes, classes)


def contexts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the texts, and for all their tokens the class and those of the one and two before."""
    parts = [np.frombuffer(x, np.uint16) for x in blobs]
    starts = np.cumsum([0, *[len(x) for x in parts]])
    a = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    lag1, lag2 = np.zeros_like(a), np.zeros_like(a)
    lag1[1:], lag2[2:] = a[:-1], a[:-2]
    lag1[starts[:-1]] = 0
    lag2[starts[:-1]] = 0
    second = starts[:-1] + 1
    lag2[second[second < starts[1:]]] = 0
    return starts, a, lag1, lag2


# ---------------------------------------------------------------- model


def train_nce(n: np.ndarray, *, width: int = 80, noise: float = 16.0, draws: int = 4, steps: int = 120, rate: float = 0.05, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors R[lag] and the class vectors Q that both lags share, from pair counts n[lag, context, class].

    Noise-contrastive estimation with the classes' own frequencies as noise: log sigma(s - log(noise * p)) for each
    pair and log sigma(log(noise * p) - s) for each noise word, s = R[lag][c] . Q[w] + log p[w]. A step takes all pairs
    of both lags, by their counts, and draws noise words anew, `draws` times as many as there are classes; each stands
    in every context for its part of the noise there. So a step costs the same for any corpus.
    """
    lags, k, _ = n.shape
    total = max(float(n[0].sum()), 1.0)
    p = (n[0].sum(axis=0, dtype=np.float64) + 0.5) / (total + 0.5 * k)
    ends = np.cumsum(p)
    own = (n / np.float32(total)).astype(np.float32)
    rand = own.sum(axis=2, keepdims=True) * np.float32(noise / (draws * k))
    draw = np.random.default_rng(seed)
    r, q = (draw.standard_normal((lags, k, width)) * 0.1).astype(np.float32), (draw.standard_normal((k, width)) * 0.1).astype(np.float32)
    means, squares = [np.zeros_like(r), np.zeros_like(q)], [np.zeros_like(r), np.zeros_like(q)]
    for t in range(1, steps + 1):
        drawn = np.minimum(np.searchsorted(ends, draw.random(draws * k) * ends[-1]), k - 1)
        times = np.bincount(drawn, minlength=k).astype(np.float32)
        up_r, up_q = np.zeros_like(r), np.zeros_like(q)
        for lag in range(lags):
            for at in range(0, k, 128):  # contexts, as many as a processor's cache holds
                some = slice(at, at + 128)
                true = r[lag, some] @ -q.T
                np.exp(np.minimum(true, 60, out=true), out=true)
                true *= np.float32(noise)
                true += 1
                np.reciprocal(true, out=true)  # the chance that a pair is no noise
                pull = rand[lag, some] * times
                pull += own[lag, some]
                pull *= true
                np.subtract(own[lag, some], pull, out=pull)
                up_r[lag, some] = pull @ q
                up_q += pull.T @ r[lag, some]
        for i, (x, d) in enumerate(((r, up_r), (q, up_q))):
            d = d - np.float32(PRIOR / total) * x
            means[i] = 0.9 * means[i] + 0.1 * d
            squares[i] = 0.99 * squares[i] + 0.01 * d * d
            x += rate * min(1.0, 2 * (1 - t / (steps + 1))) * (means[i] / (1 - 0.9**t)) / (np.sqrt(squares[i] / (1 - 0.99**t)) + 1e-9)
    return r, q


def log_tables(model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural-log tables a1[c1, w] (with the bias), a2[c2, w] and z[c1, c2]: log p(w | c1, c2) = a1 + a2 - z.

    A class's score is bilinear, (R1[c1] + R2[c2]) . Q + bias, so the normaliser of every pair of contexts comes from
    one matrix product of the exponentials.
    """
    a1, a2 = own_tables(model)
    m1, m2 = a1.max(axis=1, keepdims=True), a2.max(axis=1, keepdims=True)
    return a1, a2, np.log(np.exp(a1 - m1) @ np.exp(a2 - m2).T) + m1 + m2.T


def own_tables(model: dict) -> tuple[np.ndarray, np.ndarray]:
    return model["r1"] @ model["q"].T + model["bias"], model["r2"] @ model["q"].T


def _fitted(n: np.ndarray) -> dict:
    r, q = train_nce(n)
    bias = np.log((n[0].sum(axis=0, dtype=np.float64) + 0.5) / (n[0].sum(dtype=np.float64) + 0.5 * n.shape[1]))
    return {"r1": r[0], "r2": r[1], "q": q, "bias": bias.astype(np.float32)}


def _weighed(model: dict, w: tuple[float, float]) -> dict:
    return model | {"r1": np.float32(w[0]) * model["r1"], "r2": np.float32(w[1]) * model["r2"]}


def train(n: np.ndarray) -> dict:
    """The model from the pair counts n[check, lag, context, class].

    Both lags' context vectors are trained together with the class vectors they share, each pair of either lag as an
    example of its own; as the two contexts of a token tell much the same, their vectors are then scaled by the two
    weights, of a grid, under which the checked documents are likeliest when the vectors come from the others. At last
    the vectors are trained on all. The likelihood needs no further pass over the texts, as it is a sum over pair
    counts: of the class with the one before, of the class with the one before that, and of the two contexts.
    """
    tried = _fitted(n[0])

    def likelihood(w: tuple[float, float]) -> float:
        a1, a2, z = log_tables(_weighed(tried, w))
        return float(np.vdot(n[1, 0], a1)) + float(np.vdot(n[1, 1], a2)) - float(np.vdot(n[1, 0].T, z))  # but for texts' ends, a pair of contexts is a pair one apart

    best = max([(x, y) for x in (0.5, 0.7, 0.85, 1.0) for y in (0.0, 0.3, 0.5, 0.7, 0.9)], key=likelihood)
    return _weighed(_fitted(n.sum(axis=0)), best)


def learn(rows: DataFrame) -> tuple[dict, DataFrame, DataFrame]:
    """The model, the counts of all training words (word, n), and the documents as class ids, of rows(doc_id, held_out, text)."""
    counts = stored(word_counts(rows.where(~F.col("held_out")).select("text")), "lm-counts")
    total, distinct, ones, twos = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).first()
    gap = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))  # absolute discount, after Ney
    top = frequent(counts)
    own = [END, *[w for w, _ in top if w != END]][: own_words(total)]
    sums = shape_sums(counts, frozenset(own))
    log = lambda x: float(np.log10(x))
    place = {w: i for i, w in enumerate(own)}
    known = {}
    for w, n in top:
        k = None if w in place else shape(w)
        known[w] = (place[w] if k is None else len(own) + k, log(n + 0.5), 0.0 if k is None else log((n - gap) / sums[k][0]))
    ids = classed(rows, known, len(own))
    n = pair_counts(ids.where(~F.col("held_out")).select("ids", (F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).alias("check")), len(own) + SHAPES)
    return {"own": own, "total": total, "distinct": distinct, "gap": gap, "sums": sums, **train(n)}, counts, ids


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """Score every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs: doc_id, text; other columns are ignored. Learns from the rows where held_out is false, all of them: word
    counts, then counts of class pairs one and two tokens apart, then the model. score is the log10 probability of
    the text's tokens and end. A token's probability is its class's given the two classes before, times its share of
    its class: frequent words are classes of their own, more of them the more tokens there are (own_words), other words
    are classed by their shape. A class's words share all but a discount of their counts; the discount goes to one
    event, a word of this shape that training lacks. These sum to 1 over the known words and the unknown events.
    base_score is the unigram score of the contract.

    Words outside the KNOWN most frequent get their counts by a join on the word, to which 200 documents send a word
    once; a word that many of these have, as it may among rows that are not learnt from, is joined by broadcast. Null
    and empty texts are one end token. If no row is for training every token is unknown. Rows that repeat are scored
    alike. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty().alias("text"))
    model, counts, ids = learn(rows)
    total, distinct, gap, sums = (model[x] for x in ("total", "distinct", "gap", "sums"))
    sent = spark.sparkContext.broadcast({k: model[k] for k in ("r1", "r2", "q", "bias")} | {"z": log_tables(model)[2]})  # classes x classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a1, a2 = own_tables(sent.value)
        z = sent.value["z"]
        for b in batches:
            starts, a, c1, c2 = contexts(b.column(1).to_pylist())
            if len(a):
                p = a1[c1, a].astype(np.float64) + a2[c2, a] - z[c1, c2]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.add.reduceat(p, starts[:-1]) / np.log(10))], names=["row", "classes"])

    classes = ids.select("row", "ids").mapInArrow(run, "row long, classes double")
    rest = ids.where(F.size("rest") > 0).select(F.explode("rest").alias("rest")).select(F.col("rest.w").alias("word"), F.col("rest.k").alias("k"), F.arrays_zip(F.col("rest.rows").alias("row"), F.col("rest.times").alias("times")).alias("at"))
    words = stored(rest.groupBy("word").agg(F.count(F.lit(1)).alias("sent")).join(counts, "word", "left"), "lm-rest")
    shape_tokens = F.array(*[F.lit(float(sums.get(i, (0, 0))[0])) for i in range(SHAPES)])
    shape_words = F.array(*[F.lit(float(sums.get(i, (0, 0))[1])) for i in range(SHAPES)])
    n, tokens, kinds, times = F.col("n"), F.element_at(shape_tokens, F.col("k") + 1), F.element_at(shape_words, F.col("k") + 1), F.col("times")
    share = F.when(n.isNotNull(), F.log10((n - gap) / tokens)).when(kinds > 0, F.log10(gap * kinds / tokens)).otherwise(0.0)
    rest = lookup(rest, words, "word", "sent").select("n", share.alias("share"), F.explode("at").alias("at")).select("n", "share", F.col("at.row").alias("row"), F.col("at.times").alias("times"))
    rest = rest.groupBy("row").agg(F.sum(times * F.log10(F.coalesce(n, F.lit(0)) + 0.5)).alias("rest_base"), F.sum(F.when(n.isNotNull(), times).otherwise(0)).alias("rest_known"), F.sum(times * F.col("share")).alias("rest_share"))
    out = ids.drop("ids", "rest").join(classes, "row").join(rest, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("rest_base")) - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))).alias("base_score"),
        (F.col("classes") + F.col("share") + zero(F.col("rest_share"))).alias("score"),
    )


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return score_documents(table(spark, sf_dir, "documents"), held_out)


ship(__name__)
