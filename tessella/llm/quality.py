"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._base import ship, small_batches, table, text_or_empty, unused

TRUSTED_ROWS = 200_000  # about as many trusted positives are used at most; their ids are broadcast
THRESHOLD = 0.3
ASCII, STYLE, LETTERS, WORDS, PAIRS = 128, 12, 256, 128, 64
WIDTH = ASCII + STYLE + LETTERS + WORDS + PAIRS
UNIT = 256  # features are whole multiples of 1 / UNIT, so that sums of their products are exact in any order
WEIGHT = 2.0**24  # so are weights, with this denominator
BINS, REACH = 4096, 4.0  # of the histograms of margins, from -REACH to REACH
FAN_IN = 64  # tables of sums added up in one task
BAND = 64  # lines of such a table in one row
PENALTIES = (1e-2, 3e-2, 0.1)
U32 = np.uint32


def _measure(text: bytes, out: np.ndarray) -> None:
    """Puts a text's features, 0 to 1, into zeros."""
    b = np.frombuffer(text, np.uint8)
    shares = np.bincount(b, minlength=256) / len(b)
    out[:ASCII] = np.sqrt(shares[:ASCII])
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(words)) / n
    k = np.fromiter(map(zlib.crc32, words), U32, len(words))
    again = np.count_nonzero(k[1:] == k[:-1]) / n
    pair = (k[:-1] * U32(31) + k[1:]) * U32(2654435761)
    upper, digit = shares[65:91].sum(), shares[48:58].sum()
    letters = upper + shares[97:123].sum() + shares[128:].sum()
    odd = max(0.0, 1 - letters - digit - shares[[9, 10, 11, 12, 13, 32]].sum())
    length = min(1.0, np.log1p(n) / 12)
    style = [shares[128:].sum(), upper / max(letters, 1e-6), digit, odd, length, distinct, distinct * length, again, len(np.unique(pair)) / max(1, n - 1)]
    out[ASCII : ASCII + STYLE] = [*style, min(len(text) / n, 40.0) / 40, len(set(lines)) / max(1, len(lines)), min(1.0, n / 20)]
    wide = b.astype(U32)
    three = (wide[:-2] * U32(0x9E3779B1) ^ wide[1:-1] * U32(0x85EBCA77) ^ wide[2:] * U32(0xC2B2AE3D)) * U32(2654435761) >> U32(24)
    at = ASCII + STYLE
    for hashed, size in ((three, LETTERS), (k % U32(WORDS), WORDS), (pair >> U32(26), PAIRS)):
        if len(hashed):
            out[at : at + size] = np.sqrt(np.bincount(hashed, minlength=size) / len(hashed))
        at += size


def matrix(texts: list[bytes | None]) -> np.ndarray:
    """The texts' features as whole numbers from 0 to UNIT, a row for each; all of a text is read, null is empty.

    Root shares of the ASCII bytes; how long, varied and repetitive the text is; root shares of hashed runs of three
    bytes, of hashed words and of hashed pairs of words. All 0 for an empty text.
    """
    out = np.zeros((len(texts), WIDTH))
    for text, row in zip(texts, out, strict=True):
        if text:
            _measure(text, row)
    return np.rint(np.clip(out, 0, 1) * UNIT)


# ---------------------------------------------------------------- model


def second_moments(x: np.ndarray) -> np.ndarray:
    """Sums over rows of all products of two of (1, features); the first entry is the number of rows."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    return a.T @ a


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the unbiased risk of margins g = w . (1, x) with the loss l(g) = (g - 1)^2 / 4: prior * E_p[l(g)], and E_u[l(-g)] - prior * E_p[l(-g)].

    p and u are second moments divided by their rows. The second term estimates the loss on negatives without having any.
    """
    loss = lambda m, sign: (w @ m @ w - 2 * sign * (m[0] @ w) + 1) / 4
    return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)


def fit(p: np.ndarray, u: np.ndarray, prior: float, *, steps: int = 300, penalty: float = PENALTIES[0]) -> np.ndarray:
    """Weights of (1, features) that minimise the non-negative risk; p and u are the second moments of positives and of unlabelled text.

    The loss is quadratic, so the moments hold all that the risk needs of any number of documents. Where the estimate
    of the loss on negatives falls below 0 the model overfits, and the step goes up that term instead.
    """
    mean = u[0, 1:] / u[0, 0]
    spread = np.sqrt(np.maximum(np.diag(u)[1:] / u[0, 0] - mean**2, 0)) + 1.0
    to_z = np.zeros_like(u)
    to_z[0, 0] = 1
    to_z[1:, 1:] = np.diag(1 / spread)
    to_z[1:, 0] = -mean / spread
    p, u = to_z @ (p / p[0, 0]) @ to_z.T, to_z @ (u / u[0, 0]) @ to_z.T
    decay = np.full(len(u), penalty)
    decay[0] = 0
    rate = 1 / (np.linalg.eigvalsh(prior * p + u)[-1] / 2 + penalty)
    w = ahead = np.zeros(len(u))
    t = 1.0
    for _ in range(steps):
        up = prior * (p @ ahead - p[0]) / 2
        down = (u @ ahead + u[0]) / 2 - prior * (p @ ahead + p[0]) / 2
        step = (up + down if risk(ahead, p, u, prior)[1] >= 0 else -down) + decay * ahead
        new = ahead - rate * step
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + (before - 1) / t * (new - w)
    return w @ to_z


def halves(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[list[np.ndarray], float]:
    """Weights learnt from either half of the rows, and the penalty of PENALTIES under which they risk least on the other half; p and u are moments by half."""
    found = []
    for penalty in PENALTIES:
        w = [fit(p[h], u[h], prior, penalty=penalty) for h in (0, 1)]
        terms = [risk(w[h], p[1 - h] / p[1 - h, 0, 0], u[1 - h] / u[1 - h, 0, 0], prior) for h in (0, 1)]
        found.append((sum(up + max(0.0, down) for up, down in terms), penalty, w))
    _, penalty, w = min(found, key=lambda x: x[:2])
    return w, penalty


def margins(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """w . (1, x) in whole numbers, so that a row's margin does not depend on the rows beside it."""
    whole = np.rint(w * WEIGHT).astype(np.int64)
    return (x.astype(np.int64) @ whole[1:] + whole[0]) / WEIGHT


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in unlabelled text, from histograms of margins of positives and of unlabelled text.

    Unlabelled text holds the positives, so no set of margins has a smaller share of it than prior times its share of
    the positives: the least ratio over the upper tails with at least 0.3 of the positives is the estimate. Negatives are
    not used.
    """
    n_p, n_u = p.sum(), u.sum()
    if not n_p or not n_u:
        return 0.5
    tail_p, tail_u = np.cumsum(p[::-1]) / n_p, np.cumsum(u[::-1]) / n_u
    ok = (tail_p >= 0.3) & (tail_u > 0)
    return float(min(0.99, max(0.01, (tail_u[ok] / tail_p[ok]).min(initial=1.0))))


def slope(p: np.ndarray, u: np.ndarray, prior: float, *, steps: int = 2000) -> tuple[float, float]:
    """(a, b) of score = sigma(a * margin + b): the non-negative risk with the logistic loss over the histograms of margins."""
    g = (np.arange(BINS) + 0.5) * (2 * REACH / BINS) - REACH
    p, u = p / p.sum(), u / u.sum()
    x = np.array([2.0, 0.0])
    mean, var = np.zeros(2), np.zeros(2)
    for t in range(1, steps + 1):
        z = x[0] * g + x[1]
        s = 1 / (1 + np.exp(-z))
        soft = np.logaddexp(0, z)
        down = u * s - prior * p * s
        d = -prior * p * (1 - s) + down if (u - prior * p) @ soft >= 0 else -down
        grad = np.array([d @ g + 1e-3 * x[0], d.sum()])
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        x = x - 0.02 * (1 - t / (steps + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-9)
    return float(max(x[0], 0.1)), float(x[1])


def scores(m: dict, x: np.ndarray) -> np.ndarray:
    if m.get("constant") is not None:
        return np.full(len(x), m["constant"])
    return 1 / (1 + np.exp(-np.clip(m["slope"][0] * margins(m["weights"], x) + m["slope"][1], -30, 30)))


# ---------------------------------------------------------------- passes over the documents


def _sampled(ids: DataFrame, most: int) -> DataFrame:
    """About `most` rows by a hash of doc_id over its full width, or all if there are no more."""
    n = ids.count()
    return ids if n <= most else ids.where(F.xxhash64(F.lit("sample"), "doc_id") < F.lit(int(-(2**63) + 2**64 * most // n)))


def _summed(sums: DataFrame, lines: int, width: int) -> np.ndarray:
    """Adds up rows (at, part, sums) of whole numbers, FAN_IN tasks at a time; result by `at`."""
    kind = "at int, part int, sums binary"

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in rows.column("sums"))
        return pa.table({"at": rows.column("at")[:1], "part": rows.column("part")[:1], "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    got = sums.groupBy("at", "part").applyInArrow(add, kind)
    got = got.select("at", F.lit(0).alias("part"), "sums").groupBy("at").applyInArrow(add, kind)
    out = np.zeros((lines, width))
    for at, _, x in got.collect():  # at most `lines` rows
        out[at] = np.frombuffer(zlib.decompress(x), np.int64)
    return out


def _sent(tables: np.ndarray) -> pa.RecordBatch:
    """Rows (at, part, sums) of a task's tables, those of zeros left out."""
    at = np.flatnonzero(tables.any(axis=1))
    part = TaskContext.get().partitionId() // FAN_IN
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array([zlib.compress(tables[i].astype(np.int64).tobytes(), 1) for i in at], pa.binary())], names=["at", "part", "sums"])


def _kinds(trusted: list, half: list) -> list[tuple[int, np.ndarray]]:
    """(table, rows) of a batch: unlabelled rows of either half, then trusted ones of either half; a trusted row is unlabelled text too."""
    trusted, half = np.array(trusted, bool), np.array(half, bool)
    return [(2 * good + h, np.flatnonzero((half == h) & (trusted | (not good)))) for good in (0, 1) for h in (0, 1)]


def moments(rows: DataFrame) -> np.ndarray:
    """Second moments of rows(text, trusted, half), by kind and half: [trusted, half, 1 + WIDTH, 1 + WIDTH]. All rows, in one pass."""
    side = WIDTH + 1
    bands = -(-side // BAND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, bands * BAND, side))
        for b in batches:
            x = matrix(b.column(0).cast(pa.binary()).to_pylist())
            for kind, at in _kinds(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if len(at):
                    total[kind, :side] += second_moments(x[at])
        yield _sent(total.reshape(4 * bands, BAND * side))

    got = _summed(rows.select("text", "trusted", "half").mapInArrow(run, "at int, part int, sums binary"), 4 * bands, BAND * side)
    return got.reshape(4, bands * BAND, side)[:, :side].reshape(2, 2, side, side)


def histograms(rows: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Histograms of margins, [trusted, bin]: a row of one half is scored by the weights learnt from the other. All rows, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS))
        for b in batches:
            x = matrix(b.column(0).cast(pa.binary()).to_pylist())
            for kind, at in _kinds(b.column(1).to_pylist(), b.column(2).to_pylist()):
                g = margins(weights[1 - kind % 2], x[at])
                bins = np.clip(((g + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)
                total[kind // 2] += np.bincount(bins, minlength=BINS)
        yield _sent(total)

    return _summed(rows.select("text", "trusted", "half").mapInArrow(run, "at int, part int, sums binary"), 2, BINS)


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, trusted_rows: int = TRUSTED_ROWS, prior: float | None = None) -> dict:
    """Fit the classifier on rows of docs for which `learn` holds (a column of doc_id).

    Trusted positives are the documents that labels marks 1 and nowhere 0, about trusted_rows of them at most, by a
    hash of doc_id; unlabelled text is every row. One pass takes the second moments of both, for either half of the
    rows by another hash; weights of each half, under the penalty that risks least there, score the other in a second pass, and the
    histograms of these margins give the class prior (see class_prior), unless it is given. The same for weights under
    that prior gives the slope of the scores; the model's weights are those of all rows. Sums are of whole numbers: the model does not depend on how rows are dealt.

    Rows without a label, null ids, null texts (empty) and null labels are fine. With no positives, or with no rows,
    the score is the prior everywhere, 0.5 if none is given.
    """
    marks = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"))
    trusted = _sampled(marks.where(F.col("low") == 1).select(F.col("doc_id").alias("trusted_id")).withColumn("doc_id", F.col("trusted_id")), trusted_rows).select("trusted_id")
    small_batches(docs.sparkSession)
    rows = docs.where(learn).select("doc_id", text_or_empty().alias("text"))
    rows = rows.join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left")  # about trusted_rows ids at most
    rows = rows.select("text", F.col("trusted_id").isNotNull().alias("trusted"), (F.xxhash64(F.lit("half"), "doc_id") >= 0).alias("half"))
    m = moments(rows)
    u, p = m
    if not p[0, 0, 0] + p[1, 0, 0]:
        return {"constant": 0.5 if prior is None else prior}
    first = 0.5 if prior is None else prior
    if all(x[h, 0, 0] for x in (u, p) for h in (0, 1)):
        weights, penalty = halves(p, u, first)
    else:  # next to no rows: no half to hold the other against
        penalty = PENALTIES[-1]
        weights = [fit(p.sum(axis=0), u.sum(axis=0), first, penalty=penalty)] * 2
    if prior is None:
        prior = class_prior(*histograms(rows, tuple(weights))[::-1])
        if weights[0] is not weights[1]:
            weights = [fit(p[h], u[h], prior, penalty=penalty) for h in (0, 1)]
    near_u, near_p = histograms(rows, tuple(weights))
    return {"weights": fit(p.sum(axis=0), u.sum(axis=0), prior, penalty=penalty), "prior": prior, "slope": slope(near_p, near_u, prior)}


def classify(docs: DataFrame, model: dict, *, score: str = "score") -> DataFrame:
    """docs with a column more: each row's score from its whole text, 0 to 1. Other columns pass through untouched; one of the score's name gives way to it.

    Null text counts as empty, and empty texts are scored as any other. Rows that repeat are scored alike, however
    rows are dealt.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != score.lower()])
    names = [f.name for f in docs.schema.fields]
    at = names.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(at).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(sent.value, x), pa.float64())], names=[*names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def fold(column: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all their columns, but for rows that score below the threshold."""
    score = unused(docs, "score")
    out = classify(docs, train(docs, labels, learn), score=score)
    return out.where(F.col(score) >= threshold).drop(score)


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, train(docs, table(spark, sf_dir, "labels"), fold() != 0))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


ship(__name__)
