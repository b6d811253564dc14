"""Lifting wavelets: as windows over samples, and as whole planes in numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.columns import int_div

# fixed values: the lifting steps and the scaling of the irreversible transform
ALPHA, BETA, GAMMA, DELTA = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971
SCALE, SCALE_INVERSE = 1.230174104914001, 0.812893066115961


# ---------------------------------------------------------------- window form


def half_up(n: Column) -> Column:
    return int_div(n + 1, F.lit(2)).cast("int")


def split_index(i: Column, n: Column) -> Column:
    """Where sample i goes: even ones first, then odd ones."""
    return F.when(i % 2 == 0, int_div(i, F.lit(2))).otherwise(half_up(n) + int_div(i, F.lit(2))).cast("int")


def merge_index(p: Column, n: Column) -> Column:
    """Where coefficient p of a split signal comes from."""
    return F.when(p < half_up(n), p * 2).otherwise((p - half_up(n)) * 2 + 1).cast("int")


def _lift(df: DataFrame, keys: Sequence[str], index: str, parity: int, update) -> DataFrame:
    """One lifting step: samples of one parity change by a function of both neighbours, mirrored at the ends."""
    w = W.partitionBy(*keys).orderBy(index)
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    changed = F.when((F.col(index) % 2 == parity) & F.coalesce(before, after).isNotNull(), F.col("v") + update(F.coalesce(before, after), F.coalesce(after, before)))
    return df.withColumn("v", changed.otherwise(F.col("v")))


STEPS_53 = ((1, lambda a, b: -F.shiftright(a + b, 1)), (0, lambda a, b: F.shiftright(a + b + 2, 2)))
UNSTEPS_53 = ((0, lambda a, b: -F.shiftright(a + b + 2, 2)), (1, lambda a, b: F.shiftright(a + b, 1)))


def _times(c: float):
    return lambda a, b: (a + b) * F.lit(c)


STEPS_97 = tuple((1 - i % 2, _times(c)) for i, c in enumerate((ALPHA, BETA, GAMMA, DELTA)))
UNSTEPS_97 = tuple((i % 2, _times(-c)) for i, c in enumerate((DELTA, GAMMA, BETA, ALPHA)))


def _kept(df: DataFrame, index: str, inside: str | None) -> DataFrame:
    return df.withColumns({"__v": F.col("v"), "__i": F.col(index)}) if inside else df


def _only(out: DataFrame, index: str, inside: str | None) -> DataFrame:
    """Rows outside as _kept found them."""
    if not inside:
        return out
    return out.withColumns({c: F.when(F.col(inside), F.col(c)).otherwise(F.col(old)) for c, old in (("v", "__v"), (index, "__i"))}).drop("__v", "__i")


def forward_1d(df: DataFrame, keys: Sequence[str], index: str, kind: str = "53", inside: str | None = None) -> DataFrame:
    """Transform the signal in v along index within keys; index becomes the coefficient's place, low band first.

    All steps share one window specification: one exchange and one sort. A signal of one sample stays as it is. With
    `inside`, a boolean column, rows where it is false pass through.
    """
    keys, df = [*keys, *([inside] if inside else [])], _kept(df, index, inside)
    out = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)).cast("int"))
    if kind == "97":
        out = out.withColumn("v", F.col("v").cast("double"))
    for parity, update in STEPS_53 if kind == "53" else STEPS_97:
        out = _lift(out, keys, index, parity, update)
    if kind == "97":
        scale = F.when(F.col("__n") < 2, 1.0).when(F.col(index) % 2 == 0, SCALE_INVERSE).otherwise(SCALE)
        out = out.withColumn("v", F.col("v") * scale)
    return _only(out.withColumn(index, split_index(F.col(index), F.col("__n"))).drop("__n"), index, inside)


def inverse_1d(df: DataFrame, keys: Sequence[str], index: str, kind: str = "53", inside: str | None = None) -> DataFrame:
    """Undo forward_1d."""
    keys, df = [*keys, *([inside] if inside else [])], _kept(df, index, inside)
    out = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)).cast("int"))
    out = out.withColumn(index, merge_index(F.col(index), F.col("__n")))
    if kind == "97":
        scale = F.when(F.col("__n") < 2, 1.0).when(F.col(index) % 2 == 0, SCALE).otherwise(SCALE_INVERSE)
        out = out.withColumn("v", F.col("v").cast("double") * scale)
    for parity, update in UNSTEPS_53 if kind == "53" else UNSTEPS_97:
        out = _lift(out, keys, index, parity, update)
    return _only(out.drop("__n"), index, inside)


def forward_2d(df: DataFrame, keys: Sequence[str], kind: str = "53", inside: str | None = None) -> DataFrame:
    """Rows, then columns of (keys, y, x, v): two exchanges."""
    return forward_1d(forward_1d(df, [*keys, "y"], "x", kind, inside), [*keys, "x"], "y", kind, inside)


def inverse_2d(df: DataFrame, keys: Sequence[str], kind: str = "53", inside: str | None = None) -> DataFrame:
    return inverse_1d(inverse_1d(df, [*keys, "x"], "y", kind, inside), [*keys, "y"], "x", kind, inside)


def sizes(width: int, height: int, levels: int) -> list[tuple[int, int]]:
    """Width and height of the low band before each level."""
    out = []
    for _ in range(levels):
        out.append((width, height))
        width, height = (width + 1) // 2, (height + 1) // 2
    return out


def decompose(df: DataFrame, keys: Sequence[str], width: int, height: int, levels: int, kind: str = "53") -> DataFrame:
    """Several levels over planes of one size: each level transforms the low band of the one before; the rest passes through, so a level is computed once, in two exchanges."""
    if kind == "97":
        df = df.withColumn("v", F.col("v").cast("double"))
    for w, h in sizes(width, height, levels):
        low = (F.col("x") < w) & (F.col("y") < h)
        df = forward_2d(df.withColumn("__low", low), keys, kind, "__low").drop("__low") if (w, h) != (width, height) else forward_2d(df, keys, kind)
    return df


def reconstruct(df: DataFrame, keys: Sequence[str], width: int, height: int, levels: int, kind: str = "53", stop: int = 0) -> DataFrame:
    """Undo decompose, each level once, in two exchanges; with stop > 0 the low band of that level, for a smaller picture."""
    at = sizes(width, height, levels)
    for w, h in reversed(at[stop:]):
        low = (F.col("x") < w) & (F.col("y") < h)
        df = inverse_2d(df.withColumn("__low", low), keys, kind, "__low").drop("__low") if (w, h) != (width, height) else inverse_2d(df, keys, kind)
    if stop:
        w, h = ((at[stop - 1][0] + 1) // 2, (at[stop - 1][1] + 1) // 2)
        df = df.where((F.col("x") < w) & (F.col("y") < h))
    return df


def subband(x: Column, y: Column, w: Column, h: Column) -> Column:
    """LL, HL, LH or HH of a coefficient of a plane transformed once."""
    right, down = x >= half_up(w), y >= half_up(h)
    return F.when(right & down, "HH").when(right, "HL").when(down, "LH").otherwise("LL")


# ---------------------------------------------------------------- array form


def _np_lift(a: np.ndarray, parity: int, update) -> None:
    n = a.shape[-1]
    if n < 2:
        return
    at = np.arange(parity, n, 2)
    before, after = np.where(at > 0, at - 1, 1), np.where(at < n - 1, at + 1, n - 2)
    a[..., at] += update(a[..., before], a[..., after])


def np_forward(a: np.ndarray, kind: str = "53") -> np.ndarray:
    """The last axis of an array of signals, transformed and split."""
    a = a.astype(np.int64 if kind == "53" else np.float64)
    if kind == "53":
        _np_lift(a, 1, lambda p, q: -((p + q) >> 1))
        _np_lift(a, 0, lambda p, q: (p + q + 2) >> 2)
    else:
        for i, c in enumerate((ALPHA, BETA, GAMMA, DELTA)):
            _np_lift(a, 1 - i % 2, lambda p, q, c=c: c * (p + q))
        if a.shape[-1] > 1:
            a[..., ::2] *= SCALE_INVERSE
            a[..., 1::2] *= SCALE
    return np.concatenate([a[..., ::2], a[..., 1::2]], axis=-1)


def np_inverse(a: np.ndarray, kind: str = "53") -> np.ndarray:
    out = np.empty(a.shape, np.int64 if kind == "53" else np.float64)
    half = (a.shape[-1] + 1) // 2
    out[..., ::2], out[..., 1::2] = a[..., :half], a[..., half:]
    if kind == "53":
        _np_lift(out, 0, lambda p, q: -((p + q + 2) >> 2))
        _np_lift(out, 1, lambda p, q: (p + q) >> 1)
    else:
        if a.shape[-1] > 1:
            out[..., ::2] *= SCALE
            out[..., 1::2] *= SCALE_INVERSE
        for i, c in enumerate((DELTA, GAMMA, BETA, ALPHA)):
            _np_lift(out, i % 2, lambda p, q, c=c: -c * (p + q))
    return out


def np_decompose(a: np.ndarray, levels: int, kind: str = "53") -> np.ndarray:
    """Planes in the last two axes."""
    a = a.astype(np.int64 if kind == "53" else np.float64)
    for w, h in sizes(a.shape[-1], a.shape[-2], levels):
        low = np_forward(a[..., :h, :w], kind)
        a[..., :h, :w] = np.swapaxes(np_forward(np.swapaxes(low, -1, -2), kind), -1, -2)
    return a


def np_reconstruct(a: np.ndarray, levels: int, kind: str = "53") -> np.ndarray:
    a = a.astype(np.int64 if kind == "53" else np.float64)
    for w, h in reversed(sizes(a.shape[-1], a.shape[-2], levels)):
        low = np.swapaxes(np_inverse(np.swapaxes(a[..., :h, :w], -1, -2), kind), -1, -2)
        a[..., :h, :w] = np_inverse(low, kind)
    return a


def decompose_arrays(planes: DataFrame, width: int, height: int, levels: int, kind: str = "53") -> DataFrame:
    """(id, data array) -> (id, data array of coefficients): whole planes of one size, many at once, no shuffle."""
    element = "int" if kind == "53" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(1).flatten().to_numpy().reshape(-1, height, width)
            c = np_decompose(a, levels, kind).reshape(-1)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (width * height))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(c, pa.int32() if kind == "53" else pa.float64()))], names=["id", "data"])

    return planes.mapInArrow(run, f"id long, data array<{element}>")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
