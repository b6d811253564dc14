"""Per-sample arithmetic as column expressions: no Python per row, no shuffle."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the irreversible component transform
ICT_FORWARD = ((0.299, 0.587, 0.114), (-0.16875, -0.33126, 0.5), (0.5, -0.41869, -0.08131))
ICT_INVERSE = ((1.0, 0.0, 1.402), (1.0, -0.34413, -0.71414), (1.0, 1.772, 0.0))


def level_shift(v: Column, precision: int) -> Column:
    """Unsigned samples around zero."""
    return v - F.lit(1 << (precision - 1))


def level_unshift(v: Column, precision: int) -> Column:
    return v + F.lit(1 << (precision - 1))


def rct_forward(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(r + 2 * g + b, 2), b - g, r - g


def rct_inverse(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    g = y - F.shiftright(u + v, 2)
    return v + g, g, u + g


def matrix(rows: Sequence[Sequence[float]], cols: Sequence[Column]) -> list[Column]:
    """Each row of coefficients times the columns."""
    out = []
    for row in rows:
        total = None
        for m, c in zip(row, cols, strict=True):
            if m:
                term = c.cast("double") * F.lit(float(m)) if m != 1.0 else c.cast("double")
                total = term if total is None else total + term
        out.append(F.lit(0.0) if total is None else total)
    return out


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def clamp_precision(v: Column, precision: int, signed: bool) -> Column:
    """Into the range of whole numbers of that many bits."""
    half = 1 << (precision - 1)
    return clamp(v, -half, half - 1) if signed else clamp(v, 0, 2 * half - 1)


def rescale(v: Column, from_precision: int, to_precision: int) -> Column:
    """From one full range to another, cut off toward zero; computed in 64 bits."""
    from tessella.functions.columns import int_div

    return int_div(v.cast("long") * F.lit((1 << to_precision) - 1).cast("long"), F.lit((1 << from_precision) - 1).cast("long")).cast("int")


def round_half_away(v: Column) -> Column:
    return F.when(v >= 0, (v + 0.5).cast("int")).otherwise((v - 0.5).cast("int"))


def quantize(v: Column, step: float) -> Column:
    scaled = v * F.lit(1.0 / step)
    return F.when(v >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5)).cast("int")


def dequantize(q: Column, step: float) -> Column:
    return q.cast("double") * F.lit(step)


def step_value(mantissa: Column, exponent: Column) -> Column:
    """A quantiser step from its header fields."""
    return (mantissa / F.lit(2048.0) + 1.0) * F.pow(F.lit(2.0), F.lit(31) - exponent)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
