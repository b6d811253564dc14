"""Small column helpers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Whole-number division toward zero."""
    return F.call_function("div", a, b)


def ceil_div(a: Column, b: Column) -> Column:
    return int_div(a + b - 1, b).cast("int")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
