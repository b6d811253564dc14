"""Packet-header codewords, variable-length numbers and bits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_of(n: Column, width: int) -> Column:
    return F.lpad(F.bin(n), width, "0")


def unary(n: Column) -> Column:
    """n zeros and a one."""
    return F.concat(F.repeat(F.lit("0"), n.cast("int")), F.lit("1"))


def pass_count(n: Column) -> Column:
    """The prefix code of 1 .. 164 coding passes."""
    return (
        F.when(n == 1, F.lit("0")).when(n == 2, F.lit("10")).when(n <= 5, F.concat(F.lit("11"), bits_of(n - 3, 2)))
        .when(n <= 36, F.concat(F.lit("1111"), bits_of(n - 6, 5))).otherwise(F.concat(F.lit("111111111"), bits_of(n - 37, 7)))
    )


def length_code(n: Column, count_bits: int = 5) -> Column:
    """How many bits a length has, in count_bits bits, then the length. Three bits for the count would end at 127; five reach 2^31 - 1."""
    width = F.when(n == 0, 0).otherwise(F.length(F.bin(n)))
    return F.concat(bits_of(width, count_bits), F.when(n == 0, "").otherwise(F.bin(n)))


def vlq_hex(n: Column) -> Column:
    """Seven bits a byte, high bytes first, the top bit set on all but the last: as hex digits. Numbers below 2^35."""
    n = n.cast("long")
    groups = [F.lpad(F.hex(F.shiftright(n, 7 * i).bitwiseAND(F.lit(127).cast("long")) + (128 if i else 0)), 2, "0") for i in range(5)]
    out = groups[0]
    for i in range(1, 5):
        out = F.when(n >= 1 << (7 * i), F.concat(groups[i], out)).otherwise(out) if i == 1 else F.concat(F.when(n >= 1 << (7 * i), groups[i]).otherwise(F.lit("")), out)
    return out


def vlq_value(digits: Column) -> Column:
    """The number that vlq_hex wrote."""
    n = (F.length(digits) / 2).cast("int")
    byte = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(byte, F.lit(0).cast("long"), lambda acc, b: acc * 128 + b.bitwiseAND(F.lit(127).cast("long")))


def bit_plane(v: Column, plane: Column) -> Column:
    """One bit of a magnitude."""
    return F.shiftright(F.abs(v), plane.cast("int") if not isinstance(plane, int) else plane).bitwiseAND(F.lit(1))


def bit_length(v: Column) -> Column:
    """Bits of a magnitude; 0 has none."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v)))).cast("int")
