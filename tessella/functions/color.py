"""Colour spaces to sRGB as column expressions; results are whole numbers in 0 .. 2^precision - 1."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.pointwise import clamp, matrix

# fixed values: inverse matrices and white point
BT709 = ((1.0, 0.0, 1.5748), (1.0, -0.1873, -0.4681), (1.0, 1.8556, 0.0))
BT601 = ((1.0, 0.0, 1.402), (1.0, -0.344136, -0.714136), (1.0, 1.772, 0.0))
PHOTO = ((1.0, 0.0, 1.3584), (1.0, -0.4302, -0.7915), (1.0, 2.2179, 0.0))
PHOTO_OFFSET = 156.0
XYZ_TO_LINEAR = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
ROMM_TO_XYZ = ((0.7977, 0.1352, 0.0313), (0.2880, 0.7119, 0.0001), (0.0, 0.0, 0.8249))
WHITE_D50 = (0.96422, 1.0, 0.82521)


def gamma(v: Column) -> Column:
    """The sRGB curve."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1.0 / 2.4)) * 1.055 - 0.055)


def gamma_inverse(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def lab_inverse(t: Column) -> Column:
    d = 6.0 / 29.0
    return F.when(t > d, t * t * t).otherwise((t - 4.0 / 29.0) * (3 * d * d))


def _whole(v: Column, top: float) -> Column:
    return F.when(v < 0, 0).when(v > top, int(top)).otherwise((v + 0.5).cast("int")).cast("int")


def _centred(m):
    def convert(c: Sequence[Column], precision: int) -> list[Column]:
        half = float(1 << (precision - 1))
        return matrix(m, [c[0], c[1] - F.lit(half), c[2] - F.lit(half)])

    return convert


def _photo(c: Sequence[Column], precision: int) -> list[Column]:
    scale = ((1 << precision) - 1) / 255.0
    y, c1, c2 = c[0] / F.lit(scale), c[1] / F.lit(scale) - PHOTO_OFFSET, c[2] / F.lit(scale) - PHOTO_OFFSET
    return [x * F.lit(scale) for x in matrix(PHOTO, [y, c1, c2])]


def _cmy(c: Sequence[Column], precision: int) -> list[Column]:
    return [F.lit(float((1 << precision) - 1)) - x for x in c[:3]]


def _cmyk(c: Sequence[Column], precision: int) -> list[Column]:
    top = float((1 << precision) - 1)
    return [(1 - x / F.lit(top)) * (1 - c[3] / F.lit(top)) * top for x in c[:3]]


def _ycck(c: Sequence[Column], precision: int) -> list[Column]:
    return [x * (1 - c[3] / F.lit(float((1 << precision) - 1))) for x in _photo(c, precision)]


def _lab(c: Sequence[Column], precision: int) -> list[Column]:
    """No adaptation from D50 to the sRGB white: an approximation, as is taking J a b for L a b."""
    top = float((1 << precision) - 1)
    light, a, b = c[0] / F.lit(top) * 100.0, c[1] / F.lit(top) * 255.0 - 128.0, c[2] / F.lit(top) * 255.0 - 128.0
    fy = (light + 16.0) / 116.0
    xyz = [lab_inverse(t) * w for t, w in zip((a / 500.0 + fy, fy, fy - b / 200.0), WHITE_D50, strict=True)]
    return [gamma(x) * top for x in matrix(XYZ_TO_LINEAR, xyz)]


def _esrgb(c: Sequence[Column], precision: int) -> list[Column]:
    top = float((1 << precision) - 1)
    return [gamma(clamp(x / F.lit(top) * 1.25 - 0.25, 0.0, 1.0)) * top for x in c[:3]]


def _romm(c: Sequence[Column], precision: int) -> list[Column]:
    top = float((1 << precision) - 1)
    linear = matrix(XYZ_TO_LINEAR, matrix(ROMM_TO_XYZ, [F.pow(x / F.lit(top), F.lit(1.8)) for x in c[:3]]))
    return [gamma(clamp(x, 0.0, 1.0)) * top for x in linear]


SPACES: dict[str, Callable[[Sequence[Column], int], list[Column]]] = {
    "sycc": _centred(BT709), "bt601": _centred(BT601), "photoycc": _photo, "cmy": _cmy, "cmyk": _cmyk, "ycck": _ycck, "lab": _lab, "jab": _lab,
    "esrgb": _esrgb, "romm": _romm, "ypbpr": _centred(BT709), "eycc": _centred(BT709),
}


def to_srgb(space: str, components: Sequence[Column], precision: int = 8) -> list[Column]:
    """Red, green and blue; a space that needs no conversion, or too few components, give the components as they are."""
    convert = SPACES.get(space)
    if convert is None or len(components) < (4 if space in ("cmyk", "ycck") else 3):
        return list(components)
    top = float((1 << precision) - 1)
    return [_whole(v, top) for v in convert([c.cast("double") for c in components], precision)]
