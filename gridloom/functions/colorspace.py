"""Colour coordinates and distances as Column expressions over 8-bit sRGB channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.options import Matcher

# sRGB/D65 to XYZ, the white point, and the Oklab matrices.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LMS = ((0.41222146, 0.53633255, 0.051445994), (0.2119035, 0.6806995, 0.10739696), (0.08830246, 0.28171885, 0.6299787))
OKLAB = ((0.21045426, 0.7936178, -0.004072047), (1.9779985, -2.4285922, 0.4505937), (0.025904037, 0.78277177, -0.80867577))

Triple = tuple[Column, Column, Column]


def linear(channel: Column) -> Column:
    c = channel / F.lit(255.0)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _times(matrix: tuple[tuple[float, ...], ...], v: Triple) -> Triple:
    return tuple(F.lit(a) * v[0] + F.lit(b) * v[1] + F.lit(c) * v[2] for a, b, c in matrix)  # type: ignore[return-value]


def lab(r: Column, g: Column, b: Column) -> Triple:
    delta = 6.0 / 29.0
    x, y, z = (
        F.when(t / w > delta**3, F.cbrt(t / w)).otherwise(t / w / (3.0 * delta * delta) + 4.0 / 29.0)
        for t, w in zip(_times(XYZ, (linear(r), linear(g), linear(b))), WHITE)
    )
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def oklab(r: Column, g: Column, b: Column) -> Triple:
    roots = tuple(F.cbrt(x) for x in _times(LMS, (linear(r), linear(g), linear(b))))
    return _times(OKLAB, roots)  # type: ignore[arg-type]


def coordinates(matcher: Matcher, r: str | Column = "r", g: str | Column = "g", b: str | Column = "b") -> Triple:
    """The three coordinates in which a matcher measures distance."""
    own = tuple(F.col(x) if isinstance(x, str) else x for x in (r, g, b))
    return {Matcher.RGB: lambda *v: v, Matcher.LAB: lab, Matcher.OKLAB: oklab}[matcher](*own)


def squared(a: Triple, b: Triple) -> Column:
    p, q, s = (x - y for x, y in zip(a, b))
    return p * p + q * q + s * s
