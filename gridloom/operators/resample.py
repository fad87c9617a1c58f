"""Centre crop and resampling of pixel tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import InvalidImage
from gridloom.options import Resample


def crop_box(width: int, height: int, target_w: int, target_h: int) -> tuple[int, int, int, int]:
    """x, y, width, height of the largest centred rectangle of ratio target_w : target_h; odd leftovers go right and below."""
    for name, value in (("crop target width", target_w), ("crop target height", target_h), ("source width", width), ("source height", height)):
        if value <= 0:
            raise InvalidImage(f"{name} is 0")
    wide, tall = width * target_h, height * target_w
    w = tall // target_h if wide > tall else width
    h = wide // target_w if wide < tall else height
    if not w or not h:
        raise InvalidImage(f"computed crop {'width' if not w else 'height'} floored to 0")
    return (width - w) // 2, (height - h) // 2, w, h


def crop(pixels: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    x, y, w, h = box
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return pixels.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def center_crop(pixels: DataFrame, width: int, height: int, target_w: int, target_h: int) -> DataFrame:
    box = crop_box(width, height, target_w, target_h)
    return pixels if box == (0, 0, width, height) else crop(pixels, box)


def resize(pixels: DataFrame, width: int, height: int, to_w: int, to_h: int, how: Resample = Resample.TRIANGLE) -> DataFrame:
    """Pixels of every image resized from width x height to exactly to_w x to_h."""
    if min(width, height, to_w, to_h) <= 0:
        raise InvalidImage("resize to or from a side of 0")
    if (width, height) == (to_w, to_h):
        return pixels
    if how is Resample.NEAREST:
        return _nearest(pixels, width, height, to_w, to_h)
    wide = _weighted(pixels, "x", "y", kernel_weights(how, width, to_w), first=True)
    return _weighted(wide, "y", "x", kernel_weights(how, height, to_h), first=False)


def _nearest(pixels: DataFrame, width: int, height: int, to_w: int, to_h: int) -> DataFrame:
    """A source pixel stands at all targets whose centre it holds: runs of targets, so no join."""

    def run(axis: str, source: int, target: int):
        # o takes source s iff s <= (2 o + 1) source div (2 target) < s + 1
        first = F.ceil((2 * F.col(axis) * target - source) / F.lit(2.0 * source))
        last = F.ceil((2 * (F.col(axis) + 1) * target - source) / F.lit(2.0 * source)) - 1
        return F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(target - 1)).cast("int")

    (x0, x1), (y0, y1) = run("x", width, to_w), run("y", height, to_h)
    held = pixels.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).where("x0 <= x1 AND y0 <= y1")
    wide = held.select("image_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1", "r", "g", "b")
    return wide.select("image_id", "x", F.explode(F.sequence("y0", "y1")).alias("y"), "r", "g", "b")


def _sinc(x: float) -> float:
    return math.sin(math.pi * x) / (math.pi * x) if x else 1.0


#: Kernels with their reach: weight of a source pixel at a distance, in target pixels when shrinking and in source pixels else.
KERNELS: dict[Resample, tuple[float, Callable[[float], float]]] = {
    Resample.TRIANGLE: (1.0, lambda x: max(0.0, 1 - x)),
    Resample.CATMULL_ROM: (2.0, lambda x: 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0),
    Resample.GAUSSIAN: (3.0, lambda x: math.exp(-2 * x * x) if x < 3 else 0.0),
    Resample.LANCZOS3: (3.0, lambda x: _sinc(x) * _sinc(x / 3) if x < 3 else 0.0),
}


def kernel_weights(how: Resample, source: int, target: int) -> list[tuple[int, int, float]]:
    """(target, source, weight) of a normalised kernel that widens when shrinking."""
    reach, kernel = KERNELS[how]
    scale = source / target
    unit = max(1.0, scale)
    out = []
    for o in range(target):
        centre = (o + 0.5) * scale
        taps = [(s, kernel(abs(s + 0.5 - centre) / unit)) for s in range(max(0, int(centre - reach * unit) - 1), min(source, int(centre + reach * unit) + 2))]
        taps = [(s, w) for s, w in taps if w]
        total = sum(w for _, w in taps)
        out += [(o, s, w / total) for s, w in taps]
    return out


def _weighted(pixels: DataFrame, axis: str, other: str, weights: list[tuple[int, int, float]], first: bool) -> DataFrame:
    # a few rows per line of the larger side; sides are checked by the caller
    table = pixels.sparkSession.createDataFrame(weights, f"o int, {axis} int, w double")
    tapped = pixels.join(F.broadcast(table), axis)
    # sums of rounded integers do not depend on the order of rows
    sums = {c: F.sum(F.round(F.col(c) * F.col("w") * (1 << 30)).cast("long")) for c in "rgb"}
    out = tapped.groupBy("image_id", "o", other).agg(*(s.alias(c) for c, s in sums.items())).withColumnRenamed("o", axis)
    if first:
        return out.select("image_id", "x", "y", *((F.col(c) / float(1 << 30)).alias(c) for c in "rgb"))
    whole = [F.least(F.greatest(F.floor(F.col(c) / float(1 << 30) + 0.5), F.lit(0)), F.lit(255)).cast("int").alias(c) for c in "rgb"]
    return out.select("image_id", "x", "y", *whole)
