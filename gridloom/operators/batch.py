"""Geometry as a relation: crop and resampling of images of unlike sizes in one plan.

Pixels carry the size of their own image (``width``, ``height``), so cropping needs no
join. The weights of a kernel are a table by source side, made by expressions from the
distinct sides alone, and every pixel meets those of its side and place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.resample import KERNELS
from gridloom.options import Resample
from gridloom.scratch import stored

#: Sums are of integers of this unit, so they do not depend on the order of rows.
UNIT = 1 << 30


def crop_boxes(images: DataFrame, target_w: int, target_h: int) -> DataFrame:
    """images (width, height, ...) with cx, cy, cw, ch: the largest centred rectangle of ratio target_w : target_h; odd leftovers go right and below."""
    # the lesser of the side and what the other side allows, so a box of the image's own ratio is the image
    sized = images.withColumns({
        "cw": F.expr(f"least(CAST(width AS BIGINT), (CAST(height AS BIGINT) * {target_w}) div {target_h})"),
        "ch": F.expr(f"least(CAST(height AS BIGINT), (CAST(width AS BIGINT) * {target_h}) div {target_w})"),
    })
    return sized.withColumns({"cx": F.expr("(width - cw) div 2"), "cy": F.expr("(height - ch) div 2")})


def center_crops(pixels: DataFrame, target_w: int, target_h: int) -> DataFrame:
    """Pixels (image_id, width, height, x, y, r, g, b) inside the crop of their image, counted from its corner; width and height are those of the crop."""
    boxed = crop_boxes(pixels, target_w, target_h)
    inside = boxed.where((F.col("x") >= F.col("cx")) & (F.col("x") < F.col("cx") + F.col("cw")) & (F.col("y") >= F.col("cy")) & (F.col("y") < F.col("cy") + F.col("ch")))
    moved = [(F.col(a) - F.col(f"c{a}")).cast("int").alias(a) for a in "xy"]
    return inside.select("image_id", F.col("cw").cast("int").alias("width"), F.col("ch").cast("int").alias("height"), *moved, "r", "g", "b")


def _sinc(x: Column) -> Column:
    turn = x * F.pi()
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(turn) / turn)


_KERNELS: dict[Resample, Callable[[Column], Column]] = {
    Resample.TRIANGLE: lambda x: F.greatest(F.lit(0.0), 1 - x),
    Resample.CATMULL_ROM: lambda x: F.when(x < 1, 1.5 * x * x * x - 2.5 * x * x + 1).when(x < 2, -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2).otherwise(0.0),
    Resample.GAUSSIAN: lambda x: F.when(x < 3, F.exp(-2 * x * x)).otherwise(0.0),
    Resample.LANCZOS3: lambda x: F.when(x < 3, _sinc(x) * _sinc(x / 3)).otherwise(0.0),
}


def kernel_table(sides: DataFrame, target: int, how: Resample) -> DataFrame:
    """(side, o, s, w): for every side in sides, the normalised weight of its line s in line o of target lines. The kernel widens when shrinking; a side below 0 stands for one of target lines that is copied."""
    reach = KERNELS[how][0]
    scale = F.col("side") / F.lit(float(target))
    unit = F.greatest(F.lit(1.0), scale)
    lines = sides.where("side > 0").select("side", F.explode(F.sequence(F.lit(0), F.lit(target - 1))).alias("o"), unit.alias("unit"), scale.alias("scale"))
    lines = lines.withColumn("centre", (F.col("o") + 0.5) * F.col("scale"))
    first = F.greatest(F.lit(0), (F.col("centre") - reach * F.col("unit")).cast("int") - 1)
    last = F.least(F.col("side").cast("int"), (F.col("centre") + reach * F.col("unit")).cast("int") + 2) - 1
    taps = F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("s"), _KERNELS[how](F.abs(s + 0.5 - F.col("centre")) / F.col("unit")).alias("w")))
    held = lines.withColumn("taps", taps).withColumn("total", F.aggregate("taps", F.lit(0.0), lambda a, t: a + t["w"]))
    weighted = held.select("side", "o", "total", F.inline("taps")).where("w <> 0").select("side", "o", "s", (F.col("w") / F.col("total")).alias("w"))
    copied = sides.where("side < 0").select("side", F.explode(F.sequence(F.lit(0), F.lit(target - 1))).alias("o")).select("side", "o", F.col("o").alias("s"), F.lit(1.0).alias("w"))
    return weighted.unionByName(copied)


def resize_all(pixels: DataFrame, images: DataFrame, to_w: int, to_h: int, how: Resample = Resample.TRIANGLE) -> DataFrame:
    """Pixels (image_id, x, y, r, g, b) of every image resized to exactly to_w x to_h; images (width, height) has the size of each. Images of that size are copied."""
    same = (F.col("width") == to_w) & (F.col("height") == to_h)
    keyed = {f"side_{a}": F.when(same, -F.col(side)).otherwise(F.col(side)).cast("int") for a, side in (("x", "width"), ("y", "height"))}
    if how is Resample.NEAREST:
        return _nearest_all(pixels, to_w, to_h)
    # a row per distinct size, written so that the geometry is not computed again in every weight
    sizes = stored(images.select("width", "height").distinct(), "sizes").withColumns(keyed)
    pixels = pixels.withColumns(keyed)
    for axis, other, target in (("x", "y", to_w), ("y", "x", to_h)):
        table = kernel_table(sizes.select(F.col(f"side_{axis}").alias("side")).distinct(), target, how).withColumnsRenamed({"side": f"side_{axis}", "s": axis})
        tapped = pixels.join(table, [f"side_{axis}", axis])
        rest = ["side_y"] if axis == "x" else []
        sums = tapped.groupBy("image_id", "o", other, *rest).agg(*(F.sum(F.round(F.col(c) * F.col("w") * UNIT).cast("long")).alias(c) for c in "rgb"))
        pixels = sums.withColumnRenamed("o", axis).withColumns({c: F.col(c) / float(UNIT) for c in "rgb"})
    return pixels.select("image_id", "x", "y", *(F.least(F.greatest(F.floor(F.col(c) + 0.5), F.lit(0)), F.lit(255)).cast("int").alias(c) for c in "rgb"))


def _nearest_all(pixels: DataFrame, to_w: int, to_h: int) -> DataFrame:
    """A source pixel stands at the run of targets whose centre it holds."""

    def run(axis: str, side: str, target: int) -> tuple[Column, Column]:
        source = F.col(side)
        first = F.ceil((2 * F.col(axis) * target - source) / (2.0 * source))
        last = F.ceil((2 * (F.col(axis) + 1) * target - source) / (2.0 * source)) - 1
        return F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(target - 1)).cast("int")

    (x0, x1), (y0, y1) = run("x", "width", to_w), run("y", "height", to_h)
    held = pixels.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).where("x0 <= x1 AND y0 <= y1")
    wide = held.select("image_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1", "r", "g", "b")
    return wide.select("image_id", "x", F.explode(F.sequence("y0", "y1")).alias("y"), "r", "g", "b")
