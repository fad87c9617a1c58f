"""Superpixel generator: fixed rounds of assignment to the nearest of nine seeds, then snap to the palette."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import InvalidImage
from gridloom.functions.colorspace import oklab
from gridloom.operators.match import check_palette_size, nearest
from gridloom.options import Matcher
from gridloom.scratch import stored

#: Weight of distance in place, and number of rounds.
PLACE, ROUNDS = 0.1, 10
#: Coordinates are summed as integers of this unit, so sums do not depend on the order of rows.
UNIT = float(1 << 40)
#: Centres that are sent to every task, at most.
SHARED = 200_000
#: What tells the parts of tiles apart, and pixels of one, about.
TILE, TILE_PIXELS = ("image_id", "ti", "tj", "part"), 1 << 16


def _summed(own: pd.DataFrame, centres: np.ndarray, hx: np.ndarray, hy: np.ndarray, wide: int, high: int) -> np.ndarray:
    """Per cell of a wide x high grid of centres (cx, cy, c0, c1, c2; NaN for none): number of the pixels of own, of home cells (hx, hy), that it is nearest to, and sums of their colour and place."""
    total = np.zeros((wide * high, 6), dtype=np.int64)
    if not len(own):
        return total
    sx, sy = float(own["sx"].iloc[0]), float(own["sy"].iloc[0])
    x, y = (own[c].to_numpy(dtype=np.int64) for c in "xy")
    v = own[["v0", "v1", "v2"]].to_numpy(dtype=float)
    best, chosen = np.full(len(own), np.inf), np.zeros(len(own), dtype=np.int64)
    for dj in (-1, 0, 1):  # by row, then by column, so that of equal distances the first stays
        for di in (-1, 0, 1):
            i, j = hx + di, hy + dj
            inside = (i >= 0) & (i < wide) & (j >= 0) & (j < high)
            seed = np.where(inside, j * wide + i, 0)
            c = centres[seed]
            p, q, r = (v[:, k] - c[:, 2 + k] for k in range(3))
            dx, dy = (x - c[:, 0]) / sx, (y - c[:, 1]) / sy
            far = p * p + q * q + r * r + PLACE * PLACE * (dx * dx + dy * dy)
            ok = inside & (far < best)
            best[ok], chosen[ok] = far[ok], seed[ok]
    scaled = v * UNIT
    whole = (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(np.int64)
    np.add.at(total, chosen, np.column_stack([np.ones(len(own), dtype=np.int64), whole, x, y]))
    return total


def _assigned(points: DataFrame, centres: pd.DataFrame, to_w: int, to_h: int) -> DataFrame:
    """Per seed (image_id, i, j) with pixels: their number n, and sums of colour (s0, s1, s2) and place (tx, ty).

    The centres, whose number is checked, go to every task, which compares nine of them
    for each pixel where it is; only sums per seed and task are shuffled.
    """
    ordered = centres.sort_values(["image_id", "j", "i"])
    shared = points.sparkSession.sparkContext.broadcast({image: own[["cx", "cy", "c0", "c1", "c2"]].to_numpy(dtype=float) for image, own in ordered.groupby("image_id", dropna=False)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, own in batch.groupby("image_id", dropna=False):
                total = _summed(own, shared.value[image], own["hx"].to_numpy(np.int64), own["hy"].to_numpy(np.int64), to_w, to_h)
                at = np.flatnonzero(total[:, 0])
                yield pd.DataFrame(total[at], columns=["n", "s0", "s1", "s2", "tx", "ty"]).assign(image_id=image, i=at % to_w, j=at // to_w)

    kind = points.schema["image_id"].dataType.simpleString()
    parts = points.mapInPandas(run, f"image_id {kind}, i int, j int, n long, s0 long, s1 long, s2 long, tx long, ty long")
    return parts.groupBy("image_id", "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "s0", "s1", "s2", "tx", "ty")))


def _laid_out(points: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """Points as a table of that name, bucketed by tiles of their home cells, with (cells along a tile's side, parts of a tile): the one time that pixels are shuffled.

    A tile has about ``TILE_PIXELS`` pixels; where a single cell has more, its lines are
    dealt to several parts.
    """
    spark = points.sparkSession
    per_cell = points.agg(F.max(F.col("sx") * F.col("sy"))).first()[0] or 1.0
    side = max(1, int((TILE_PIXELS / per_cell) ** 0.5))
    parts = max(1, math.ceil(per_cell * side * side / (2 * TILE_PIXELS)))
    tiled = points.withColumns({"ti": F.floor(F.col("hx") / side).cast("int"), "tj": F.floor(F.col("hy") / side).cast("int"), "part": F.pmod(F.col("y"), F.lit(parts)).cast("int")})
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiled.repartition(buckets, *TILE).write.bucketBy(buckets, *TILE).saveAsTable(name)
    return spark.table(name), side, parts


def _tiled(points: DataFrame, centres: DataFrame, side: int, parts: int) -> DataFrame:
    """The same for more centres than are sent to tasks: tiles stay where they are, and the centres of their cells and of those around come to them."""

    def tiles(c: str) -> Column:
        return F.array_distinct(F.array(*(F.floor((F.col(c) + d) / side).cast("int") for d in (-1, 0, 1))))

    halo = centres.select("*", F.explode(tiles("i")).alias("ti")).select("*", F.explode(tiles("j")).alias("tj")).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    kind = points.schema["image_id"].dataType.simpleString()

    def run(key: tuple, own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        i0, j0, wide = key[1] * side - 1, key[2] * side - 1, side + 2
        known = np.full((wide * wide, 5), np.nan)  # the tile's cells with those around it
        known[(around["j"] - j0) * wide + around["i"] - i0] = around[["cx", "cy", "c0", "c1", "c2"]].to_numpy(dtype=float)
        total = _summed(own, known, own["hx"].to_numpy(np.int64) - i0, own["hy"].to_numpy(np.int64) - j0, wide, wide)
        at = np.flatnonzero(total[:, 0])
        return pd.DataFrame(total[at], columns=["n", "s0", "s1", "s2", "tx", "ty"]).assign(image_id=key[0], i=at % wide + i0, j=at // wide + j0)

    met = points.groupBy(*TILE).cogroup(halo.groupBy(*TILE)).applyInPandas(run, f"image_id {kind}, i int, j int, n long, s0 long, s1 long, s2 long, tx long, ty long")
    return met.groupBy("image_id", "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "s0", "s1", "s2", "tx", "ty")))


def superpixels(pixels: DataFrame, width: int, height: int, palette: DataFrame, to_w: int, to_h: int) -> DataFrame:
    """Cells (image_id, x, y, idx) of a to_w x to_h grid over every image of width x height pixels."""
    if to_w <= 0 or to_h <= 0:
        raise InvalidImage("target width or height is 0")
    if width < to_w or height < to_h:
        raise InvalidImage(f"target {to_w}x{to_h} exceeds source {width}x{height}")
    return superpixels_all(pixels.withColumns({"width": F.lit(width), "height": F.lit(height)}), palette, to_w, to_h)


def superpixels_all(pixels: DataFrame, palette: DataFrame, to_w: int, to_h: int) -> DataFrame:
    """Cells (image_id, x, y, idx) of a to_w x to_h grid over every image, none smaller than that; pixels carry the width and height of their own."""
    check_palette_size(palette)
    own = [c.alias(f"v{k}") for k, c in enumerate(oklab(F.col("r"), F.col("g"), F.col("b")))]
    sx, sy = F.col("width") / F.lit(float(to_w)), F.col("height") / F.lit(float(to_h))
    home_x = F.least(F.floor(F.col("x") / sx), F.lit(to_w - 1)).cast("int")
    home_y = F.least(F.floor(F.col("y") / sy), F.lit(to_h - 1)).cast("int")
    points = stored(pixels.select("image_id", "x", "y", *own, home_x.alias("hx"), home_y.alias("hy"), sx.alias("sx"), sy.alias("sy")), "points")

    places = pixels.select("image_id", "width", "height").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(to_h - 1))).alias("j")).select("*", F.explode(F.sequence(F.lit(0), F.lit(to_w - 1))).alias("i"))
    middle = lambda at, unit, side: F.least(F.floor((F.col(at) + 0.5) * unit + 0.5), F.col(side) - 1).cast("int")
    seeds = places.select("image_id", "i", "j", middle("i", sx, "width").alias("x"), middle("j", sy, "height").alias("y"))
    centres = stored(seeds.join(points, ["image_id", "x", "y"]).select("image_id", "i", "j", F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), *(F.col(f"v{k}").alias(f"c{k}") for k in range(3))), "centres")
    few = centres.count() <= SHARED
    name = f"gridloom_points_{uuid.uuid4().hex}"
    if not few:
        points, side, parts = _laid_out(points, name)
    for _ in range(ROUNDS):
        sums = _assigned(points, centres.toArrow().to_pandas(), to_w, to_h) if few else _tiled(points, centres, side, parts)
        n = F.col("n")
        means = sums.select("image_id", "i", "j", *((F.col(f"s{k}") / n / UNIT).alias(f"n{k}") for k in range(3)), (F.col("tx") / n).alias("nx"), (F.col("ty") / n).alias("ny"))
        moved = centres.join(means, ["image_id", "i", "j"], "left")
        centres = stored(moved.select("image_id", "i", "j", F.coalesce("nx", "cx").alias("cx"), F.coalesce("ny", "cy").alias("cy"), *(F.coalesce(f"n{k}", f"c{k}").alias(f"c{k}") for k in range(3))), "centres")
    if not few:
        centres.sparkSession.sql(f"DROP TABLE {name}")
    snapped = nearest(centres.select("image_id", "i", "j", "c0", "c1", "c2"), ["image_id", "i", "j"], palette, Matcher.OKLAB, ready=True)
    return snapped.select("image_id", F.col("i").alias("x"), F.col("j").alias("y"), "idx")
