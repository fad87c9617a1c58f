"""Nearest palette colour of every pixel; of equal distances the lowest index counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import InvalidPalette
from gridloom.functions.colorspace import coordinates
from gridloom.operators.color_index import ColorIndex
from gridloom.options import Matcher

MOST_COLORS = 65_536

def check_palette_size(palette: DataFrame) -> int:
    """Number of colours; a palette is never empty nor larger than a 16-bit index reaches, which bounds what is broadcast."""
    size = palette.limit(MOST_COLORS + 1).count()
    if not size:
        raise InvalidPalette("palette has no colors")
    if size > MOST_COLORS:
        raise InvalidPalette(f"palette has more than {MOST_COLORS} colors")
    return size


def nearest(points: DataFrame, keys: list[str], palette: DataFrame, matcher: Matcher, ready: bool = False) -> DataFrame:
    """keys and idx for points(keys..., c0, c1, c2 if ready, else r, g, b); palette(idx, r, g, b).

    The palette, whose size is checked, goes to every task; points are matched where they
    are, batch by batch, each distinct point of a batch once, by an index of the palette,
    and nothing is shuffled.
    """
    check_palette_size(palette)
    own = coordinates(matcher)
    small = palette.select(F.col("idx").cast("int").alias("idx"), *(c.cast("double").alias(f"p{k}") for k, c in enumerate(own))).toPandas().sort_values("idx")
    shared = points.sparkSession.sparkContext.broadcast((small["idx"].to_numpy(dtype=np.int32), small[["p0", "p1", "p2"]].to_numpy(dtype=float)))
    placed = points.select(*keys, *(c.cast("double").alias(f"__c{k}") for k, c in enumerate((F.col("c0"), F.col("c1"), F.col("c2")) if ready else own)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx, colors = shared.value
        index = ColorIndex(colors)
        for batch in batches:
            here = batch[["__c0", "__c1", "__c2"]].to_numpy(dtype=float)
            distinct, at = np.unique(here, axis=0, return_inverse=True) if len(here) else (here, np.empty(0, np.int64))
            yield batch[keys].assign(idx=idx[index.closest(distinct)][at.ravel()])

    return placed.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*keys).schema) + ", idx int")


def match_pattern(pixels: DataFrame, palette: DataFrame, matcher: Matcher = Matcher.OKLAB) -> DataFrame:
    """Cells (image_id, x, y, idx) of pixels (image_id, x, y, r, g, b)."""
    return nearest(pixels, ["image_id", "x", "y"], palette, matcher)
