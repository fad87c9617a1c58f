"""Reduction to a number of colours: the least used colour is merged into its nearest one in use."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import InvalidImage, InvalidPalette
from gridloom.functions.colorspace import coordinates
from gridloom.operators.color_index import merge_plan
from gridloom.operators.match import check_palette_size
from gridloom.options import Matcher


def reduce_colors(cells: DataFrame, palette: DataFrame, most: int, matcher: Matcher = Matcher.OKLAB) -> DataFrame:
    """Cells with at most ``most`` colours per image; only the usage table (a palette's size per image) leaves the JVM."""
    if most <= 0:
        raise InvalidImage("max_colors must be at least 1")
    check_palette_size(palette)
    usage = cells.groupBy("image_id", "idx").agg(F.count("*").alias("n"))
    if usage.join(F.broadcast(palette.select("idx")), "idx", "left_anti").limit(1).count():
        raise InvalidPalette("a cell's index is beyond the palette")
    placed = usage.join(F.broadcast(palette.select("idx", *(c.cast("double").alias(f"c{k}") for k, c in enumerate(coordinates(matcher))))), "idx")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        stands = merge_plan(dict(zip(rows["idx"], rows["n"])), {i: c for i, *c in rows[["idx", "c0", "c1", "c2"]].itertuples(index=False)}, most)
        return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "idx": list(stands), "rep": list(stands.values())})

    remap = placed.groupBy("image_id").applyInPandas(merge, f"image_id {cells.schema['image_id'].dataType.simpleString()}, idx int, rep int")
    return cells.join(remap, ["image_id", "idx"]).select("image_id", "x", "y", F.col("rep").alias("idx"))
