"""From pixels to finished patterns: crop, resize or superpixels, match, reduce, despeckle, statistics, renders.

Images may differ in size; what goes wrong with one is a row, and the others go on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.errors import InvalidImage
from gridloom.operators import render, stats
from gridloom.operators.batch import center_crops, crop_boxes, resize_all
from gridloom.operators.despeckle import despeckle
from gridloom.operators.match import MOST_COLORS, match_pattern
from gridloom.operators.reduce import reduce_colors
from gridloom.operators.superpixel import superpixels_all
from gridloom.options import GenerateOptions, Generator
from gridloom.scratch import stored


@dataclass(frozen=True)
class Pattern:
    """Generated patterns of one size; everything derives from cells and the palette they were made with. faults: image_id, kind and reason of the images that have none."""

    cells: DataFrame
    palette: DataFrame
    brand: str
    width: int
    height: int
    options: GenerateOptions
    faults: DataFrame | None = None

    @property
    def sizes(self) -> DataFrame:
        return self.cells.select("image_id").distinct().select("image_id", F.lit(self.width).alias("width"), F.lit(self.height).alias("height"))

    def stats(self) -> DataFrame:
        return stats.count_colors(self.cells, self.palette)

    def summary(self) -> DataFrame:
        return stats.summary(self.cells, self.palette, self.sizes, self.brand)

    def json(self) -> DataFrame:
        return stats.pattern_json(self.cells, self.palette, self.sizes, self.brand)

    def preview(self) -> DataFrame:
        return render.preview(self.cells, self.palette, self.width, self.height, self.options.render.cell_size)

    def grid(self) -> DataFrame:
        return render.grid(self.cells, self.palette, self.width, self.height, self.options.render.cell_size)


    def files(self, folders: DataFrame) -> DataFrame:
        """name, part and body: the four files of every image in fragments, below its folder of folders (image_id, folder; empty for none)."""
        scale = self.options.render.cell_size
        grid = render.geometry(self.width, self.height, scale)
        summary = self.summary().select("image_id", F.lit(0).alias("part"), F.col("summary").cast("binary").alias("body"))
        made = {
            "preview.png": render.png_parts(self.preview(), self.width * scale, self.height * scale), "grid.png": render.png_parts(self.grid(), grid.width, grid.height),
            "pattern.json": stats.json_parts(self.cells, self.palette, self.sizes, self.brand), "summary.txt": summary,
        }
        parts = reduce(DataFrame.unionByName, [df.withColumn("file", F.lit(name)) for name, df in made.items()])
        name = F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/"))), "file")
        return parts.join(folders, "image_id").select(name.alias("name"), "part", "body")


def _always(broken: bool) -> Column:
    return F.lit(bool(broken))


def _render_fault(options: GenerateOptions) -> str | None:
    try:
        render.checked_preview(options.width, options.height, options.render.cell_size)
        render.geometry(options.width, options.height, options.render.cell_size)
    except InvalidImage as fault:
        return str(fault)
    return None


def image_faults(images: DataFrame, palette_size: int, options: GenerateOptions) -> DataFrame:
    """image_id, kind and reason of the first fault of each of images (image_id, width, height, bad) that has one.

    Faults come in a fixed order, whatever else is wrong: a target side of 0, bytes that do
    not decode, a crop without lines, a superpixel target beyond its source, max_colors
    below 1, the palette's size, a render that cannot be drawn.
    """
    w, h = options.width, options.height
    target = f"target {w}x{h} exceeds source "
    over = options.generator is Generator.SUPERPIXEL
    sizes = crop_boxes(images, max(w, 1), max(h, 1))
    drawn = _render_fault(options) if w > 0 and h > 0 else None
    steps = [
        ("InvalidImage", _always(w <= 0), F.lit("target width is 0")),
        ("InvalidImage", _always(h <= 0), F.lit("target height is 0")),
        ("ImageDecode", F.col("bad").isNotNull(), F.col("bad")),
        ("InvalidImage", F.coalesce(F.col("width") <= 0, _always(True)), F.lit("source width is 0")),
        ("InvalidImage", F.coalesce(F.col("height") <= 0, _always(True)), F.lit("source height is 0")),
        ("InvalidImage", F.col("cw") == 0, F.lit("computed crop width floored to 0")),
        ("InvalidImage", F.col("ch") == 0, F.lit("computed crop height floored to 0")),
        ("InvalidImage", _always(over) & ((F.col("cw") < w) | (F.col("ch") < h)), F.concat(F.lit(target), F.col("cw").cast("string"), F.lit("x"), F.col("ch").cast("string"))),
        ("InvalidImage", _always(options.max_colors is not None and options.max_colors <= 0), F.lit("max_colors must be at least 1")),
        ("InvalidPalette", _always(palette_size == 0), F.lit("palette has no colors")),
        ("InvalidPalette", _always(palette_size > MOST_COLORS), F.lit(f"palette has more than {MOST_COLORS} colors")),
        ("InvalidImage", _always(drawn is not None), F.lit(drawn or "")),
    ]
    first = F.coalesce(*(F.when(broken, F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))) for kind, broken, reason in steps))
    return sizes.select("image_id", first.alias("fault")).where("fault IS NOT NULL").select("image_id", "fault.*")


def generate_all(images: DataFrame, pixels: DataFrame, palette: DataFrame, brand: str, options: GenerateOptions) -> Pattern:
    """Patterns of all sound images of images (image_id, width, height, bad), of any sizes, from pixels (image_id, width, height, x, y, r, g, b); the others are rows of faults."""
    size = palette.limit(MOST_COLORS + 1).count()
    faults = stored(image_faults(images, size, options), "faults")
    sound = images.join(faults, "image_id", "left_anti")
    if sound.isEmpty():
        kind = images.schema["image_id"].dataType.simpleString()
        none = images.sparkSession.createDataFrame([], f"image_id {kind}, x int, y int, idx int")
        return Pattern(none, palette, brand, options.width, options.height, options, faults)
    sound = stored(sound.select("image_id", "width", "height"), "images")
    cut = center_crops(pixels.join(faults.select("image_id"), "image_id", "left_anti"), options.width, options.height)
    if options.generator is Generator.SUPERPIXEL:
        cells = superpixels_all(cut, palette, options.width, options.height)
    else:
        boxes = crop_boxes(sound, options.width, options.height).select(F.col("cw").cast("int").alias("width"), F.col("ch").cast("int").alias("height"))
        cells = match_pattern(resize_all(cut, boxes, options.width, options.height, options.resample), palette, options.matcher)
    if options.max_colors is not None:
        cells = reduce_colors(stored(cells, "cells"), palette, options.max_colors, options.matcher)
    if options.despeckle:
        target = sound.select("image_id", F.lit(options.width).alias("width"), F.lit(options.height).alias("height"))
        cells = despeckle(stored(cells, "cells"), options.despeckle, target)
    return Pattern(stored(cells, "cells"), palette, brand, options.width, options.height, options, faults)


def generate(pixels: DataFrame, width: int, height: int, palette: DataFrame, brand: str, options: GenerateOptions) -> Pattern:
    """The patterns of all images in pixels (image_id, x, y, r, g, b), which are of one size; a fault is raised."""
    sized = pixels.withColumns({"width": F.lit(width), "height": F.lit(height)})
    images = sized.select("image_id", "width", "height").distinct().withColumn("bad", F.lit(None).cast("string"))
    made = generate_all(images, sized, palette, brand, options)
    fault = made.faults.first()
    if fault:
        raise getattr(errors, fault["kind"])(fault["reason"])
    return made
