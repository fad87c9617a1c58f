"""Images as pixel tables: a format gate on the bytes, then the JVM's decoder.

PNG and JPEG are read; WEBP has no decoder in the JVM and is refused like GIF, BMP, TIFF
and anything else. Alpha is dropped, not blended; grey becomes r = g = b; stored
orientation is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import ImageDecode

# The first bytes of the formats that are read.
PNG, JPEG = "89504E470D0A1A0A", "FFD8FF"


def supported(content: str):
    head = F.hex(F.substring(content, 1, 8))
    return head.startswith(PNG) | head.startswith(JPEG)


def _plain(path: str) -> Column:
    """A path as both of Spark's readers spell it."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for image_id, w, h, n, data in zip(batch["image_id"], batch["width"], batch["height"], batch["nChannels"], batch["data"]):
            flat = np.frombuffer(data, np.uint8).reshape(h, w, n)
            blue, green, red = (flat[:, :, min(k, n - 1) if n >= 3 else 0] for k in range(3))
            rows = max(1, (1 << 20) // max(w, 1))
            for lo in range(0, h, rows):
                y, x = np.mgrid[lo : min(h, lo + rows), 0:w]
                part = slice(lo, lo + rows)
                yield pd.DataFrame({"image_id": image_id, "width": w, "height": h, "x": x.ravel(), "y": y.ravel(), "r": red[part].ravel(), "g": green[part].ravel(), "b": blue[part].ravel()}).astype({c: "int32" for c in ("width", "height", *"xyrgb")})


def read_batch(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images: image_id, path, width, height, bad; pixels: image_id, width, height, x, y, r, g, b) of all files under a path.

    A file that is no image keeps its row, with the reason in bad and no size, and has no
    pixels; the others go on. image_id is a hash of the path.
    """
    files = spark.read.format("binaryFile").load(path).select(_plain("path").alias("path"), supported("content").alias("ok"))
    decoded = spark.read.format("image").load(path).select("image.*").withColumn("path", _plain("origin"))
    # the files that fail the gate are few or many; the planner decides how they meet the images
    passed = decoded.join(files.where(~F.col("ok")).select("path"), "path", "left_anti").where("width > 0 AND height > 0").withColumn("image_id", F.xxhash64("path"))
    sizes = passed.select("path", "width", "height")
    bad = F.when(~F.col("ok"), F.concat(F.lit("not a supported image: "), "path")).when(F.col("width").isNull(), F.concat(F.lit("cannot decode "), "path"))
    images = files.join(sizes, "path", "left").select(F.xxhash64("path").alias("image_id"), "path", "width", "height", bad.alias("bad"))
    pixels = passed.select("image_id", "width", "height", "nChannels", "data").mapInPandas(_pixels, "image_id long, width int, height int, x int, y int, r int, g int, b int")
    return images, pixels


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sizes: image_id, path, width, height; pixels: image_id, x, y, r, g, b) of the images under a path, all of which must be sound."""
    images, pixels = read_batch(spark, path)
    fault = images.where("bad IS NOT NULL").first()
    if fault:
        raise ImageDecode(fault["bad"])
    return images.drop("bad"), pixels.drop("width", "height")
