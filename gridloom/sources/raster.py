"""Rasters and palettes read from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100
#: Events to an image of a batch, and the widths that take turns.
IMAGE, SIZES = 500, (20, 25, 16, 40, 31)


def _place() -> list:
    return [F.lit(0).cast("long").alias("image_id"), (F.col("event_id") % WIDTH).cast("int").alias("x"), F.floor(F.col("event_id") / WIDTH).cast("int").alias("y")]


def _colours() -> list:
    return [(F.col("user_id") * 37 % 256).cast("int").alias("r"), (F.floor("value") % 256).cast("int").alias("g"), (F.col("event_id") * 7 % 256).cast("int").alias("b")]


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, r, g, b: one pixel per event, 100 to a row; event_id is dense from 0, so it is the place and no order is computed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*_place(), *_colours())


def event_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(images: image_id, width, height, bad; pixels: image_id, width, height, x, y, r, g, b): 500 events to an image, of five sizes; what is over a full line is left out."""
    place = F.col("event_id") % IMAGE
    width = F.element_at(F.array(*map(F.lit, SIZES)), (F.col("image_id") % len(SIZES) + 1).cast("int"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("image_id", F.floor(F.col("event_id") / IMAGE)).withColumn("width", width)
    sized = events.withColumn("height", F.floor(F.lit(IMAGE) / F.col("width")).cast("int"))
    images = sized.select("image_id", "width", "height", F.lit(None).cast("string").alias("bad")).distinct()
    placed = sized.select("image_id", "width", "height", (place % F.col("width")).cast("int").alias("x"), F.floor(place / F.col("width")).cast("int").alias("y"), *_colours()).where("y < height")
    return images, placed


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height, bad: an image file per event, some of a side of 0, errors unreadable."""
    bad = F.when(F.col("event_type") == "error", F.concat(F.lit("not a supported image: "), F.col("event_id").cast("string")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("image_id"), (F.col("user_id") % 50).cast("int").alias("width"), (F.col("event_id") % 37).cast("int").alias("height"), bad.alias("bad"))


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, idx: the event types as five indices."""
    types = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*_place(), (F.array_position(types, F.col("event_type")) - 1).cast("int").alias("idx"))


def part_palette(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    """idx, code, name, r, g, b: a colour for each size of part, from sums over all parts of the size; indices are step apart."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_size").agg(F.sum("p_partkey").alias("keys"), F.min("p_name").alias("name"))
    size = F.col("p_size")
    return parts.select(
        ((size - 1) * step).cast("int").alias("idx"), F.concat(F.lit("P"), size.cast("string")).alias("code"), "name",
        ((F.col("keys") + size) * 53 % 256).cast("int").alias("r"), ((F.col("keys") + size * 3) * 101 % 256).cast("int").alias("g"), (F.col("keys") * 11 % 256).cast("int").alias("b"),
    )
