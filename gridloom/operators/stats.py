"""Counts, summaries and look-ups of cell grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_colors(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """image_id, rank, idx, code, name, count of the used colours: most used first, then by index; unknown indices are left out."""
    used = cells.groupBy("image_id", "idx").agg(F.count("*").alias("count"))
    order = Window.partitionBy("image_id").orderBy(F.desc("count"), "idx")  # at most a palette's rows per image
    return used.join(palette.select("idx", "code", "name"), "idx").select("image_id", F.row_number().over(order).alias("rank"), "idx", "code", "name", "count")


def totals(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """image_id, total (all cells), known (cells of the palette) and wrong_palette."""
    joined = cells.join(palette.select("idx", F.lit(1).alias("hit")), "idx", "left")
    out = joined.groupBy("image_id").agg(F.count("*").alias("total"), F.count("hit").alias("known"))
    return out.withColumn("wrong_palette", F.col("known") < F.col("total"))


def summary(cells: DataFrame, palette: DataFrame, sizes: DataFrame, brand: str) -> DataFrame:
    """image_id and summary text for sizes(image_id, width, height): four header lines, a blank one, a line per colour."""
    line = F.concat("code", F.lit(" "), "name", F.lit(": "), F.col("count").cast("string"), F.lit("\n"))
    lines = count_colors(cells, palette).groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "").alias("lines"))
    counted = sizes.join(cells.groupBy("image_id").agg(F.count("*").alias("total")), "image_id", "left").join(lines, "image_id", "left")
    text = F.concat(
        F.lit("Bead Pattern Summary\nSize: "), F.col("width").cast("string"), F.lit(" x "), F.col("height").cast("string"),
        F.lit("\nTotal Beads: "), F.coalesce("total", F.lit(0)).cast("string"), F.lit(f"\nPalette: {brand}\n\n"), F.coalesce("lines", F.lit("")),
    )
    return counted.select("image_id", text.alias("summary"))


def distinct_colors(cells: DataFrame) -> DataFrame:
    return cells.groupBy("image_id").agg(F.countDistinct("idx").alias("colors"))


def legend(cells: DataFrame, palette: DataFrame, top: int = 5) -> DataFrame:
    """The first colours by rank with their swatches."""
    ranked = count_colors(cells, palette).where(F.col("rank") <= top)
    return ranked.join(palette.select("idx", "r", "g", "b"), "idx").select("image_id", "rank", "code", "name", "count", "r", "g", "b")


def highlight(cells: DataFrame, idx: int) -> DataFrame:
    return cells.where(F.col("idx") == idx)


def cell_detail(cells: DataFrame, palette: DataFrame, x: int, y: int) -> DataFrame:
    """idx, code, name and count of the colour of one cell of each image."""
    at = cells.where((F.col("x") == x) & (F.col("y") == y)).select("image_id", "idx")
    return at.join(count_colors(cells, palette).drop("rank"), ["image_id", "idx"])


def pattern_json(cells: DataFrame, palette: DataFrame, sizes: DataFrame, brand: str) -> DataFrame:
    """image_id and the pattern document, keys in order brand, width, height, cells, total, stats."""
    packed = cells.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "idx"))), lambda c: c["idx"]).alias("cells"), F.count("*").alias("total"))
    ranked = count_colors(cells, palette)
    stats = ranked.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code", "name", "count"))), lambda s: F.struct(s["code"].alias("code"), s["name"].alias("name"), s["count"].alias("count"))).alias("stats"))
    whole = sizes.join(packed, "image_id", "left").join(stats, "image_id", "left")
    return whole.select("image_id", F.to_json(F.struct(F.lit(brand).alias("brand"), "width", "height", F.coalesce("cells", F.array().cast("array<int>")).alias("cells"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("stats", F.array().cast("array<struct<code:string,name:string,count:bigint>>")).alias("stats"))).alias("pattern"))


def json_parts(cells: DataFrame, palette: DataFrame, sizes: DataFrame, brand: str, band: int = 64) -> DataFrame:
    """image_id, part and body (binary): the document of :func:`pattern_json` in fragments of ``band`` rows of the grid each, to be joined by part."""
    row = F.floor(F.col("y") / band).cast("int")
    placed = F.sort_array(F.collect_list(F.struct("y", "x", "idx")))
    bands = cells.groupBy("image_id", row.alias("band")).agg(F.array_join(F.transform(placed, lambda c: c["idx"].cast("string")), ",").alias("body"))
    counted = cells.groupBy("image_id").agg(F.count("*").alias("total"), F.min(row).alias("first"))
    middle = bands.join(counted, "image_id").select("image_id", (F.col("band") + 1).alias("part"), F.concat(F.when(F.col("band") > F.col("first"), ",").otherwise(""), "body").alias("body"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "code", "name", "count"))), lambda s: F.struct(s["code"].alias("code"), s["name"].alias("name"), s["count"].alias("count")))
    stats = count_colors(cells, palette).groupBy("image_id").agg(listed.alias("stats"))
    whole = sizes.join(counted, "image_id", "left").join(stats, "image_id", "left")
    opening = F.to_json(F.struct(F.lit(brand).alias("brand"), "width", "height"))
    closing = F.to_json(F.struct(F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("stats", F.array().cast("array<struct<code:string,name:string,count:bigint>>")).alias("stats")))
    ends = F.array(F.struct(F.lit(0).alias("part"), F.concat(F.expr("substring(opening, 1, length(opening) - 1)"), F.lit(',"cells":[')).alias("body")), F.struct(F.lit((1 << 31) - 1).alias("part"), F.concat(F.lit("],"), F.expr("substring(closing, 2)")).alias("body")))
    edges = whole.select("image_id", opening.alias("opening"), closing.alias("closing")).select("image_id", F.inline(ends))
    return middle.unionByName(edges).select("image_id", "part", F.col("body").cast("binary").alias("body"))
