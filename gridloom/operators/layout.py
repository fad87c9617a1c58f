"""Geometry of interactive boards and crops, as expressions over tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.options import SETTINGS, Generator

# Frame ratios, preset sides, greatest zoom, side, border and saved edge.
ASPECTS = ((1, 1), (2, 3), (3, 4), (4, 5), (9, 16))
PRESET_SIDES = (50, 80, 100)
MOST_ZOOM, MOST_SIDE, MOST_BORDER, MOST_EDGE, MOST_U32 = 8.0, 1000, 8, 4096, 4_294_967_295


def _clamp(value: Column, low: Column | int, high: Column | int) -> Column:
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(wrap(low), F.least(value, wrap(high)))


def cover_scale(w: Column, h: Column, aspect: Column) -> Column:
    return F.greatest(aspect / w, 1.0 / h)


def crop_rect(requests: DataFrame) -> DataFrame:
    """requests(src_w, src_h, aspect, zoom, pan_x, pan_y, turns) with the crop's x, y, w, h in the turned image."""
    odd = F.abs("turns") % 2 == 1
    iw, ih = F.when(odd, F.col("src_h")).otherwise(F.col("src_w")), F.when(odd, F.col("src_w")).otherwise(F.col("src_h"))
    sized = requests.withColumns({"_iw": iw.cast("int"), "_ih": ih.cast("int"), "_z": F.greatest(F.col("zoom"), F.lit(1.0))})
    cut = sized.withColumns({
        "_cw": F.least(F.col("_iw").cast("double"), F.col("aspect") * F.col("_ih")) / F.col("_z"),
        "_ch": F.least(F.col("_ih").cast("double"), F.col("_iw") / F.col("aspect")) / F.col("_z"),
    })
    sides = cut.withColumns({"w": _clamp(F.round("_cw").cast("int"), 1, F.col("_iw")), "h": _clamp(F.round("_ch").cast("int"), 1, F.col("_ih"))})

    def place(full: str, part: str, pan: str, side: str) -> Column:
        slack = F.greatest(F.lit(0.0), F.col(full) - F.col(part))
        return _clamp(F.round(slack / 2.0 * (1.0 + _clamp(F.col(pan), -1, 1))).cast("int"), 0, F.col(full) - F.col(side))

    placed = sides.withColumns({"x": place("_iw", "_cw", "pan_x", "w"), "y": place("_ih", "_ch", "pan_y", "h")})
    return placed.drop("_iw", "_ih", "_z", "_cw", "_ch")


def turned(pixels: DataFrame, width: int, height: int, turns: int, flip: bool = False) -> DataFrame:
    """Pixels turned clockwise by quarter turns, then mirrored from left to right."""
    x, y, w, h = F.col("x"), F.col("y"), width, height
    for _ in range(turns % 4):
        x, y, w, h = F.lit(h - 1) - y, x, h, w
    return pixels.select("image_id", (F.lit(w - 1) - x if flip else x).cast("int").alias("x"), y.cast("int").alias("y"), "r", "g", "b")


def locked_pair(requests: DataFrame) -> DataFrame:
    """requests(value, aspect, by_width) with w and h: the other side follows the ratio, and both shrink if one is too long."""
    w = F.when(F.col("by_width"), F.col("value").cast("double")).otherwise(F.col("value") * F.col("aspect"))
    h = F.when(F.col("by_width"), F.col("value") / F.col("aspect")).otherwise(F.col("value").cast("double"))
    longest = F.greatest(w, h)
    fit = lambda side: _clamp(F.round(F.when(longest > MOST_SIDE, side * MOST_SIDE / longest).otherwise(side)).cast("int"), 1, MOST_SIDE)
    return requests.withColumns({"w": fit(w), "h": fit(h)})


def presets(aspects: DataFrame) -> DataFrame:
    """aspects(aspect) with the distinct preset sizes w, h."""
    sides = aspects.select("aspect", F.explode(F.array(*map(F.lit, PRESET_SIDES))).alias("w"))
    return sides.select("aspect", "w", _clamp(F.round(F.col("w") / F.col("aspect")).cast("int"), 1, MOST_SIDE).alias("h")).distinct()


def stepped(side: Column, delta: int) -> Column:
    return _clamp(F.coalesce(side, F.lit(0)) + delta, 1, MOST_SIDE)


def aspect_presets(aspects: DataFrame) -> DataFrame:
    """aspects(landscape boolean) with every frame ratio as w, h, sides swapped for landscape."""
    table = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ASPECTS))).alias("s")
    own = aspects.select("landscape", table)
    return own.select("landscape", F.when(F.col("landscape"), F.col("s.b")).otherwise(F.col("s.a")).alias("w"), F.when(F.col("landscape"), F.col("s.a")).otherwise(F.col("s.b")).alias("h")).distinct()


def board(boards: DataFrame) -> DataFrame:
    """boards(width, height, border, cell) with margins, board and canvas sizes and the content's origin."""
    unit = F.col("cell") / 5.0
    digits = F.length((F.floor(F.col("height") / 10) * 10).cast("string"))
    margins = boards.withColumns({"left": F.when(F.col("height") >= 10, unit * (4 * digits + 1)).otherwise(F.lit(0.0)), "top": F.when(F.col("width") >= 10, 7 * unit).otherwise(F.lit(0.0))})
    cols, rows = F.col("width") + 2 * F.col("border"), F.col("height") + 2 * F.col("border")
    return margins.withColumns({
        "board_cols": cols, "board_rows": rows,
        "content_x": F.col("left") + F.col("border") * F.col("cell"), "content_y": F.col("top") + F.col("border") * F.col("cell"),
        "canvas_w": F.col("left") + cols * F.col("cell"), "canvas_h": F.col("top") + rows * F.col("cell"),
    })


def ticks(boards: DataFrame) -> DataFrame:
    """boards with axis ('col' or 'row'), n and at: the bold lines of every tenth boundary."""
    laid = board(boards)
    keys = boards.columns
    tens = lambda side: F.when(F.col(side) >= 10, F.sequence(F.lit(10), F.col(side).cast("int"), F.lit(10))).otherwise(F.array().cast("array<int>"))
    cols = laid.select(*keys, F.lit("col").alias("axis"), "content_x", F.explode(tens("width")).alias("n")).withColumn("at", F.col("content_x") + F.col("n") * F.col("cell")).drop("content_x")
    rows = laid.select(*keys, F.lit("row").alias("axis"), "content_y", F.explode(tens("height")).alias("n")).withColumn("at", F.col("content_y") + F.col("n") * F.col("cell")).drop("content_y")
    return cols.unionByName(rows)


def hit_test(taps: DataFrame) -> DataFrame:
    """taps(width, height, border, cell, px, py) with row and col of the content cell, null outside."""
    laid = board(taps)
    col = (F.floor((F.col("px") - F.col("left")) / F.col("cell")) - F.col("border")).cast("int")
    row = (F.floor((F.col("py") - F.col("top")) / F.col("cell")) - F.col("border")).cast("int")
    inside = col.between(0, F.col("width") - 1) & row.between(0, F.col("height") - 1)
    return laid.select(*taps.columns, F.when(inside, row).alias("row"), F.when(inside, col).alias("col"))


def viewport_to_canvas(taps: DataFrame) -> DataFrame:
    """taps with (tap - offset) / scale - origin as px, py."""
    return taps.withColumns({"px": (F.col("tap_x") - F.col("offset_x")) / F.col("scale") - F.col("origin_x"), "py": (F.col("tap_y") - F.col("offset_y")) / F.col("scale") - F.col("origin_y")})


def cell_centre(places: DataFrame) -> DataFrame:
    """places(width, height, border, cell, row, col) with the cell's centre px, py."""
    laid = board(places)
    return laid.select(*places.columns, (F.col("content_x") + (F.col("col") + 0.5) * F.col("cell")).alias("px"), (F.col("content_y") + (F.col("row") + 0.5) * F.col("cell")).alias("py"))


def save_cell(boards: DataFrame) -> DataFrame:
    """boards(width, height, border) with the cell size of a saved image."""
    span = F.greatest("width", "height") + 2 * F.col("border")
    first = boards.withColumn("cell", _clamp(F.floor(MOST_EDGE / span), 4, 10).cast("double"))
    laid = board(first)
    longest = F.greatest("canvas_w", "canvas_h")
    return laid.select(*boards.columns, F.when(longest > MOST_EDGE, F.col("cell") * MOST_EDGE / longest).otherwise(F.col("cell")).alias("cell"))


def read_u32(text: Column) -> Column:
    """Text as 0 to 2^32 - 1, clamped; null if empty or no number."""
    value = F.trim(text).try_cast("decimal(38,0)")
    return F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), _clamp(value, 0, MOST_U32)).cast("long")


def clamp_border(k: Column) -> Column:
    return _clamp(k, 0, MOST_BORDER)


def settings(stored: DataFrame, defaults: dict[str, str] = SETTINGS) -> DataFrame:
    """name and value of every preference: stored(name, value) over the defaults; unknown generators fall back, borders are clamped."""
    base = stored.sparkSession.createDataFrame(sorted(defaults.items()), "name string, fallback string")
    own = base.join(stored, "name", "left")
    known = ~((F.col("name") == "generator") & ~F.col("value").isin(*(g.value for g in Generator)))
    value = F.coalesce(F.when(known, F.col("value")), "fallback")
    rings = clamp_border(value.try_cast("int")).cast("string")
    return own.select("name", F.when(F.col("name") == "border_rings", F.coalesce(F.when(value.try_cast("int").isNotNull(), rings), "fallback")).otherwise(value).alias("value"))
