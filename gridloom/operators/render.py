"""Pixel tables of cell grids: plain previews and grids with lines and coordinates."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import InvalidImage
from gridloom.scratch import stored

# Greys of background, thin lines, bold lines and text; the missing colour; line width, label step.
BACK, THIN, BOLD, TEXT = 255, 200, 120, 0
MISSING = (255, 0, 255)
BOLD_WIDTH, STEP = 2, 10
# Digits 0 to 9 as five rows of three bits, left bit first.
GLYPHS = ("111101101101111", "010110010010111", "111001111100111", "111001111001111", "101101111001001", "111100111001111", "111100111101111", "111001010100100", "111101111101111", "111101111001111")
#: Pixels of a band of lines that is deflated by itself, unless a line has more; the modulus of the stream's checksum.
BAND_PIXELS, ADLER = 1 << 18, 65_521
MOST_SIDE, MOST_BYTES = (1 << 32) - 1, (1 << 63) - 1


@dataclass(frozen=True)
class Geometry:
    cell: int
    scale: int
    left: int
    top: int
    width: int
    height: int


def _checked(width: int, height: int, what: str) -> None:
    if width > MOST_SIDE or height > MOST_SIDE or 3 * width * height > MOST_BYTES:
        raise InvalidImage(f"{what} output is too large")


def number_width(value: int, scale: int) -> int:
    return len(str(value)) * 4 * scale - scale


def geometry(width: int, height: int, cell: int) -> Geometry:
    if cell < 5:
        raise InvalidImage("cell_size must be at least 5 for a grid")
    scale = max(1, cell // 5)
    top = 7 * scale if width >= STEP else 0
    left = number_width(height // STEP * STEP, scale) + 2 * scale if height >= STEP else 0
    _checked(left + width * cell, top + height * cell, "grid")
    return Geometry(cell, scale, left, top, left + width * cell, top + height * cell)


def colored(cells: DataFrame, palette: DataFrame, width: int, height: int) -> DataFrame:
    """r, g, b of every place of the grid; absent cells and unknown indices are magenta."""
    images = cells.select("image_id").distinct()
    places = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    known = cells.join(palette.select("idx", "r", "g", "b"), "idx", "left").drop("idx")
    return places.join(known, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *(F.coalesce(c, F.lit(v)).cast("int").alias(c) for c, v in zip("rgb", MISSING)))


def _painted(cells: DataFrame, cell: int, left: int, top: int) -> DataFrame:
    rows = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(cell - 1))).alias("dy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cell - 1))).alias("dx"))
    return rows.select("image_id", (left + F.col("x") * cell + F.col("dx")).alias("px"), (top + F.col("y") * cell + F.col("dy")).alias("py"), "r", "g", "b")


def checked_preview(width: int, height: int, cell: int) -> None:
    if cell <= 0:
        raise InvalidImage("cell_size must be at least 1")
    _checked(width * cell, height * cell, "preview")


def preview(cells: DataFrame, palette: DataFrame, width: int, height: int, cell: int = 10) -> DataFrame:
    """image_id, px, py, r, g, b: each cell a solid square."""
    checked_preview(width, height, cell)
    return _painted(colored(cells, palette, width, height), cell, 0, 0)


def label_pixels(width: int, height: int, g: Geometry) -> list[tuple[int, int]]:
    """Pixels of the coordinate labels."""
    labels = [(n, g.left + n * g.cell - number_width(n, g.scale), g.scale) for n in range(STEP, width + 1, STEP)]
    labels += [(n, g.left - g.scale - number_width(n, g.scale), g.top + (n - 1) * g.cell) for n in range(STEP, height + 1, STEP)]
    out = set()
    for n, x, y in labels:
        for k, digit in enumerate(str(n)):
            for bit, on in enumerate(GLYPHS[int(digit)]):
                if on == "1":
                    x0, y0 = x + (4 * k + bit % 3) * g.scale, y + bit // 3 * g.scale
                    out |= {(a, b) for a in range(x0, x0 + g.scale) for b in range(y0, y0 + g.scale) if a < g.width and b < g.height}
    return sorted(out)


def _line(at: Column, cells: int, cell: int, bold: bool) -> Column:
    """Whether a pixel at ``at`` from the cells' edge lies on a boundary line of an axis; the far edge is drawn on its last pixel."""
    inside, last = F.floor(at / cell), cells * cell - 1
    if not bold:
        return ((at % cell == 0) & (inside % STEP != 0)) | (F.lit(cells % STEP != 0) & (at == last))
    return ((at % cell < BOLD_WIDTH) & (inside % STEP == 0)) | (F.lit(cells % STEP == 0) & (at == last))


def grid(cells: DataFrame, palette: DataFrame, width: int, height: int, cell: int = 10) -> DataFrame:
    """image_id, px, py, r, g, b: background, beads, thin lines, bold lines and labels, each over what stands before."""
    g = geometry(width, height, cell)
    beads = _painted(colored(cells, palette, width, height), cell, g.left, g.top)
    ax, ay = F.col("px") - g.left, F.col("py") - g.top
    bold = _line(ax, width, cell, True) | _line(ay, height, cell, True)
    thin = _line(ax, width, cell, False) | _line(ay, height, cell, False)
    lined = beads.select("image_id", "px", "py", *(F.when(bold, F.lit(BOLD)).when(thin, F.lit(THIN)).otherwise(F.col(c)).alias(c) for c in "rgb"))
    images = cells.select("image_id").distinct()
    everything = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(g.height - 1))).alias("py")).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(g.width - 1))).alias("px"), "py")
    margin = everything.where((F.col("px") < g.left) | (F.col("py") < g.top)).select("image_id", "px", "py", *(F.lit(BACK).alias(c) for c in "rgb"))
    text = label_pixels(width, height, g)
    painted = lined.unionByName(margin)
    if not text:
        return painted
    ink = cells.sparkSession.createDataFrame(text, "px int, py int").withColumn("ink", F.lit(True))
    return painted.join(F.broadcast(ink), ["px", "py"], "left").select("image_id", "px", "py", *(F.when(F.col("ink"), F.lit(TEXT)).otherwise(F.col(c)).alias(c) for c in "rgb"))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _head(width: int, height: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))


def _filtered(array: np.ndarray, above: np.ndarray | None = None) -> bytes:
    """Lines of rows x columns x 3 bytes, each by the filter whose differences sum up least; above is the line over the first."""
    height, width, _ = array.shape
    left, up, both = (np.zeros((height, width, 3), np.int16) for _ in range(3))
    here = array.astype(np.int16)
    left[:, 1:], up[1:], both[1:, 1:] = here[:, :-1], here[:-1], here[:-1, :-1]
    if above is not None:
        up[0], both[0, 1:] = above, above[:-1]
    a, b, c = (np.abs(x) for x in (up - both, left - both, left + up - 2 * both))
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, both))
    tried = np.stack([(here - x).astype(np.uint8) for x in (np.zeros_like(here), left, up, (left + up) // 2, paeth)]).reshape(5, height, width * 3)
    best = np.abs(tried.astype(np.int8).astype(np.int32)).sum(axis=2).argmin(axis=0)
    return np.concatenate([best.astype(np.uint8)[:, None], tried[best, np.arange(height)]], axis=1).tobytes()


def png_bytes(array: np.ndarray) -> bytes:
    """An RGB8 PNG of rows x columns x 3 bytes."""
    height, width, _ = array.shape
    return _head(width, height) + _chunk(b"IDAT", zlib.compress(_filtered(array), 1)) + _chunk(b"IEND", b"")


def encode_png(pixels: DataFrame) -> DataFrame:
    """image_id and png of rendered pixels (image_id, px, py, r, g, b) that are small: one image is one task's work. :func:`png_parts` has no such bound."""

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        array = np.zeros((int(rows["py"].max()) + 1, int(rows["px"].max()) + 1, 3), np.uint8)
        array[rows["py"], rows["px"]] = rows[["r", "g", "b"]].to_numpy(np.uint8)
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "png": [png_bytes(array)]})

    return pixels.groupBy("image_id").applyInPandas(encode, f"image_id {pixels.schema['image_id'].dataType.simpleString()}, png binary")


def png_parts(pixels: DataFrame, width: int, height: int, band_pixels: int = BAND_PIXELS) -> DataFrame:
    """image_id, part and body: the PNG of each image of rendered pixels (image_id, px, py, r, g, b) in fragments to be joined by part.

    An image is cut into bands of lines. Each is filtered, with the line above it, and
    deflated by itself up to a byte's end, so that the fragments join to one stream. The
    checksum of the whole is added up from those of the bands, as each one's share in it
    depends on the number of bytes behind the band alone.
    """
    lines = max(1, band_pixels // width)
    last = (height - 1) // lines
    here = F.floor(F.col("py") / lines).cast("int")
    seen = F.when((F.col("py") % lines == lines - 1) & (here < last), F.array(here, here + 1)).otherwise(F.array(here))
    kind = pixels.schema["image_id"].dataType.simpleString()

    def deflate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        band = int(key[1])
        first, end = band * lines, min(height, (band + 1) * lines)
        array = np.zeros((end - first + 1, width, 3), np.uint8)  # the line above comes first
        array[rows["py"] - first + 1, rows["px"]] = rows[["r", "g", "b"]].to_numpy(np.uint8)
        raw = _filtered(array[1:], array[0] if band else None)
        pack = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = (b"\x78\x01" if not band else b"") + pack.compress(raw) + pack.flush(zlib.Z_FINISH if band == last else zlib.Z_SYNC_FLUSH)
        check = zlib.adler32(raw)
        low, high = (check & 0xFFFF) - 1, check >> 16
        behind = (height - end) * (1 + 3 * width)
        return pd.DataFrame({"image_id": [key[0]], "part": [band + 1], "body": [_chunk(b"IDAT", body)], "low": [low], "high": [(high + low * (behind % ADLER)) % ADLER]})

    bands = pixels.select("image_id", "px", "py", "r", "g", "b", F.explode(seen).alias("band")).groupBy("image_id", "band")
    bands = stored(bands.applyInPandas(deflate, f"image_id {kind}, part int, body binary, low long, high long"), "bands")
    sums = bands.groupBy("image_id").agg(((F.sum("low") + 1) % ADLER).alias("low"), (F.sum("high") % ADLER).alias("high"))
    check = F.concat(F.lit(bytearray(b"IDAT")), F.unhex(F.lpad(F.hex(F.col("high") * 65536 + F.col("low")), 8, "0")))
    crc = F.unhex(F.lpad(F.hex(F.crc32(check)), 8, "0"))
    tail = F.concat(F.lit(bytearray(struct.pack(">I", 4))), check, crc, F.lit(bytearray(_chunk(b"IEND", b""))))
    ends = sums.select("image_id", F.inline(F.array(F.struct(F.lit(0).alias("part"), F.lit(bytearray(_head(width, height))).alias("body")), F.struct(F.lit(last + 2).alias("part"), tail.alias("body")))))
    return bands.select("image_id", "part", "body").unionByName(ends)
