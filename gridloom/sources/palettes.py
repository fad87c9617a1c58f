"""Palettes from JSON documents, and the catalogue of known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import InvalidPalette, PaletteParse

SCHEMA = "brand string, colors array<struct<code: string, name: string, rgb: string>>"
# Ids and brands of the catalogue, in its order.
CATALOG = (
    ("mard", "MARD"), ("artkal_s", "Artkal S"), ("artkal_a", "Artkal A"), ("artkal_c", "Artkal C"), ("artkal_m", "Artkal M"), ("artkal_r", "Artkal R"), ("hama", "Hama Midi"),
    ("hama_maxi", "Hama Maxi"), ("hama_mini", "Hama Mini"), ("perler", "Perler"), ("perler_caps", "Perler Caps"), ("perler_mini", "Perler Mini"), ("nabbi", "Nabbi"), ("yant", "Yant"),
)
DEFAULT = "mard"
HEX = "^#[0-9A-Fa-f]{6}$"


def hex_channels(column: str) -> list:
    """r, g, b of a strict #RRGGBB text; null where it is none."""
    ok = F.col(column).rlike(HEX)
    return [F.when(ok, F.conv(F.substring(column, at, 2), 16, 10).cast("int")).alias(c) for c, at in zip("rgb", (2, 4, 6))]


def widen_short(column: str):
    """#RGB as #RRGGBB, as lenient readers take it."""
    return F.regexp_replace(column, "^#([0-9A-Fa-f])([0-9A-Fa-f])([0-9A-Fa-f])$", "#$1$1$2$2$3$3")


def parse(documents: DataFrame, lenient: bool = False) -> DataFrame:
    """palette_id, brand, idx, code, name, rgb, r, g, b of documents(palette_id, json); idx is null for documents that do not parse."""
    read = documents.select("palette_id", F.from_json("json", SCHEMA).alias("d"))
    rows = read.select("palette_id", "d.brand", F.posexplode_outer("d.colors").alias("idx", "c"))
    flat = rows.select("palette_id", "brand", "idx", "c.code", "c.name", (widen_short("c.rgb") if lenient else F.col("c.rgb")).alias("rgb"))
    return flat.select("*", *hex_channels("rgb"))


def faults(parsed: DataFrame) -> DataFrame:
    """palette_id, kind and reason of each palette that fails: unreadable, then empty, then the first bad colour, then the first duplicate code."""
    by_code = parsed.where("code IS NOT NULL").groupBy("palette_id", "code").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    twice = by_code.where("n > 1").groupBy("palette_id").agg(F.min(F.struct("first", "code"))["code"].alias("twice"))
    whole = parsed.groupBy("palette_id").agg(
        F.max(F.col("brand").isNull()).alias("no_brand"),
        F.max(F.col("idx").isNull()).alias("empty"),
        F.max(F.col("idx").isNotNull() & (F.col("code").isNull() | F.col("name").isNull() | F.col("rgb").isNull())).alias("missing"),
        F.min(F.when(F.col("rgb").isNotNull() & F.col("r").isNull(), F.struct("idx", "code")))["code"].alias("bad"),
    )
    joined = whole.join(twice, "palette_id", "left")
    reason = (
        F.when(F.col("no_brand") | F.col("missing"), F.lit("document or field missing"))
        .when(F.col("empty"), F.lit("palette has no colors"))
        .when(F.col("bad").isNotNull(), F.concat(F.lit("bad hex for color "), "bad"))
        .when(F.col("twice").isNotNull(), F.concat(F.lit("duplicate code "), "twice"))
    )
    kind = F.when(F.col("no_brand") | F.col("missing"), F.lit("PaletteParse")).otherwise(F.lit("InvalidPalette"))
    return joined.select("palette_id", kind.alias("kind"), reason.alias("reason")).where("reason IS NOT NULL")


def load(spark: SparkSession, json: str, lenient: bool = False) -> tuple[str, DataFrame]:
    """Brand and colours (idx, code, name, r, g, b) of one document, or the error it deserves."""
    return loaded(spark.createDataFrame([("own", json)], "palette_id string, json string"), lenient)


def loaded(document: DataFrame, lenient: bool = False) -> tuple[str, DataFrame]:
    """Brand and colours (idx, code, name, r, g, b) of the one row of document (palette_id, json), or the error it deserves."""
    parsed = parse(document, lenient)
    fault = faults(parsed).first()
    if fault:
        raise (PaletteParse if fault["kind"] == "PaletteParse" else InvalidPalette)(fault["reason"])
    return parsed.first()["brand"], parsed.select("idx", "code", "name", "r", "g", "b")


def listing(parsed: DataFrame) -> DataFrame:
    """ord and line of every catalogue palette in parsed: id, brand and number of colours in columns."""
    order = parsed.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(CATALOG)], "ord int, palette_id string")
    counts = parsed.groupBy("palette_id", "brand").agg(F.count("idx").alias("n"))
    return counts.join(F.broadcast(order), "palette_id").select("ord", F.format_string("%-12s %-13s %d colors", "palette_id", "brand", "n").alias("line"))


def counts(documents: DataFrame) -> DataFrame:
    """palette_id and number of colours, null where a document does not parse."""
    size = F.size(F.from_json("json", SCHEMA)["colors"])
    return documents.select("palette_id", F.when(size >= 0, size).alias("colors"))


def lookup(wanted: DataFrame) -> DataFrame:
    """wanted(palette_id) with the catalogue's id and brand; unknown ids take the default."""
    known = wanted.sparkSession.createDataFrame(list(CATALOG), "known string, brand_known string")
    joined = wanted.join(F.broadcast(known), F.col("palette_id") == F.col("known"), "left")
    return joined.select("palette_id", F.coalesce("known", F.lit(DEFAULT)).alias("entry"), F.coalesce("brand_known", F.lit(dict(CATALOG)[DEFAULT])).alias("brand"))
