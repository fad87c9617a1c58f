"""Command line: ``python -m gridloom generate | palette validate | palette list``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import PatternError
from gridloom.options import GenerateOptions, Generator, Matcher
from gridloom.plans.generate import generate_all
from gridloom.scratch import stored
from gridloom.sinks.files import write_files
from gridloom.sources import palettes
from gridloom.sources.images import read_batch
from gridloom.sources.palette_folder import palette_documents


def _arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="gridloom")
    commands = top.add_subparsers(dest="command", required=True)
    make = commands.add_parser("generate", help="an image to preview.png, grid.png, pattern.json and summary.txt")
    for name in ("--input", "--palette", "--output"):
        make.add_argument(name, required=True)
    for name in ("--width", "--height"):
        make.add_argument(name, type=int, required=True)
    make.add_argument("--matcher", choices=[x.value for x in Matcher], default=Matcher.OKLAB.value)
    make.add_argument("--generator", choices=[x.value for x in Generator], default=Generator.STAGED.value)
    make.add_argument("--max-colors", type=int)
    make.add_argument("--despeckle", type=int)
    kinds = commands.add_parser("palette").add_subparsers(dest="what", required=True)
    kinds.add_parser("validate").add_argument("path")
    kinds.add_parser("list").add_argument("folder")
    return top.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    try:
        if args.command == "generate":
            return _generate(spark, args)
        elif args.what == "validate":
            brand, colors = palettes.loaded(_document(spark, args.path))
            print(f"{brand}: {colors.count()} colors")
        else:
            return _list(spark, args.folder)
    except (PatternError, OSError) as fault:
        print(f"error: {fault}", file=sys.stderr)
        return 1
    return 0


def _document(spark: SparkSession, path: str) -> DataFrame:
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no such palette: {path}")
    return palette_documents(spark, path)


def _list(spark: SparkSession, folder: str) -> int:
    """A line per sound palette of the catalogue; the others are told with their fault."""
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"no such folder: {folder}")
    parsed = palettes.parse(palette_documents(spark, folder))
    faults = stored(palettes.faults(parsed), "faults")
    for x in palettes.listing(parsed.join(faults, "palette_id", "left_anti")).orderBy("ord").collect():
        print(x["line"])
    failed = faults.orderBy("palette_id").collect()
    for x in failed:
        print(f"error: {x['palette_id']}: {x['reason']}", file=sys.stderr)
    return int(bool(failed))


def _generate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Files of every sound image; the others are told with the first of their faults."""
    if not os.path.exists(args.input):
        raise FileNotFoundError(f"no such input: {args.input}")
    brand, colors = palettes.loaded(_document(spark, args.palette))
    images, pixels = read_batch(spark, args.input)
    images = stored(images, "images")
    options = GenerateOptions(args.width, args.height, matcher=Matcher(args.matcher), generator=Generator(args.generator), max_colors=args.max_colors, despeckle=args.despeckle)
    made = generate_all(images, pixels, colors, brand, options)
    failed = 0
    for x in made.faults.join(images, "image_id").select("path", "reason").orderBy("path").toLocalIterator():
        print(f"error: {x['reason']} ({x['path']})", file=sys.stderr)
        failed = 1
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    named = images.select("image_id", stem.alias("stem"))
    shared = named.groupBy("stem").agg(F.count("*").alias("n"))
    single = images.limit(2).count() == 1
    folder = F.lit("") if single else F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), F.hex("image_id")))
    if not made.cells.isEmpty():
        write_files(made.files(named.join(shared, "stem").select("image_id", folder.alias("folder"))), args.output)
    return failed


if __name__ == "__main__":
    sys.exit(main())
