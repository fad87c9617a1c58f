"""Images of unlike sizes, faults as rows, the sink of files and fragments of PNG and JSON."""

import itertools
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import __main__ as cli
from gridloom.operators import render, stats, superpixel
from gridloom.operators.batch import center_crops, crop_boxes, resize_all
from gridloom.operators.despeckle import component_sizes, despeckle
from gridloom.operators.resample import center_crop, crop_box, resize
from gridloom.operators.superpixel import superpixels
from gridloom.options import GenerateOptions, Generator, Matcher, RenderOptions, Resample
from gridloom.plans.generate import generate, generate_all, image_faults
from gridloom.scratch import stored
from gridloom.sinks.files import write_files
from gridloom.sources.images import read_batch, read_images
from gridloom.sources.palette_folder import palette_documents
from tests.test_grid import colors, demo, grid, png, shown

IMAGES = "image_id long, width int, height int, bad string"


def batch(spark, sizes):
    """(images, pixels) of ramps of the given sizes."""
    images = spark.createDataFrame([(k, w, h, None) for k, (w, h) in enumerate(sizes)], IMAGES)
    rows = [(k, w, h, x, y, (x * 37 + k) % 256, (y * 53) % 256, (x * y) % 256) for k, (w, h) in enumerate(sizes) for y in range(h) for x in range(w)]
    return images, spark.createDataFrame(rows, "image_id long, width int, height int, x int, y int, r int, g int, b int")


def table(df):
    return sorted(tuple(x) for x in df.collect())


SIZES = [(12, 9), (5, 5), (8, 6), (3, 20), (40, 7)]


def test_crop_boxes_equal_the_scalar_ones(spark):
    sizes = [(w, h) for w in (1, 2, 7, 100, 100_000) for h in (1, 3, 8, 99, 100_000)]
    for tw, th in ((1, 1), (3, 4), (100_000, 1), (7, 13)):
        got = crop_boxes(spark.createDataFrame(sizes, "width int, height int"), tw, th).collect()
        for x in got:
            if x.cw and x.ch:
                assert (x.cx, x.cy, x.cw, x.ch) == crop_box(x.width, x.height, tw, th)


@pytest.mark.parametrize("how", list(Resample))
def test_mixed_sizes_equal_each_by_itself(spark, how):
    images, pixels = batch(spark, SIZES)
    boxes = crop_boxes(images, 8, 6).select(F.col("cw").cast("int").alias("width"), F.col("ch").cast("int").alias("height"))
    got = table(resize_all(center_crops(pixels, 8, 6), boxes, 8, 6, how).select("image_id", "x", "y", "r", "g", "b"))
    want = []
    for k, (w, h) in enumerate(SIZES):
        own = pixels.where(F.col("image_id") == k).drop("width", "height")
        _, _, cw, ch = crop_box(w, h, 8, 6)
        want += table(resize(center_crop(own, w, h, 8, 6), cw, ch, 8, 6, how).select("image_id", "x", "y", "r", "g", "b"))
    assert got == sorted(want) and len(got) == 48 * len(SIZES)


def test_mixed_superpixels_equal_each_by_itself(spark):
    five = colors(spark, [(0, 0, 0), (200, 30, 60), (90, 200, 10), (120, 120, 250), (255, 255, 255)])
    sizes = [(16, 16), (20, 9), (5, 3)]
    images, pixels = batch(spark, sizes)
    made = generate_all(images, pixels, five, "x", GenerateOptions(6, 4, generator=Generator.SUPERPIXEL))
    assert table(made.faults) == [(2, "InvalidImage", "target 6x4 exceeds source 4x3")]
    want = []
    for k, (w, h) in enumerate(sizes[:2]):
        own = pixels.where(F.col("image_id") == k).drop("width", "height")
        _, _, cw, ch = crop_box(w, h, 6, 4)
        want += table(superpixels(center_crop(own, w, h, 6, 4), cw, ch, five, 6, 4))
    assert table(made.cells.select("image_id", "x", "y", "idx")) == sorted(want)


#: Faults in their order: what brings each about in options, palette size or image.
FAULTS = [
    ({"width": 0}, None, {}, "target width is 0"),
    ({"height": 0}, None, {}, "target height is 0"),
    ({}, None, {"bad": "cannot decode it", "width": None, "height": None}, "cannot decode it"),
    ({}, None, {"width": 0}, "source width is 0"),
    ({}, None, {"height": 0}, "source height is 0"),
    ({"generator": Generator.SUPERPIXEL}, None, {}, "exceeds source"),
    ({"max_colors": 0}, None, {}, "max_colors"),
    ({}, 0, {}, "palette has no colors"),
    ({}, 65_537, {}, "more than 65536"),
    ({"render": RenderOptions(4)}, None, {}, "cell_size"),
]


@pytest.mark.parametrize("one", range(len(FAULTS) - 1))
def test_the_first_of_two_faults_is_told(spark, one):
    made = None
    for two in range(one + 1, len(FAULTS)):
        options, size, image = {"width": 9, "height": 9}, 5, {"width": 4, "height": 4, "bad": None}
        for more, count, own, _ in (FAULTS[two], FAULTS[one]):
            options |= more
            size = size if count is None else count
            image |= own
        files = spark.createDataFrame([(two, image["width"], image["height"], image["bad"])], IMAGES)
        got = image_faults(files, size, GenerateOptions(**options))
        made = got if made is None else made.unionByName(got)
    kind = "ImageDecode" if one == 2 else "InvalidPalette" if one in (7, 8) else "InvalidImage"
    told = made.collect()
    assert sorted(x["image_id"] for x in told) == list(range(one + 1, len(FAULTS))) and all(FAULTS[one][3] in x["reason"] and x["kind"] == kind for x in told)


def test_crops_without_lines(spark):
    files = spark.createDataFrame([(1, 5, 100, None), (2, 100, 5, None), (3, 50, 50, None)], IMAGES)
    assert table(image_faults(files, 5, GenerateOptions(1, 40)).select("image_id", "reason")) == [(2, "computed crop width floored to 0")]
    assert table(image_faults(files, 5, GenerateOptions(40, 1)).select("image_id", "reason")) == [(1, "computed crop height floored to 0")]


def test_command_line_goes_on_past_bad_images(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(1)
    for k, (w, h) in enumerate([(12, 9), (4, 4), (30, 2)]):
        (tmp_path / "in" / f"p{k}.png").write_bytes(png(rng.integers(0, 256, (h, w, 3), np.uint8)))
    (tmp_path / "in" / "x.gif").write_bytes(b"GIF89a....")
    (tmp_path / "in" / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\n but no more")
    palette = tmp_path / "p.json"
    palette.write_text(json.dumps({"brand": "Own", "colors": [{"code": "K", "name": "Black", "rgb": "#000000"}, {"code": "W", "name": "White", "rgb": "#ffffff"}]}))
    out = tmp_path / "out"

    def run(source, *more):
        code = cli.main(["generate", "--input", str(source), "--palette", str(palette), "--output", str(out), *more], spark)
        return code, capsys.readouterr().err

    code, told = run(tmp_path / "in" / "x.gif", "--width", "0", "--height", "2")
    assert code == 1 and "target width is 0" in told and "supported" not in told and not out.exists()
    code, told = run(tmp_path / "in", "--width", "6", "--height", "5", "--despeckle", "2")
    assert code == 1 and told.count("error:") == 2 and "not a supported image" in told and "cannot decode" in told
    assert sorted(p.name for p in out.iterdir()) == ["p0", "p1", "p2"]
    assert all(sorted(p.name for p in d.iterdir()) == ["grid.png", "pattern.json", "preview.png", "summary.txt"] for d in out.iterdir())
    made = json.loads((out / "p0" / "pattern.json").read_text())
    assert (made["width"], made["height"], len(made["cells"]), made["total"]) == (6, 5, 30, 30) and sum(x["count"] for x in made["stats"]) == 30
    back = {(p.x, p.y): (p.r, p.g, p.b) for p in read_images(spark, str(out / "p0" / "preview.png"))[1].collect()}
    assert len(back) == 6 * 5 * 100 and all(back[10 * x + 5, 10 * y + 5] == ((0, 0, 0), (255, 255, 255))[made["cells"][6 * y + x]] for x in range(6) for y in range(5))
    code, told = run(tmp_path / "none", "--width", "2", "--height", "2")
    assert code == 1 and "none" in told


def test_images_of_a_batch(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(np.full((3, 2, 3), 7, np.uint8)))
    (tmp_path / "b.txt").write_bytes(b"no image")
    images, pixels = read_batch(spark, str(tmp_path))
    by = {os.path.basename(x["path"]): x for x in images.collect()}
    assert (by["a.png"]["width"], by["a.png"]["height"], by["a.png"]["bad"]) == (2, 3, None) and "not a supported" in by["b.txt"]["bad"]
    assert table(pixels.groupBy("image_id", "width", "height").count()) == [(by["a.png"]["image_id"], 2, 3, 6)]


def test_a_thousand_files_and_none_of_a_failed_job(spark, tmp_path):
    parts = spark.range(1000).select(F.concat(F.lit("d"), (F.col("id") % 7).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("name"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    parts = parts.withColumn("body", F.concat("name", F.lit(":"), F.col("part").cast("string"), F.lit(";")).cast("binary")).repartition(5)
    write_files(parts, str(tmp_path / "out"))
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "out")) == 1000
    assert (tmp_path / "out" / "d1" / "f8").read_text() == "".join(f"d1/f8:{k};" for k in range(4))
    broken = parts.withColumn("body", F.when(F.col("name") == "d3/f731", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        write_files(broken, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or not any(names for _, _, names in os.walk(tmp_path / "bad"))
    with pytest.raises(Exception, match="not in order|name of a file"):
        write_files(parts.withColumn("part", F.lit(1)), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="name of a file"):
        write_files(parts.withColumn("name", F.lit("../up")), str(tmp_path / "bad"))
    assert not any(names for _, _, names in os.walk(tmp_path / "bad"))


def joined(parts):
    out = {}
    for x in parts.orderBy("image_id", "part").collect():
        out[x["image_id"]] = out.get(x["image_id"], b"") + bytes(x["body"])
    return out


@pytest.mark.parametrize("band", [1, 40, 200, 1 << 18])
def test_png_in_bands(spark, tmp_path, band):
    rng = np.random.default_rng(2)
    cells = grid(spark, ["".join(map(str, rng.integers(0, 4, 13))) for _ in range(11)]).unionByName(grid(spark, ["0123" * 3 + "0"] * 11).withColumn("image_id", F.lit(5).cast("long")))
    four = colors(spark, [(1, 2, 3), (250, 0, 9), (9, 99, 199), (255, 255, 255)])
    for k, (pixels, w, h) in enumerate([(render.preview(cells, four, 13, 11, 3), 39, 33), (render.grid(cells, four, 13, 11, 5), render.geometry(13, 11, 5).width, render.geometry(13, 11, 5).height)]):
        made = joined(render.png_parts(pixels, w, h, band))
        want = {}
        for p in pixels.collect():
            want.setdefault(p.image_id, {})[p.px, p.py] = (p.r, p.g, p.b)
        for image, body in made.items():
            at = tmp_path / f"{image}-{k}.png"
            at.write_bytes(body)
            assert {(p.x, p.y): (p.r, p.g, p.b) for p in read_images(spark, str(at))[1].collect()} == want[image]
        assert len(made) == 2


@pytest.mark.parametrize("band", [1, 3, 64])
def test_json_in_fragments(spark, band):
    four = colors(spark, [(1, 2, 3)] * 4).withColumn("name", F.concat(F.lit('"quoted" \\ é'), F.col("idx").cast("string")))
    cells = grid(spark, ["01230", "33010", "22222", "10101"]).unionByName(grid(spark, ["0", "1", "9"]).withColumn("image_id", F.lit(5).cast("long")))
    sizes = spark.createDataFrame([(0, 5, 4), (5, 1, 3), (7, 2, 2)], "image_id long, width int, height int")
    want = {x["image_id"]: x["pattern"].encode() for x in stats.pattern_json(cells, four, sizes, 'B "x"').collect()}
    assert joined(stats.json_parts(cells, four, sizes, 'B "x"', band)) == want


def flood(rows):
    seen, out = {}, {}
    for y, x in itertools.product(range(len(rows)), range(len(rows[0]))):
        if (y, x) in seen:
            continue
        stack, own = [(y, x)], {(y, x)}
        while stack:
            a, b = stack.pop()
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < len(rows) and 0 <= d < len(rows[0]) and (c, d) not in own and rows[c][d] == rows[y][x]:
                    own.add((c, d))
                    stack.append((c, d))
        seen |= dict.fromkeys(own, (y, x))
        out[y, x] = own
    return out


def cleaned(rows, most):
    out = [list(r) for r in rows]
    for own in flood(rows).values():
        votes = {}
        for a, b in own:
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < len(rows) and 0 <= d < len(rows[0]) and (c, d) not in own:
                    votes[rows[c][d]] = votes.get(rows[c][d], 0) + 1
        if len(own) <= most and votes:
            new = min(votes, key=lambda v: (-votes[v], v))
            for a, b in own:
                out[a][b] = new
    return ["".join(r) for r in out]


def spiral(n):
    """A path of one colour that winds over many tiles."""
    rows = [["0"] * n for _ in range(n)]
    for y in range(0, n, 2):
        rows[y] = ["1"] * n
        if y + 1 < n:
            rows[y + 1][n - 1 if y // 2 % 2 == 0 else 0] = "1"
    return ["".join(r) for r in rows]


@pytest.mark.parametrize("tile", [3, 8])
def test_despeckle_by_tiles_equals_flood_fill(spark, tile):
    rng = np.random.default_rng(tile)
    images = [["".join(map(str, rng.integers(0, 2, 19))) for _ in range(14)], spiral(15), ["0" * 9] * 7]
    cells = spark.createDataFrame([(k, x, y, int(v)) for k, rows in enumerate(images) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, x int, y int, idx int")
    sizes = {(k, y, x): len(own) for k, rows in enumerate(images) for (y, x), own in flood(rows).items()}
    assert {(c.image_id, c.y, c.x): c.n for c in component_sizes(cells, tile).collect()} == sizes
    for most in (4, 100, 1 << 40):
        out = despeckle(cells, most, tile=tile).collect()
        want = {(k, x, y): int(v) for k, rows in enumerate(images) for y, row in enumerate(cleaned(rows, most)) for x, v in enumerate(row)}
        assert {(c.image_id, c.x, c.y): c.idx for c in out} == want and len(out) == len(want)


def test_despeckle_leaves_grids_that_do_not_fill_their_size(spark):
    rows = ["0001000", "0000000"]
    whole, holes = grid(spark, rows), grid(spark, rows).where("NOT (x = 6 AND y = 1)").withColumn("image_id", F.lit(1).cast("long"))
    twice = grid(spark, rows).where("NOT (x = 6 AND y = 1)").unionByName(grid(spark, ["0"])).withColumn("image_id", F.lit(2).cast("long"))
    sizes = spark.createDataFrame([(k, 7, 2) for k in range(3)], "image_id long, width int, height int")
    out = despeckle(whole.unionByName(holes).unionByName(twice), 1, sizes, 4)
    assert {k: "1" in "".join(str(x.idx) for x in out.where(F.col("image_id") == k).collect()) for k in range(3)} == {0: False, 1: True, 2: True}
    assert out.count() == 14 + 13 + 14


def test_generate_of_one_size_still_raises_and_agrees(spark):
    three = colors(spark, [(0, 0, 0), (7, 7, 14), (3, 3, 6)])
    made = generate(demo(spark, 8, 8), 8, 8, three, "x", GenerateOptions(4, 4, matcher=Matcher.RGB, max_colors=2, despeckle=1))
    assert made.cells.count() == 16 and made.faults.count() == 0


def test_palettes_of_a_folder(spark, tmp_path, capsys):
    one = {"code": "A", "name": "n", "rgb": "#000000"}
    (tmp_path / "yant.json").write_text(json.dumps({"brand": "Yant", "colors": [one, one | {"code": "B"}]}))
    (tmp_path / "perler.json").write_text("\ufeff" + json.dumps({"brand": "Perler", "colors": [one]}), encoding="utf-8")
    (tmp_path / "hama.json").write_text(json.dumps({"brand": "Hama", "colors": [{"code": "A", "rgb": "#000000"}]}))
    (tmp_path / "nabbi.json").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "notes.txt").write_text("no palette")
    assert cli.main(["palette", "list", str(tmp_path)], spark) == 1
    told = capsys.readouterr()
    assert told.out.splitlines() == ["perler       Perler        1 colors", "yant         Yant          2 colors"]
    assert [x.split(":")[1].strip() for x in told.err.splitlines() if x.startswith("error")] == ["hama", "nabbi"]
    assert cli.main(["palette", "validate", str(tmp_path / "yant.json")], spark) == 0
    assert cli.main(["palette", "validate", str(tmp_path / "hama.json")], spark) == 1
    assert cli.main(["palette", "list", str(tmp_path / "none")], spark) == 1
    (tmp_path / "empty").mkdir()
    assert cli.main(["palette", "list", str(tmp_path / "empty")], spark) == 0
    assert palette_documents(spark, str(tmp_path)).rdd.getNumPartitions() == 4


def test_superpixels_by_tiles_equal_those_of_shared_centres(spark, monkeypatch):
    five = colors(spark, [(0, 0, 0), (200, 30, 60), (90, 200, 10), (120, 120, 250), (255, 255, 255)])
    images, pixels = batch(spark, [(40, 30), (26, 33)])
    for to in ((9, 7),):
        want = table(superpixel.superpixels_all(pixels, five, *to).select("image_id", "x", "y", "idx"))
        monkeypatch.setattr(superpixel, "SHARED", 0)
        for size in (10,):  # parts of cells
            monkeypatch.setattr(superpixel, "TILE_PIXELS", size)
            assert table(superpixel.superpixels_all(pixels, five, *to).select("image_id", "x", "y", "idx")) == want
        monkeypatch.undo()


def test_tiles_of_pixels_are_not_shuffled_again(spark):
    _, pixels = batch(spark, [(40, 30)])
    points = pixels.selectExpr("image_id", "x", "y", "r / 255D AS v0", "g / 255D AS v1", "b / 255D AS v2", "x div 10 AS hx", "y div 10 AS hy", "10D AS sx", "10D AS sy")
    centres = stored(spark.createDataFrame([(0, i, j, 10.0 * i + 5, 10.0 * j + 5, 0.1, 0.2, 0.3) for i in range(4) for j in range(3)], "image_id long, i int, j int, cx double, cy double, c0 double, c1 double, c2 double"), "centres")
    laid, side, parts = superpixel._laid_out(points, "points_of_a_test")
    plan = superpixel._tiled(laid, centres, side, parts)._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE points_of_a_test")
    # one exchange brings the centres to the tiles and one adds up the sums; pixels have none
    assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan
