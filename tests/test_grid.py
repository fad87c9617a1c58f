"""The palette-grid engine on hand-written vectors, invariants and a golden superpixel count."""

import json
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import __main__ as cli
from gridloom.errors import ImageDecode, InvalidImage, InvalidPalette, PaletteParse
from gridloom.functions.colorspace import lab, oklab
from gridloom.operators import layout, render, stats
from gridloom.operators.despeckle import component_sizes, despeckle
from gridloom.operators.match import match_pattern
from gridloom.operators.reduce import reduce_colors
from gridloom.operators.resample import center_crop, crop_box, resize
from gridloom.operators.superpixel import superpixels
from gridloom.options import GenerateOptions, Generator, Matcher, Resample
from gridloom.plans.generate import generate
from gridloom.sources import images, palettes
from gridloom.streaming.ingest import image_stream, per_batch


def colors(spark, rgb, names="ABCDEFGH"):
    return spark.createDataFrame([(k, names[k], f"n{k}", *c) for k, c in enumerate(rgb)], "idx int, code string, name string, r int, g int, b int")


def grid(spark, rows):
    return spark.createDataFrame([(0, x, y, int(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, x int, y int, idx int")


def shown(cells):
    rows = {(r.y, r.x): r.idx for r in cells.collect()}
    return ["".join(str(rows[y, x]) for x in range(max(k[1] for k in rows) + 1)) for y in range(max(k[0] for k in rows) + 1)]


def demo(spark, w, h):
    return spark.range(w * h).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y")).selectExpr("image_id", "x", "y", "x % 256 AS r", "y % 256 AS g", "(x + y) % 256 AS b")


@pytest.mark.parametrize(
    "rgb, target, want",
    [
        ([(10, 20, 30), (200, 100, 50), (0, 0, 0)], (200, 100, 50), 1),
        ([(0, 0, 0), (100, 100, 100)], (10, 10, 10), 0),
        ([(255, 255, 255), (254, 254, 254)], (0, 0, 0), 1),
        ([(0, 0, 0), (20, 0, 0)], (10, 0, 0), 0),
        ([(42, 42, 42), (42, 42, 42)], (42, 42, 42), 0),
    ],
)
def test_rgb_match(spark, rgb, target, want):
    pixel = spark.createDataFrame([(0, 0, 0, *target)], "image_id long, x int, y int, r int, g int, b int")
    assert match_pattern(pixel, colors(spark, rgb), Matcher.RGB).first().idx == want


def test_perceptual_match(spark):
    five = [(0, 0, 180), (0, 0, 255), (80, 0, 210), (120, 0, 180), (90, 40, 230)]
    pixel = spark.createDataFrame([(0, 0, 0, 0, 0, 200)], "image_id long, x int, y int, r int, g int, b int")
    assert [match_pattern(pixel, colors(spark, five), m).first().idx for m in (Matcher.LAB, Matcher.OKLAB)] == [2, 0]
    red = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate((*lab(F.lit(255), F.lit(0), F.lit(0)), *oklab(F.lit(255), F.lit(0), F.lit(0)))))).first()
    assert np.allclose(red[:3], (53.24, 80.09, 67.20), atol=0.5) and np.allclose(red[3:], (0.62796, 0.22486, 0.12585), atol=0.001)
    with pytest.raises(InvalidPalette):
        match_pattern(pixel, colors(spark, []), Matcher.RGB)


def test_crop():
    assert [crop_box(*x) for x in ((5, 1, 1, 1), (4, 1, 1, 1), (20, 10, 1, 1), (160, 200, 4, 5), (100, 99, 1, 1))] == [(2, 0, 1, 1), (1, 0, 1, 1), (5, 0, 10, 10), (0, 0, 160, 200), (0, 0, 99, 99)]
    for bad in ((100_000, 1, 1, 100_000), (1, 1, 0, 1), (0, 1, 1, 1)):
        with pytest.raises(InvalidImage):
            crop_box(*bad)


def test_resize(spark):
    small = resize(demo(spark, 160, 200), 160, 200, 4, 5, Resample.NEAREST).where("y = 0").orderBy("x").collect()
    assert [(p.r, p.g, p.b) for p in small] == [(20, 20, 40), (60, 20, 80), (100, 20, 120), (140, 20, 160)]
    grown = resize(demo(spark, 3, 2), 3, 2, 7, 5, Resample.NEAREST).collect()
    assert {(p.x, p.y): (p.r, p.g) for p in grown} == {(x, y): ((2 * x + 1) * 3 // 14, (2 * y + 1) * 2 // 10) for x in range(7) for y in range(5)}
    flat = demo(spark, 30, 20).withColumns({c: F.lit(77) for c in "rgb"})
    assert {(p.r, p.g, p.b) for p in resize(flat, 30, 20, 7, 9).collect()} == {(77, 77, 77)}
    ramp = [p.r for p in resize(demo(spark, 40, 4), 40, 4, 10, 1).orderBy("x").collect()]
    assert ramp == sorted(ramp) and ramp[5] == 22
    same = demo(spark, 4, 4)
    assert resize(same, 4, 4, 4, 4) is same
    assert center_crop(demo(spark, 5, 1), 5, 1, 1, 1).first().r == 2


def test_reduce(spark):
    four = colors(spark, [(0, 0, 0), (8, 0, 0), (255, 0, 0), (247, 0, 0)])
    assert shown(reduce_colors(grid(spark, ["0001223"]), four, 2, Matcher.RGB)) == ["0000222"]
    three = colors(spark, [(0, 0, 0), (10, 0, 0), (20, 0, 0)])
    assert shown(reduce_colors(grid(spark, ["00221"]), three, 2, Matcher.RGB)) == ["00220"]
    assert shown(reduce_colors(grid(spark, ["00221"]), three, 3, Matcher.RGB)) == ["00221"]
    with pytest.raises(InvalidImage, match="max_colors"):
        reduce_colors(grid(spark, ["0"]), colors(spark, []), 0)
    with pytest.raises(InvalidPalette):
        reduce_colors(grid(spark, ["9"]), three, 1)


@pytest.mark.parametrize(
    "rows, s, want",
    [
        (["112", "102", "122"], 1, ["112", "112", "122"]),
        (["110", "000", "000"], 1, ["110", "000", "000"]),
        (["0000", "0120", "0000"], 1, ["0000", "0000", "0000"]),
        (["0000", "0110", "0120", "0000"], 1, ["0000", "0110", "0100", "0000"]),
        (["55", "55"], 100, ["55", "55"]),
        (["12"], 0, ["12"]),
    ],
)
def test_despeckle(spark, rows, s, want):
    assert shown(despeckle(grid(spark, rows), s)) == want


def test_despeckle_against_flood_fill(spark):
    r = random.Random(1)
    rows = ["".join(r.choice("012") for _ in range(12)) for _ in range(9)]
    region, sizes = {}, Counter()
    for start in [(y, x) for y in range(9) for x in range(12)]:
        if start in region:
            continue
        stack = [start]
        while stack:
            y, x = stack.pop()
            if (y, x) in region or rows[y][x] != rows[start[0]][start[1]]:
                continue
            region[y, x] = start
            sizes[start] += 1
            stack += [p for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if 0 <= p[0] < 9 and 0 <= p[1] < 12]
    assert Counter({(c.y, c.x): c.n for c in component_sizes(grid(spark, rows)).collect()}) == sizes
    for s in (2, 6):
        votes = {}
        for (y, x), k in region.items():
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if p in region and rows[p[0]][p[1]] != rows[y][x]:
                    votes.setdefault(k, Counter())[int(rows[p[0]][p[1]])] += 1
        best = {k: min(v, key=lambda c, v=v: (-v[c], c)) for k, v in votes.items() if sizes[k] <= s}
        want = ["".join(str(best.get(region[y, x], rows[y][x])) for x in range(12)) for y in range(9)]
        assert shown(despeckle(grid(spark, rows), s)) == want


def test_statistics(spark):
    four = colors(spark, [(0, 0, 0)] * 4)
    got = stats.count_colors(grid(spark, ["0122233"]), four).orderBy("rank").collect()
    assert [(x.code, x["count"]) for x in got] == [("C", 3), ("D", 2), ("A", 1), ("B", 1)]
    two = colors(spark, [(0, 0, 0)] * 2).withColumns({"code": F.concat(F.lit("S0"), (F.col("idx") + 1).cast("string")), "name": F.when(F.col("idx") == 0, "Black").otherwise("White")})
    total = stats.totals(grid(spark, ["0120"]), two).first()
    assert (total.total, total.known, total.wrong_palette) == (4, 3, True)
    size = spark.createDataFrame([(0, 5, 1)], "image_id long, width int, height int")
    assert stats.summary(grid(spark, ["00011"]), two, size, "Test").first().summary == "Bead Pattern Summary\nSize: 5 x 1\nTotal Beads: 5\nPalette: Test\n\nS01 Black: 3\nS02 White: 2\n"
    assert stats.summary(grid(spark, ["0"]).where("idx > 5"), two, size, "Test").first().summary.endswith("Palette: Test\n\n")
    made = json.loads(stats.pattern_json(grid(spark, ["00011"]), two, size, "Test").first().pattern)
    assert list(made) == ["brand", "width", "height", "cells", "total", "stats"] and made["cells"] == [0, 0, 0, 1, 1]


def test_render(spark):
    assert [(g.left, g.top, g.width, g.height) for g in (render.geometry(16, 20, 10), render.geometry(13, 13, 10), render.geometry(13, 17, 5))] == [(18, 14, 178, 214), (18, 14, 148, 144), (9, 7, 74, 92)]
    assert render.geometry(13, 105, 5).left == 13 and min(x for x, y in render.label_pixels(13, 105, render.geometry(13, 105, 5)) if y > 500) >= 1
    cells = grid(spark, ["0" * 16] * 20)
    painted = {(p.px, p.py): (p.r, p.g, p.b) for p in render.grid(cells, colors(spark, [(9, 9, 9)]), 16, 20, 10).collect()}
    assert len(painted) == 178 * 214 and painted[0, 0] == (255, 255, 255) and painted[118, 19] == (120, 120, 120)
    odd = render.preview(grid(spark, ["07"]), colors(spark, [(1, 2, 3)]), 3, 1, 2)
    assert {(p.px, p.py): (p.r, p.g, p.b) for p in odd.collect()} == {(x, y): (1, 2, 3) if x < 2 else (255, 0, 255) for x in range(6) for y in range(2)}
    with pytest.raises(InvalidImage):
        render.geometry(5, 5, 4)


def test_superpixel_golden(spark):
    five = colors(spark, [(0, 0, 0), (0x1E, 5, 0x20), (5, 0x26, 0x28), (0x1E, 0x26, 0x44), (0x0F, 0x14, 0x23)], "KRGBM")
    made = superpixels(demo(spark, 32, 40), 32, 40, five, 16, 20)
    assert {x.code: x["count"] for x in stats.count_colors(made, five).collect()} == {"M": 149, "R": 72, "G": 47, "B": 47, "K": 5}
    with pytest.raises(InvalidImage):
        superpixels(demo(spark, 4, 4), 4, 4, five, 8, 8)


def png(array, extra=b"", kind=2, depth=8):
    h, w = array.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b"".join(b"\0" + row.tobytes() for row in array)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_images_command_line_and_stream(spark, tmp_path):
    rgba = np.zeros((4, 4, 4), np.uint8)
    rgba[0, 0], rgba[3, 3] = (10, 20, 30, 0), (200, 100, 50, 255)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(rgba, kind=6))
    sizes, pixels = images.read_images(spark, str(tmp_path / "in"))
    got = {(p.x, p.y): (p.r, p.g, p.b) for p in pixels.collect()}
    assert sizes.first()["width"] == 4 and got[0, 0] == (10, 20, 30) and got[3, 3] == (200, 100, 50)
    (tmp_path / "grey.png").write_bytes(png(np.full((2, 2), 123, np.uint8), kind=0))
    assert {(p.r, p.g, p.b) for p in images.read_images(spark, str(tmp_path / "grey.png"))[1].collect()} == {(123, 123, 123)}
    (tmp_path / "x.gif").write_bytes(b"GIF89a....")
    with pytest.raises(ImageDecode):
        images.read_images(spark, str(tmp_path / "x.gif"))
    palette = tmp_path / "p.json"
    palette.write_text(json.dumps({"brand": "Own", "colors": [{"code": "K", "name": "Black", "rgb": "#000000"}, {"code": "W", "name": "White", "rgb": "#ffffff", "more": 1}]}))
    out = tmp_path / "out"
    assert cli.main(["generate", "--input", str(tmp_path / "in"), "--palette", str(palette), "--output", str(out), "--width", "2", "--height", "2", "--despeckle", "1"], spark) == 0
    assert sorted(p.name for p in out.iterdir()) == ["grid.png", "pattern.json", "preview.png", "summary.txt"]
    back = {(p.r, p.g, p.b) for p in images.read_images(spark, str(out / "preview.png"))[1].collect()}
    assert back <= {(0, 0, 0), (255, 255, 255)}
    assert cli.main(["palette", "validate", str(palette)], spark) == 0
    assert cli.main(["palette", "validate", str(tmp_path / "none.json")], spark) == 1
    with pytest.raises(SystemExit) as fault:
        cli.main(["generate", "--input", "a", "--palette", "b", "--output", "c", "--width", "1", "--height", "1", "--matcher", "odd"], spark)
    assert fault.value.code == 2
    seen = []
    per_batch(image_stream(spark, str(tmp_path / "in")), lambda batch, k: seen.append(batch.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 1


def test_generate_order_of_faults(spark):
    pixels, none = demo(spark, 8, 8), colors(spark, [])
    for options, kind, what in (
        (GenerateOptions(0, 2, max_colors=0), InvalidImage, "width"),
        (GenerateOptions(9, 9, generator=Generator.SUPERPIXEL, max_colors=0), InvalidImage, "exceeds"),
        (GenerateOptions(2, 2, max_colors=0), InvalidImage, "max_colors"),
        (GenerateOptions(2, 2), InvalidPalette, "no colors"),
    ):
        with pytest.raises(kind, match=what):
            generate(pixels, 8, 8, none, "x", options)
    made = generate(pixels, 8, 8, colors(spark, [(0, 0, 0), (7, 7, 14), (3, 3, 6)]), "x", GenerateOptions(4, 4, max_colors=2, despeckle=1))
    assert made.cells.count() == 16 and made.stats().count() <= 2


def test_palettes(spark):
    load = lambda colors, **more: palettes.load(spark, json.dumps({"brand": "b", "colors": colors}), **more)
    one = lambda rgb, code="A": {"code": code, "name": "n", "rgb": rgb}
    assert [tuple(x)[3:] for x in load([one("#0aFf10")])[1].collect()] == [(10, 255, 16)]
    for bad in ("#00GG00", "#FFF", "00FF00", "#+12345", "#éé"):
        with pytest.raises(InvalidPalette, match="color X"):
            load([one("#000000"), one(bad, "X")])
    assert tuple(load([one("#1aF")], lenient=True)[1].first())[3:] == (17, 170, 255)
    with pytest.raises(InvalidPalette, match="no colors"):
        load([])
    with pytest.raises(InvalidPalette, match="duplicate code A"):
        load([one("#000000"), one("#000001")])
    for text in ("{", '{"brand": "b", "colors": [{"code": "A", "rgb": "#000000"}]}', '{"colors": []}'):
        with pytest.raises(PaletteParse):
            palettes.load(spark, text)
    lines = palettes.listing(palettes.parse(spark.createDataFrame([("perler", '{"brand":"Perler","colors":[{"code":"A","name":"n","rgb":"#000000"}]}')], "palette_id string, json string"))).collect()
    assert lines[0].line == "perler       Perler        1 colors"


def test_layout(spark):
    table = [
        (100, 100, 1.0, 1.0, 0.0, 0.0, 0, (0, 0, 100, 100)), (100, 100, 1.0, 2.0, 0.0, 0.0, 0, (25, 25, 50, 50)), (100, 100, 1.0, 2.0, -1.0, -1.0, 0, (0, 0, 50, 50)), (100, 100, 1.0, 2.0, 1.0, 1.0, 0, (50, 50, 50, 50)),
        (200, 100, 1.0, 1.0, 0.0, 0.0, 1, (0, 50, 100, 100)), (200, 100, 1.0, 1.0, 0.0, 0.0, 3, (0, 50, 100, 100)), (120, 120, 0.75, 1.0, 0.0, 0.0, 0, (15, 0, 90, 120)), (120, 120, 9 / 16, 1.0, 0.0, 0.0, 0, (26, 0, 68, 120)),
        (120, 120, 4 / 3, 1.0, 0.0, 0.0, 0, (0, 15, 120, 90)), (300, 150, 0.75, 2.0, 1.0, -1.0, 1, (75, 0, 75, 100)),
    ]
    got = layout.crop_rect(spark.createDataFrame([x[:7] + (k,) for k, x in enumerate(table)], "src_w int, src_h int, aspect double, zoom double, pan_x double, pan_y double, turns int, k int")).orderBy("k").collect()
    assert [(x.x, x.y, x.w, x.h) for x in got] == [x[7] for x in table]
    pairs = layout.locked_pair(spark.createDataFrame([(40, 1.0, True), (40, 0.75, True), (800, 9 / 16, True)], "value int, aspect double, by_width boolean")).collect()
    assert [(x.w, x.h) for x in pairs] == [(40, 40), (40, 53), (563, 1000)]
    places = spark.createDataFrame([(30, 25, 2, 10.0, r, c) for r in (0, 7, 24) for c in (0, 29)], "width int, height int, border int, cell double, row int, col int")
    round_trip = layout.hit_test(layout.cell_centre(places).drop("row", "col").withColumn("k", F.monotonically_increasing_id())).orderBy("k").collect()
    assert [(x.row, x.col) for x in round_trip] == [(r, c) for r in (0, 7, 24) for c in (0, 29)]
    assert [x.n for x in layout.ticks(spark.createDataFrame([(25, 9, 0, 5.0)], "width int, height int, border int, cell double")).orderBy("n").collect()] == [10, 20]
    saved = layout.save_cell(spark.createDataFrame([(100, 100, 0), (1000, 1000, 8)], "width int, height int, border int")).collect()
    assert saved[0].cell == 10.0 and saved[1].cell <= 4.0
    numbers = spark.createDataFrame([(" 12 ",), ("",), ("x",), ("-3",), ("99999999999",)], "t string").select(layout.read_u32(F.col("t")).alias("v")).collect()
    assert [x.v for x in numbers] == [12, None, None, 0, 4294967295]
    kept = layout.settings(spark.createDataFrame([("generator", "odd"), ("width", "64"), ("border_rings", "11")], "name string, value string")).collect()
    assert {x.name: x.value for x in kept} == {"palette_id": "mard", "generator": "staged", "limit_colors": "false", "max_colors": "24", "despeckle_on": "false", "despeckle": "2", "width": "64", "border_rings": "8"}
    spun = layout.turned(demo(spark, 3, 2), 3, 2, 1, flip=True).where("x = 0 AND y = 0").first()
    assert (spun.r, spun.g) == (0, 0)
    assert layout.presets(spark.createDataFrame([(0.5,)], "aspect double")).count() == 3


def test_kernels(spark):
    from gridloom.operators.resample import KERNELS, kernel_weights

    for how in KERNELS:
        for source, target in ((7, 3), (3, 7), (5, 5), (100, 1)):
            sums = {}
            for o, s, w in kernel_weights(how, source, target):
                assert 0 <= s < source
                sums[o] = sums.get(o, 0) + w
            assert len(sums) == target and all(abs(v - 1) < 1e-9 for v in sums.values())
        flat = spark.createDataFrame([(0, x, y, 9, 90, 200) for x in range(6) for y in range(4)], "image_id long, x int, y int, r int, g int, b int")
        assert {(p.r, p.g, p.b) for p in resize(flat, 6, 4, 4, 3, how).collect()} == {(9, 90, 200)}


def test_png_filters():
    """Lines of every filter type give back the picture."""
    import zlib

    import numpy as np

    from gridloom.operators.render import png_bytes

    g = np.random.default_rng(0)
    ramp = np.add.outer(np.arange(40) * 3, np.arange(50) * 2)[:, :, None] % 256 + np.zeros(3)
    for picture in (g.integers(0, 256, (5, 7, 3)), ramp, np.zeros((1, 1, 3)), np.repeat(g.integers(0, 256, (1, 9, 3)), 6, axis=0), np.repeat(g.integers(0, 256, (6, 1, 3)), 9, axis=1)):
        picture = picture.astype(np.uint8)
        raw = png_bytes(picture)
        at = raw.index(b"IDAT")
        size = int.from_bytes(raw[at - 4 : at], "big")
        data = zlib.decompress(raw[at + 4 : at + 4 + size])
        height, width, _ = picture.shape
        before, out = [0] * (width * 3), []
        for y in range(height):
            line = data[y * (width * 3 + 1) : (y + 1) * (width * 3 + 1)]
            now = []
            for k, v in enumerate(line[1:]):
                a, b, c = (now[k - 3] if k >= 3 else 0), before[k], (before[k - 3] if k >= 3 else 0)
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                now.append((v + (0, a, b, (a + b) // 2, paeth)[line[0]]) % 256)
            out.append(now)
            before = now
        assert out == picture.reshape(height, width * 3).tolist()


def test_superpixels_by_join_equal_those_in_tasks(spark, monkeypatch):
    from gridloom.operators import superpixel

    pixels = spark.createDataFrame([(k, x, y, (x * 37 + k) % 256, (y * 53) % 256, (x * y) % 256) for k in (1, 2) for x in range(12) for y in range(9)], "image_id long, x int, y int, r int, g int, b int")
    palette = spark.createDataFrame([(k, k * 40 % 256, k * 90 % 256, k * 10) for k in range(12)], "idx int, r int, g int, b int")
    monkeypatch.setattr(superpixel, "ROUNDS", 3)
    want = sorted(map(tuple, superpixel.superpixels(pixels, 12, 9, palette, 4, 3).collect()))
    monkeypatch.setattr(superpixel, "SHARED", 0)
    assert sorted(map(tuple, superpixel.superpixels(pixels, 12, 9, palette, 4, 3).collect())) == want and len(want) == 24
