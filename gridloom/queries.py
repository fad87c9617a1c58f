"""Registered queries of the palette-grid engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import colorspace
from gridloom.operators import layout, render, stats, superpixel
from gridloom.operators.batch import center_crops, crop_boxes, resize_all
from gridloom.operators.despeckle import component_sizes, despeckle
from gridloom.operators.match import match_pattern
from gridloom.operators.reduce import reduce_colors
from gridloom.operators.resample import center_crop, resize
from gridloom.operators.superpixel import superpixels
from gridloom.options import GenerateOptions, Generator, Matcher, Resample
from gridloom.plans.generate import generate_all, image_faults
from gridloom.sources import palettes
from gridloom.sources.raster import IMAGE, SIZES, WIDTH, event_cells, event_files, event_images, event_pixels, part_palette

Query = Callable[[SparkSession, str], DataFrame]

# --- SQL building blocks -----------------------------------------------------
_PIXELS = f"pixels AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST(event_id % {WIDTH} AS INTEGER) AS x, CAST(event_id // {WIDTH} AS INTEGER) AS y, CAST(user_id * 37 % 256 AS INTEGER) AS r, CAST(CAST(floor(value) AS BIGINT) % 256 AS INTEGER) AS g, CAST(event_id * 7 % 256 AS INTEGER) AS b FROM events)"
_CELLS = f"cells AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST(event_id % {WIDTH} AS INTEGER) AS x, CAST(event_id // {WIDTH} AS INTEGER) AS y, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS idx FROM events)"
_PALETTE = "palette AS (SELECT CAST(p_size - 1 AS INTEGER) AS idx, 'P' || p_size AS code, min(p_name) AS name, CAST((sum(p_partkey) + p_size) * 53 % 256 AS INTEGER) AS r, CAST((sum(p_partkey) + p_size * 3) * 101 % 256 AS INTEGER) AS g, CAST(sum(p_partkey) * 11 % 256 AS INTEGER) AS b FROM part GROUP BY p_size)"
_RGB = "rgb AS (SELECT c.r, c.g, c.b, arg_min(p.idx, CAST((c.r-p.r)*(c.r-p.r)+(c.g-p.g)*(c.g-p.g)+(c.b-p.b)*(c.b-p.b) AS BIGINT) * 65536 + p.idx) AS idx FROM (SELECT DISTINCT r, g, b FROM pixels) c, palette p GROUP BY ALL)"
_MATCHED = f"{_PIXELS}, {_PALETTE}, {_RGB}, matched AS (SELECT image_id, x, y, idx FROM pixels JOIN rgb USING (r, g, b))"


def _sql_times(matrix: tuple[tuple[float, ...], ...], v: tuple[str, str, str]) -> list[str]:
    return [" + ".join(f"({a!r}::DOUBLE) * {x}" for a, x in zip(row, v)) for row in matrix]


def _sql_space(kind: Matcher) -> Callable[[str, str], str]:
    """SQL for a table with coordinates c0, c1, c2 in Lab or Oklab, computed apart from the Spark expressions."""
    lin = ", ".join(f"CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN ({c}/255.0::DOUBLE)/12.92 ELSE power((({c}/255.0::DOUBLE)+0.055)/1.055, 2.4) END AS l{c}" for c in "rgb")
    matrix = colorspace.XYZ if kind is Matcher.LAB else colorspace.LMS
    mixed = ", ".join(f"{e} AS m{k}" for k, e in enumerate(_sql_times(matrix, ("lr", "lg", "lb"))))
    if kind is Matcher.LAB:
        d = 6.0 / 29.0
        roots = ", ".join(f"CASE WHEN m{k}/{w!r} > {d**3!r} THEN cbrt(m{k}/{w!r}) ELSE m{k}/{w!r}/{3 * d * d!r} + {4 / 29!r} END AS q{k}" for k, w in enumerate(colorspace.WHITE))
        coords = "116.0*q1-16.0 AS c0, 500.0*(q0-q1) AS c1, 200.0*(q1-q2) AS c2"
    else:
        roots = ", ".join(f"cbrt(m{k}) AS q{k}" for k in range(3))
        coords = ", ".join(f"{e} AS c{k}" for k, e in enumerate(_sql_times(colorspace.OKLAB, ("q0", "q1", "q2"))))
    return lambda table, extra: f"(SELECT {extra}r, g, b, {coords} FROM (SELECT *, {roots} FROM (SELECT *, {mixed} FROM (SELECT *, {lin} FROM {table}))))"


def _sql_perceptual(kind: Matcher) -> str:
    """Nearest indices in Lab or Oklab."""
    space = _sql_space(kind)
    return f"""WITH {_PIXELS}, {_PALETTE}, c AS {space('(SELECT DISTINCT r, g, b FROM pixels)', '')}, p AS {space('palette', 'idx, ')},
    d AS (SELECT c.r, c.g, c.b, p.idx, (c.c0-p.c0)*(c.c0-p.c0)+(c.c1-p.c1)*(c.c1-p.c1)+(c.c2-p.c2)*(c.c2-p.c2) AS d FROM c, p),
    best AS (SELECT r, g, b, idx FROM (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY d, idx) AS k FROM d) WHERE k = 1)
    SELECT image_id, x, y, idx FROM pixels JOIN best USING (r, g, b)"""


def _reduce_sql(most: int) -> str:
    """One merge a step: the least used colour goes to the nearest one in use."""
    return f"""WITH RECURSIVE {_MATCHED}, start AS (
        SELECT list(struct_pack(idx := idx, n := n, r := r, g := g, b := b)) AS used, list(struct_pack(idx := idx, rep := idx)) AS stands
        FROM (SELECT idx, count(*) AS n FROM matched GROUP BY idx) JOIN palette USING (idx)),
    steps(used, stands) AS (SELECT used, stands FROM start UNION ALL
        SELECT list_transform(rest, lambda u: struct_pack(idx := u.idx, n := u.n + CASE WHEN u.idx = target THEN gone.n ELSE 0 END, r := u.r, g := u.g, b := u.b)),
            list_transform(stands, lambda s: struct_pack(idx := s.idx, rep := CASE WHEN s.rep = gone.idx THEN target ELSE s.rep END))
        FROM (SELECT *, list_sort(list_transform(rest, lambda u: struct_pack(d := (u.r - gone.r) * (u.r - gone.r) + (u.g - gone.g) * (u.g - gone.g) + (u.b - gone.b) * (u.b - gone.b), idx := u.idx)))[1].idx AS target
            FROM (SELECT stands, gone, list_filter(used, lambda u: u.idx <> gone.idx) AS rest
                FROM (SELECT used, stands, list_filter(used, lambda u: u.idx = -least_used.k)[1] AS gone
                    FROM (SELECT used, stands, list_sort(list_transform(used, lambda u: struct_pack(n := u.n, k := -u.idx)))[1] AS least_used FROM steps WHERE len(used) > {most})))))
    SELECT image_id, x, y, s.rep AS idx FROM matched JOIN (SELECT unnest(stands) AS s FROM steps WHERE len(used) <= {most}) ON s.idx = matched.idx"""


def _superpixel_sql(to_w: int, to_h: int) -> str:
    """The rounds written one after the other."""
    space = _sql_space(Matcher.OKLAB)
    unit, weight = superpixel.UNIT, superpixel.PLACE * superpixel.PLACE
    sizes = f"s AS MATERIALIZED (SELECT {WIDTH} AS w, max(y) + 1 AS h, {WIDTH} / {to_w}::DOUBLE AS sx, (max(y) + 1) / {to_h}::DOUBLE AS sy FROM pixels)"
    points = f"points AS MATERIALIZED (SELECT x, y, c0 AS v0, c1 AS v1, c2 AS v2, least(floor(x / sx), {to_w - 1}) AS hx, least(floor(y / sy), {to_h - 1}) AS hy FROM {space('pixels', 'x, y, ')}, s)"
    first = f"k0 AS MATERIALIZED (SELECT i.range AS i, j.range AS j, x::DOUBLE AS cx, y::DOUBLE AS cy, v0 AS c0, v1 AS c1, v2 AS c2 FROM range({to_w}) i, range({to_h}) j, s, points WHERE x = least(floor((i.range + 0.5) * sx + 0.5), w - 1) AND y = least(floor((j.range + 0.5) * sy + 0.5), h - 1))"
    rounds = []
    for k in range(superpixel.ROUNDS):
        far = f"(v0 - c0) * (v0 - c0) + (v1 - c1) * (v1 - c1) + (v2 - c2) * (v2 - c2) + {weight!r}::DOUBLE * (((x - cx) / sx) * ((x - cx) / sx) + ((y - cy) / sy) * ((y - cy) / sy))"
        sums = ", ".join(f"sum(CAST(round(v{c} * {unit!r}::DOUBLE) AS BIGINT)) AS s{c}" for c in range(3))
        means = ", ".join(f"coalesce(CAST(s{c} AS DOUBLE) / n / {unit!r}::DOUBLE, c{c}) AS c{c}" for c in range(3))
        rounds.append(f"""b{k} AS (SELECT * FROM (SELECT x, y, v0, v1, v2, i, j, row_number() OVER (PARTITION BY x, y ORDER BY {far}, j, i) AS place FROM points, s, k{k} WHERE i BETWEEN hx - 1 AND hx + 1 AND j BETWEEN hy - 1 AND hy + 1) WHERE place = 1),
        m{k} AS (SELECT i, j, count(*) AS n, {sums}, sum(x) AS tx, sum(y) AS ty FROM b{k} GROUP BY i, j),
        k{k + 1} AS MATERIALIZED (SELECT i, j, coalesce(CAST(tx AS DOUBLE) / n, cx) AS cx, coalesce(CAST(ty AS DOUBLE) / n, cy) AS cy, {means} FROM k{k} LEFT JOIN m{k} USING (i, j))""")
    last = f"k{superpixel.ROUNDS}"
    return f"""WITH {_PIXELS}, {_PALETTE}, {sizes}, {points}, {first}, {', '.join(rounds)}, p AS {space('palette', 'idx, ')}
    SELECT CAST(0 AS BIGINT) AS image_id, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, idx FROM (SELECT i, j, idx, row_number() OVER (PARTITION BY i, j ORDER BY (q.c0-p.c0)*(q.c0-p.c0)+(q.c1-p.c1)*(q.c1-p.c1)+(q.c2-p.c2)*(q.c2-p.c2), idx) AS place FROM {last} q, p) WHERE place = 1"""


_STATS = "used AS (SELECT image_id, idx, count(*) AS count FROM {t} GROUP BY ALL), stats AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY count DESC, idx) AS INTEGER) AS rank, idx, code, name, count FROM used JOIN palette USING (idx))"
_REGIONS = "near(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), reach(x, y, idx, ly, lx) AS (SELECT x, y, idx, y, x FROM cells UNION SELECT c.x, c.y, c.idx, r.ly, r.lx FROM reach r, near n, cells c WHERE c.x = r.x + n.dx AND c.y = r.y + n.dy AND c.idx = r.idx), labels AS (SELECT x, y, idx, min((ly, lx)) AS label FROM reach GROUP BY ALL)"


def _despeckle_sql(s: int, coarse: bool = False) -> str:
    cells = _CELLS.replace("cells AS", "fine AS") + ", cells AS (SELECT image_id, x, y, idx // 2 AS idx FROM fine)" if coarse else _CELLS
    return f"""WITH RECURSIVE {cells}, {_REGIONS}, small AS (SELECT label FROM labels GROUP BY label HAVING count(*) <= {s}),
    votes AS (SELECT a.label, b.idx, count(*) AS v FROM labels a, near n, labels b WHERE b.x = a.x + n.dx AND b.y = a.y + n.dy AND b.idx <> a.idx AND a.label IN (SELECT label FROM small) GROUP BY ALL),
    won AS (SELECT label, idx AS new FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, idx) AS k FROM votes) WHERE k = 1)
    SELECT CAST(0 AS BIGINT) AS image_id, l.x, l.y, coalesce(w.new, l.idx) AS idx FROM labels l LEFT JOIN won w USING (label)"""


def _rows(spark: SparkSession, sf_dir: str) -> int:
    """Full rows of the raster, from the greatest place alone."""
    return event_pixels(spark, sf_dir).agg(F.max("y")).first()[0] + 1


def match_rgb_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_pattern(event_pixels(spark, sf_dir), part_palette(spark, sf_dir), Matcher.RGB)


def match_lab_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_pattern(event_pixels(spark, sf_dir), part_palette(spark, sf_dir), Matcher.LAB)


def match_oklab_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_pattern(event_pixels(spark, sf_dir), part_palette(spark, sf_dir), Matcher.OKLAB)


def match_rgb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_colors(match_rgb_cells(spark, sf_dir), part_palette(spark, sf_dir))


def total_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(event_cells(spark, sf_dir), part_palette(spark, sf_dir, 2))


def color_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_colors(match_rgb_cells(spark, sf_dir))


def legend_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.legend(match_rgb_cells(spark, sf_dir), part_palette(spark, sf_dir))


def highlight_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.highlight(match_rgb_cells(spark, sf_dir), 7)


def cell_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cell_detail(match_rgb_cells(spark, sf_dir), part_palette(spark, sf_dir), 3, 2)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cells(spark, sf_dir).groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(match_rgb_cells(spark, sf_dir), part_palette(spark, sf_dir), _sizes(spark, sf_dir), "Parts")


def pattern_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pattern_json(match_rgb_cells(spark, sf_dir), part_palette(spark, sf_dir), _sizes(spark, sf_dir), "Parts")


def center_crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return center_crop(event_pixels(spark, sf_dir), WIDTH, _rows(spark, sf_dir), 3, 4)


def nearest_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resize(event_pixels(spark, sf_dir), WIDTH, _rows(spark, sf_dir), 37, 150, Resample.NEAREST)


def triangle_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resize(event_pixels(spark, sf_dir), WIDTH, _rows(spark, sf_dir), 37, 7)


def catmull_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resize(event_pixels(spark, sf_dir), WIDTH, _rows(spark, sf_dir), 41, 9, Resample.CATMULL_ROM)


def gaussian_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resize(event_pixels(spark, sf_dir), WIDTH, _rows(spark, sf_dir), 41, 9, Resample.GAUSSIAN)


def lanczos_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resize(event_pixels(spark, sf_dir), WIDTH, _rows(spark, sf_dir), 41, 9, Resample.LANCZOS3)


def turned_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.turned(event_pixels(spark, sf_dir), WIDTH, _rows(spark, sf_dir), 3)


def preview_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview with a palette that lacks every other index."""
    return render.preview(event_cells(spark, sf_dir), part_palette(spark, sf_dir, 2), WIDTH, _rows(spark, sf_dir), 2)


def reduce_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_colors(match_rgb_cells(spark, sf_dir), part_palette(spark, sf_dir), 12, Matcher.RGB)


def _mixed(spark: SparkSession, sf_dir: str, how: Resample) -> DataFrame:
    images, pixels = event_images(spark, sf_dir)
    boxes = crop_boxes(images, 8, 6).select(F.col("cw").cast("int").alias("width"), F.col("ch").cast("int").alias("height"))
    return resize_all(center_crops(pixels, 8, 6), boxes, 8, 6, how)


def mixed_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of five sizes, cropped and resized in one plan."""
    return _mixed(spark, sf_dir, Resample.TRIANGLE)


def mixed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, Resample.NEAREST)


def mixed_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour counts of the whole patterns of images of five sizes, some of which are too small."""
    images, pixels = event_images(spark, sf_dir)
    options = GenerateOptions(8, 6, resample=Resample.NEAREST, matcher=Matcher.RGB)
    return generate_all(images, pixels, part_palette(spark, sf_dir), "Parts", options).stats()


#: Runs of image_fault_rows: options, and the size of the palette.
_FAULTY = (
    (GenerateOptions(0, 9, max_colors=0), 5), (GenerateOptions(9, 0), 0), (GenerateOptions(9, 9, generator=Generator.SUPERPIXEL, max_colors=0), 0),
    (GenerateOptions(1, 40, max_colors=0), 5), (GenerateOptions(40, 1), 70_000), (GenerateOptions(3, 4), 0), (GenerateOptions(3, 4, generator=Generator.SUPERPIXEL), 5),
)


def image_fault_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of every image under several options."""
    files = event_files(spark, sf_dir)
    runs = [image_faults(files, size, options).select(F.lit(k).alias("run"), "image_id", "kind", "reason") for k, (options, size) in enumerate(_FAULTY)]
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def identity_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of the target's size is copied, whatever the kernel."""
    rows = _rows(spark, sf_dir)
    pixels = event_pixels(spark, sf_dir).withColumns({"width": F.lit(WIDTH), "height": F.lit(rows)})
    return resize_all(pixels, pixels, WIDTH, rows, Resample.GAUSSIAN)


def reduce_not_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that the used colours keep leaves all cells."""
    return reduce_colors(match_rgb_cells(spark, sf_dir), part_palette(spark, sf_dir), 50, Matcher.RGB)


def pattern_json_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern document from its fragments."""
    parts = stats.json_parts(match_rgb_cells(spark, sf_dir), part_palette(spark, sf_dir), _sizes(spark, sf_dir), "Parts", 7)
    ordered = F.sort_array(F.collect_list(F.struct("part", F.col("body").cast("string").alias("body"))))
    return parts.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda p: p["body"]), "").alias("pattern"))


def component_sizes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_sizes(event_cells(spark, sf_dir))


def despeckle_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return despeckle(event_cells(spark, sf_dir), 1)


def _coarse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by twos, so that regions of one colour grow to dozens of cells."""
    return event_cells(spark, sf_dir).withColumn("idx", F.floor(F.col("idx") / 2).cast("int"))


def despeckle_s100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return despeckle(_coarse_cells(spark, sf_dir), 100)


def despeckle_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold beyond the grid's area: every region is small."""
    return despeckle(_coarse_cells(spark, sf_dir), 1 << 31)


def despeckle_s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return despeckle(event_cells(spark, sf_dir), 3)


def preview_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.preview(match_rgb_cells(spark, sf_dir), part_palette(spark, sf_dir), WIDTH, _rows(spark, sf_dir), 3)


def grid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.grid(match_rgb_cells(spark, sf_dir), part_palette(spark, sf_dir), WIDTH, _rows(spark, sf_dir), 5)


def superpixel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superpixels(event_pixels(spark, sf_dir), WIDTH, _rows(spark, sf_dir), part_palette(spark, sf_dir), 20, 5)


def palette_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One palette document per part size, made from the part table; a few break a rule."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    rgb = F.when(F.col("p_partkey") % 97 == 5, F.lit("#12345")).otherwise(F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")))
    code = F.when((F.col("p_size") == 7) & (F.col("p_partkey") % 2 == 0), F.lit("SAME")).otherwise(F.concat(F.lit("C"), F.col("p_partkey").cast("string")))
    colors = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", code.alias("code"), F.col("p_name").alias("name"), rgb.alias("rgb")))), lambda c: F.struct(c["code"].alias("code"), c["name"].alias("name"), c["rgb"].alias("rgb")))
    made = parts.groupBy("p_size").agg(colors.alias("colors"))
    return made.select(F.col("p_size").cast("string").alias("palette_id"), F.to_json(F.struct(F.concat(F.lit("Size "), F.col("p_size").cast("string")).alias("brand"), "colors")).alias("json"))


_PALETTE_ROWS = """rows AS (SELECT CAST(p_size AS VARCHAR) AS palette_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INTEGER) AS idx,
    CASE WHEN p_size = 7 AND p_partkey % 2 = 0 THEN 'SAME' ELSE 'C' || p_partkey END AS code, p_name AS name,
    CASE WHEN p_partkey % 97 = 5 THEN '#12345' ELSE '#' || lpad(upper(to_hex(p_partkey * 7919 % 16777216)), 6, '0') END AS rgb FROM part)"""


def palette_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.parse(palette_documents(spark, sf_dir)).select("palette_id", "idx", "code", "r", "g", "b")


def palette_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.faults(palettes.parse(palette_documents(spark, sf_dir)))


def broken_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents by turns cut short, without a name, without colours, with short colours, and as they are."""
    size = F.col("palette_id").cast("int") % 5
    text = F.col("json")
    cut = F.expr("substring(json, 1, length(json) - 9)")
    nameless = F.regexp_replace(text, '"name":"[^"]*",', "")
    empty = F.regexp_replace(text, '"colors":.*$', '"colors":[]}')
    short = F.regexp_replace(text, '"#(.).(.).(.)."', '"#$1$2$3"')
    return palette_documents(spark, sf_dir).select("palette_id", F.when(size == 0, cut).when(size == 1, nameless).when(size == 2, empty).when(size == 3, short).otherwise(text).alias("json"))


def palette_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.faults(palettes.parse(broken_documents(spark, sf_dir)))


def palette_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of the documents that parse, three digits standing for six."""
    return palettes.parse(broken_documents(spark, sf_dir), lenient=True).where("code IS NOT NULL").select("palette_id", "idx", "code", "r", "g", "b")


def palette_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.counts(palette_documents(spark, sf_dir))


def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes asked for by name: two sizes of part name a known one, every other part names its brand."""
    asked = F.when(F.col("p_size") == 3, F.lit("perler")).when(F.col("p_size") == 5, F.lit("yant")).otherwise(F.col("p_brand"))
    return palettes.lookup(spark.read.parquet(f"{sf_dir}/part.parquet").select(asked.alias("palette_id")).distinct())


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per event, all numbers in binary fractions, so that halves round alike everywhere."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    return e.select("event_id", (k % 301 + 20).cast("int").alias("src_w"), (k % 203 + 20).cast("int").alias("src_h"), ((k % 7 + 2) / 4.0).alias("aspect"), (k % 9 / 4.0).alias("zoom"), ((k % 13 - 6) / 4.0).alias("pan_x"), ((k % 11 - 5) / 4.0).alias("pan_y"), (k % 5 - 2).cast("int").alias("turns"))


def crop_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.crop_rect(_requests(spark, sf_dir)).select("event_id", "x", "y", "w", "h")


def cover_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least zoom at which each source covers its frame."""
    return _requests(spark, sf_dir).select("event_id", layout.cover_scale(F.col("src_w"), F.col("src_h"), F.col("aspect")).alias("scale"))


def locked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _requests(spark, sf_dir).select("event_id", (F.col("src_w") * 4).alias("value"), "aspect", (F.col("turns") > 0).alias("by_width"))
    return layout.locked_pair(e).select("event_id", "w", "h")


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", (k % 120 + 1).cast("int").alias("width"), (k % 117 + 1).cast("int").alias("height"), (k % 4).cast("int").alias("border"), ((k % 3 + 1) * 5).cast("double").alias("cell"), (k % 1500 / 2.0).alias("px"), (k % 1300 / 2.0).alias("py"))


def hit_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.hit_test(_boards(spark, sf_dir)).select("event_id", "row", "col")


def layout_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ticks(_boards(spark, sf_dir).drop("px", "py")).select("event_id", "axis", "n", F.col("at").cast("long").alias("at"))


def board_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.board(_boards(spark, sf_dir)).select("event_id", "left", "top", "board_cols", "board_rows", "content_x", "content_y", "canvas_w", "canvas_h")


def saved_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _boards(spark, sf_dir).withColumn("width", F.col("width") * 9)
    return layout.save_cell(wide.drop("cell", "px", "py")).select("event_id", "cell")


def cell_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _boards(spark, sf_dir).drop("px", "py").withColumns({"row": (F.col("event_id") % F.col("height")).cast("int"), "col": (F.col("event_id") % F.col("width")).cast("int")})
    return layout.cell_centre(places).select("event_id", "px", "py")


def viewport_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    taps = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *((k % m / 2.0).alias(c) for c, m in (("tap_x", 900), ("tap_y", 700), ("offset_x", 31), ("offset_y", 17))), F.pow(F.lit(2.0), k % 5 - 2).alias("scale"), (k % 7 * 1.0).alias("origin_x"), (k % 3 * 1.0).alias("origin_y"))
    return layout.viewport_to_canvas(taps).select("event_id", "px", "py")


def preset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.presets(_requests(spark, sf_dir).select("aspect"))


def frame_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.aspect_presets(_requests(spark, sf_dir).select((F.col("turns") > 0).alias("landscape")))


def u32_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as they are typed: with blanks, signs, too large, or none at all."""
    k = F.col("event_id")
    typed = F.when(k % 7 == 0, F.lit("")).when(k % 7 == 1, F.concat(F.lit(" "), (k * 1_000_003).cast("string"))).when(k % 7 == 2, F.concat(F.lit("-"), k.cast("string"))).when(k % 7 == 3, F.lit("12a")).when(k % 7 == 4, F.concat(F.lit("99999999"), k.cast("string"))).otherwise(k.cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", layout.read_u32(typed).alias("value"), layout.clamp_border((k % 23 - 7).cast("int")).alias("rings"))


def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences of which a few are stored, one for each size of part."""
    known = F.create_map(*(F.lit(x) for pair in ((1, "generator"), (2, "border_rings"), (3, "width"), (4, "limit_colors")) for x in pair))
    value = F.create_map(*(F.lit(x) for pair in ((1, "bogus"), (2, "99"), (3, "64"), (4, "true")) for x in pair))
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size").distinct()
    return layout.settings(sizes.select(F.try_element_at(known, "p_size").alias("name"), F.try_element_at(value, "p_size").alias("value")).where("name IS NOT NULL"))


_SUM = "string_agg(code || ' ' || name || ': ' || count || chr(10), '' ORDER BY rank)"
_REQUESTS = "q AS (SELECT event_id, event_id % 301 + 20 AS sw, event_id % 203 + 20 AS sh, (event_id % 7 + 2) / 4.0::DOUBLE AS a, (event_id % 9) / 4.0::DOUBLE AS z, (event_id % 13 - 6) / 4.0::DOUBLE AS px, (event_id % 11 - 5) / 4.0::DOUBLE AS py, event_id % 5 - 2 AS t FROM events)"
_BOARDS = "q AS (SELECT event_id, event_id % 120 + 1 AS w, event_id % 117 + 1 AS h, event_id % 4 AS k, CAST((event_id % 3 + 1) * 5 AS DOUBLE) AS c, (event_id % 1500) / 2.0::DOUBLE AS px, (event_id % 1300) / 2.0::DOUBLE AS py FROM events), b AS (SELECT *, CASE WHEN h >= 10 THEN c / 5 * (4 * length(CAST(h // 10 * 10 AS VARCHAR)) + 1) ELSE 0 END AS l, CASE WHEN w >= 10 THEN 7 * c / 5 ELSE 0 END AS t FROM q)"


def _crop_sql(tw: int, th: int) -> str:
    return f"""WITH {_PIXELS}, s AS (SELECT {WIDTH} AS w, max(y) + 1 AS h FROM pixels),
    c AS (SELECT w, h, CASE WHEN w * {th} > h * {tw} THEN h * {tw} // {th} ELSE w END AS cw, CASE WHEN w * {th} < h * {tw} THEN w * {th} // {tw} ELSE h END AS ch FROM s)
    SELECT image_id, CAST(x - (w - cw) // 2 AS INTEGER) AS x, CAST(y - (h - ch) // 2 AS INTEGER) AS y, r, g, b FROM pixels, c
    WHERE x >= (w - cw) // 2 AND x < (w - cw) // 2 + cw AND y >= (h - ch) // 2 AND y < (h - ch) // 2 + ch"""


_NEAREST = f"""WITH {_PIXELS}, s AS (SELECT max(y) + 1 AS h FROM pixels)
    SELECT p.image_id, CAST(ox.range AS INTEGER) AS x, CAST(oy.range AS INTEGER) AS y, r, g, b FROM range(37) ox, range(150) oy, s, pixels p
    WHERE p.x = (2 * ox.range + 1) * {WIDTH} // 74 AND p.y = (2 * oy.range + 1) * s.h // 300"""

ORACLE = {
    "match_rgb_cells": f"WITH {_MATCHED} SELECT * FROM matched",
    "match_lab_cells": _sql_perceptual(Matcher.LAB),
    "match_oklab_cells": _sql_perceptual(Matcher.OKLAB),
    "match_rgb_stats": f"WITH {_MATCHED}, {_STATS.format(t='matched')} SELECT * FROM stats",
    "total_and_missing": f"WITH {_CELLS} SELECT image_id, count(*) AS total, count(*) FILTER (idx % 2 = 0) AS known, count(*) FILTER (idx % 2 = 0) < count(*) AS wrong_palette FROM cells GROUP BY image_id",
    "color_count": f"WITH {_MATCHED} SELECT image_id, count(DISTINCT idx) AS colors FROM matched GROUP BY image_id",
    "legend_top5": f"WITH {_MATCHED}, {_STATS.format(t='matched')} SELECT image_id, rank, stats.code, stats.name, count, r, g, b FROM stats JOIN palette USING (idx) WHERE rank <= 5",
    "highlight_cells": f"WITH {_MATCHED} SELECT * FROM matched WHERE idx = 7",
    "cell_detail": f"WITH {_MATCHED}, {_STATS.format(t='matched')} SELECT image_id, idx, code, name, count FROM matched JOIN stats USING (image_id, idx) WHERE x = 3 AND y = 2",
    "summary_text": f"WITH {_MATCHED}, {_STATS.format(t='matched')} SELECT image_id, 'Bead Pattern Summary' || chr(10) || 'Size: {WIDTH} x ' || (SELECT max(y) + 1 FROM matched) || chr(10) || 'Total Beads: ' || (SELECT count(*) FROM matched) || chr(10) || 'Palette: Parts' || chr(10) || chr(10) || {_SUM} AS summary FROM stats GROUP BY image_id",
    "center_crop_pixels": _crop_sql(3, 4),
    "nearest_resize": _NEAREST,
    "component_sizes_events": f"WITH RECURSIVE {_CELLS}, {_REGIONS} SELECT CAST(0 AS BIGINT) AS image_id, idx, label[2] AS x, label[1] AS y, count(*) AS n FROM labels GROUP BY idx, label",
    "despeckle_s1": _despeckle_sql(1),
    "despeckle_s3": _despeckle_sql(3),
    "despeckle_s100": _despeckle_sql(100, coarse=True),
    "despeckle_any": _despeckle_sql(1 << 31, coarse=True),
    "preview_pixels": f"WITH {_MATCHED} SELECT image_id, CAST(x * 3 + dx.range AS INTEGER) AS px, CAST(y * 3 + dy.range AS INTEGER) AS py, r, g, b FROM matched JOIN palette USING (idx), range(3) dx, range(3) dy",
    "palette_colors": f"WITH {_PALETTE_ROWS} SELECT palette_id, idx, code, " + ", ".join(f"CASE WHEN length(rgb) = 7 THEN CAST('0x' || substr(rgb, {k}, 2) AS INTEGER) END AS {c}" for c, k in zip("rgb", (2, 4, 6))) + " FROM rows",
    "palette_validate": f"""WITH {_PALETTE_ROWS}, bad AS (SELECT palette_id, arg_min(code, idx) AS code FROM rows WHERE length(rgb) < 7 GROUP BY 1),
        twice AS (SELECT palette_id, arg_min(code, f) AS code FROM (SELECT palette_id, code, min(idx) AS f FROM rows GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
        SELECT palette_id, 'InvalidPalette' AS kind, coalesce('bad hex for color ' || bad.code, 'duplicate code ' || twice.code) AS reason FROM bad FULL JOIN twice USING (palette_id)""",
    "palette_counts": f"WITH {_PALETTE_ROWS} SELECT palette_id, CAST(count(*) AS INTEGER) AS colors FROM rows GROUP BY 1",
    "palette_lookup": "SELECT DISTINCT CASE p_size WHEN 3 THEN 'perler' WHEN 5 THEN 'yant' ELSE p_brand END AS palette_id, CASE p_size WHEN 3 THEN 'perler' WHEN 5 THEN 'yant' ELSE 'mard' END AS entry, CASE p_size WHEN 3 THEN 'Perler' WHEN 5 THEN 'Yant' ELSE 'MARD' END AS brand FROM part",
    "crop_rects": f"""WITH {_REQUESTS}, o AS (SELECT *, CASE WHEN abs(t) % 2 = 1 THEN sh ELSE sw END AS iw, CASE WHEN abs(t) % 2 = 1 THEN sw ELSE sh END AS ih FROM q),
        c AS (SELECT *, least(iw, a * ih) / greatest(z, 1) AS cw, least(ih, iw / a) / greatest(z, 1) AS ch FROM o),
        s AS (SELECT *, greatest(1, least(CAST(floor(cw + 0.5) AS INTEGER), iw)) AS w, greatest(1, least(CAST(floor(ch + 0.5) AS INTEGER), ih)) AS h FROM c)
        SELECT event_id, CAST(greatest(0, least(floor(greatest(0, iw - cw) / 2 * (1 + greatest(-1, least(1, px))) + 0.5), iw - w)) AS INTEGER) AS x, CAST(greatest(0, least(floor(greatest(0, ih - ch) / 2 * (1 + greatest(-1, least(1, py))) + 0.5), ih - h)) AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM s""",
    "locked_pairs": f"""WITH {_REQUESTS}, s AS (SELECT event_id, CASE WHEN t > 0 THEN CAST(sw * 4 AS DOUBLE) ELSE sw * 4 * a END AS w, CASE WHEN t > 0 THEN sw * 4 / a ELSE CAST(sw * 4 AS DOUBLE) END AS h FROM q)
        SELECT event_id, CAST(greatest(1, least(1000, floor(CASE WHEN greatest(w, h) > 1000 THEN w * 1000 / greatest(w, h) ELSE w END + 0.5))) AS INTEGER) AS w, CAST(greatest(1, least(1000, floor(CASE WHEN greatest(w, h) > 1000 THEN h * 1000 / greatest(w, h) ELSE h END + 0.5))) AS INTEGER) AS h FROM s""",
    "hit_tests": f"""WITH {_BOARDS}, f AS (SELECT *, floor((px - l) / c) - k AS col, floor((py - t) / c) - k AS row FROM b)
        SELECT event_id, CASE WHEN col BETWEEN 0 AND w - 1 AND row BETWEEN 0 AND h - 1 THEN CAST(row AS INTEGER) END AS row, CASE WHEN col BETWEEN 0 AND w - 1 AND row BETWEEN 0 AND h - 1 THEN CAST(col AS INTEGER) END AS col FROM f""",
    "layout_ticks": f"WITH {_BOARDS} SELECT event_id, 'col' AS axis, CAST(r.range AS INTEGER) AS n, CAST(l + k * c + r.range * c AS BIGINT) AS at FROM b, range(10, 121, 10) r WHERE r.range <= w UNION ALL SELECT event_id, 'row', CAST(r.range AS INTEGER), CAST(t + k * c + r.range * c AS BIGINT) FROM b, range(10, 121, 10) r WHERE r.range <= h",
}


def _grid_sql(cell: int = 5) -> str:
    """Layers by depth; the label glyphs come as values for sf 0.01's 100 x 100 raster or any other by its height."""
    glyphs = ", ".join(f"({d}, {k % 3}, {k // 3})" for d, bits in enumerate(render.GLYPHS) for k, on in enumerate(bits) if on == "1")
    s = max(1, cell // 5)
    return f"""WITH {_MATCHED}, s AS (SELECT {WIDTH} AS w, max(y) + 1 AS h FROM matched),
    g AS (SELECT w, h, CASE WHEN h >= 10 THEN (4 * length(CAST(h // 10 * 10 AS VARCHAR)) - 1) * {s} + 2 * {s} ELSE 0 END AS l, {7 * s} AS t FROM s),
    o AS (SELECT *, l + w * {cell} AS ow, t + h * {cell} AS oh FROM g),
    px AS (SELECT a.range AS px, b.range AS py, o.* FROM o, range((SELECT ow FROM o)) a, range((SELECT oh FROM o)) b),
    vx AS (SELECT i.range AS i, least(l + i.range * {cell} + d.range, ow - 1) AS pos FROM o, range({WIDTH} + 1) i, range(2) d WHERE i.range % 10 = 0 OR d.range = 0),
    hy AS (SELECT i.range AS i, least(t + i.range * {cell} + d.range, oh - 1) AS pos FROM o, range((SELECT h + 1 FROM o)) i, range(2) d WHERE i.range % 10 = 0 OR d.range = 0),
    gl(d, gx, gy) AS (VALUES {glyphs}),
    lab AS (SELECT n.range AS n, l + n.range * {cell} - (4 * length(CAST(n.range AS VARCHAR)) - 1) * {s} AS x, {s} AS y FROM o, range(10, {WIDTH} + 1, 10) n
      UNION ALL SELECT n.range, l - {s} - (4 * length(CAST(n.range AS VARCHAR)) - 1) * {s}, t + (n.range - 1) * {cell} FROM o, range(10, (SELECT h + 1 FROM o), 10) n),
    ink AS (SELECT DISTINCT x + (4 * k.range + gx) * {s} + a.range AS px, y + gy * {s} + b.range AS py FROM lab, range(7) k, gl, range({s}) a, range({s}) b
      WHERE k.range < length(CAST(n AS VARCHAR)) AND d = CAST(substr(CAST(n AS VARCHAR), CAST(k.range AS INTEGER) + 1, 1) AS INTEGER)),
    z AS (SELECT px.px, px.py, CASE WHEN ink.px IS NOT NULL THEN 0
        WHEN px.px >= l AND px.py >= t AND (px.px IN (SELECT pos FROM vx WHERE i % 10 = 0) OR px.py IN (SELECT pos FROM hy WHERE i % 10 = 0)) THEN 120
        WHEN px.px >= l AND px.py >= t AND (px.px IN (SELECT pos FROM vx) OR px.py IN (SELECT pos FROM hy)) THEN 200
        WHEN px.px < l OR px.py < t THEN 255 END AS grey, (px.px - l) // {cell} AS x, (px.py - t) // {cell} AS y FROM px LEFT JOIN ink USING (px, py))
    SELECT CAST(0 AS BIGINT) AS image_id, CAST(z.px AS INTEGER) AS px, CAST(z.py AS INTEGER) AS py, coalesce(grey, c.r) AS r, coalesce(grey, c.g) AS g, coalesce(grey, c.b) AS b
    FROM z LEFT JOIN (SELECT m.x, m.y, p.r, p.g, p.b FROM matched m JOIN palette p USING (idx)) c ON c.x = z.x AND c.y = z.y AND z.px >= 0"""


def _triangle_sql(tw: int, th: int) -> str:
    def weights(name: str, source: str, target: int) -> str:
        return f"""{name}0 AS (SELECT o.range AS o, s.range AS s, 1 - abs(s.range + 0.5 - (o.range + 0.5) * ({source}) / {target}::DOUBLE) / greatest(1.0, ({source}) / {target}::DOUBLE) AS w FROM range({target}) o, range({source}) s),
        {name} AS (SELECT o, s, w / sum(w) OVER (PARTITION BY o) AS w FROM {name}0 WHERE w > 0)"""

    mix = ", ".join(f"sum(q.{c} * w) AS {c}" for c in "rgb")
    whole = ", ".join(f"CAST(least(255, greatest(0, floor(sum(q.{c} * w) + 0.5))) AS INTEGER) AS {c}" for c in "rgb")
    return f"""WITH {_PIXELS}, {weights('wx', str(WIDTH), tw)}, {weights('wy', '(SELECT max(y) + 1 FROM pixels)', th)},
    wide AS (SELECT image_id, o AS x, y, {mix} FROM pixels q JOIN wx ON q.x = wx.s GROUP BY ALL)
    SELECT image_id, CAST(x AS INTEGER) AS x, CAST(o AS INTEGER) AS y, {whole} FROM wide q JOIN wy ON q.y = wy.s GROUP BY image_id, x, o"""


ORACLE["grid_pixels"] = _grid_sql()
ORACLE["reduce_rgb"] = _reduce_sql(12)
ORACLE["superpixel_cells"] = _superpixel_sql(20, 5)
ORACLE["triangle_resize"] = _triangle_sql(37, 7)
ORACLE["pattern_json"] = f"""WITH {_MATCHED}, {_STATS.format(t='matched')}
    SELECT image_id, CAST(to_json(struct_pack(brand := 'Parts', width := {WIDTH}, height := max(y) + 1, cells := list(idx ORDER BY y, x), total := count(*), stats := (SELECT list(struct_pack(code := code, name := name, count := count) ORDER BY rank) FROM stats))) AS VARCHAR) AS pattern FROM matched GROUP BY image_id"""


def _kernel_sql(reach: float, kernel: str, tw: int, th: int) -> str:
    """Separable resampling by a kernel of the distance d, apart from the Spark weights."""

    def weights(name: str, source: str, target: int) -> str:
        return f"""{name}0 AS (SELECT o.range AS o, s.range AS s, abs(s.range + 0.5 - (o.range + 0.5) * ({source}) / {target}::DOUBLE) / greatest(1.0, ({source}) / {target}::DOUBLE) AS d FROM range({target}) o, range({source}) s),
        {name}1 AS (SELECT o, s, {kernel} AS w FROM {name}0 WHERE d < {reach}),
        {name} AS (SELECT o, s, w / sum(w) OVER (PARTITION BY o) AS w FROM {name}1)"""

    mix = ", ".join(f"sum(q.{c} * w) AS {c}" for c in "rgb")
    whole = ", ".join(f"CAST(least(255, greatest(0, floor(sum(q.{c} * w) + 0.5))) AS INTEGER) AS {c}" for c in "rgb")
    return f"""WITH {_PIXELS}, {weights('wx', str(WIDTH), tw)}, {weights('wy', '(SELECT max(y) + 1 FROM pixels)', th)},
    wide AS (SELECT image_id, o AS x, y, {mix} FROM pixels q JOIN wx ON q.x = wx.s GROUP BY ALL)
    SELECT image_id, CAST(x AS INTEGER) AS x, CAST(o AS INTEGER) AS y, {whole} FROM wide q JOIN wy ON q.y = wy.s GROUP BY image_id, x, o"""


_ASPECT_ROWS = ", ".join(f"({a}, {b})" for a, b in layout.ASPECTS)
_TYPED = "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' || event_id * 1000003 WHEN 2 THEN '-' || event_id WHEN 3 THEN '12a' WHEN 4 THEN '99999999' || event_id ELSE event_id::VARCHAR END"
ORACLE |= {
    "catmull_resize": _kernel_sql(2, "CASE WHEN d < 1 THEN 1.5 * d * d * d - 2.5 * d * d + 1 ELSE -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2 END", 41, 9),
    "gaussian_resize": _kernel_sql(3, "exp(-2 * d * d)", 41, 9),
    "lanczos_resize": _kernel_sql(3, "CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END", 41, 9),
    "turned_pixels": f"WITH {_PIXELS} SELECT image_id, y AS x, CAST({WIDTH - 1} - x AS INTEGER) AS y, r, g, b FROM pixels",
    "preview_missing": f"WITH {_CELLS}, {_PALETTE} SELECT image_id, CAST(x * 2 + dx.range AS INTEGER) AS px, CAST(y * 2 + dy.range AS INTEGER) AS py, coalesce(r, 255) AS r, coalesce(g, 0) AS g, coalesce(b, 255) AS b FROM cells LEFT JOIN palette ON palette.idx * 2 = cells.idx, range(2) dx, range(2) dy",
    "board_sizes": f'WITH {_BOARDS} SELECT event_id, l AS "left", t AS top, CAST(w + 2 * k AS INTEGER) AS board_cols, CAST(h + 2 * k AS INTEGER) AS board_rows, l + k * c AS content_x, t + k * c AS content_y, l + (w + 2 * k) * c AS canvas_w, t + (h + 2 * k) * c AS canvas_h FROM b',
    "saved_cells": """WITH q AS (SELECT event_id, (event_id % 120 + 1) * 9 AS w, event_id % 117 + 1 AS h, event_id % 4 AS k FROM events),
        f AS (SELECT *, CAST(greatest(4, least(10, floor(4096 / (greatest(w, h) + 2 * k)))) AS DOUBLE) AS c FROM q),
        z AS (SELECT *, greatest(CASE WHEN h >= 10 THEN c / 5 * (4 * length(CAST(h // 10 * 10 AS VARCHAR)) + 1) ELSE 0 END + (w + 2 * k) * c, CASE WHEN w >= 10 THEN 7 * (c / 5) ELSE 0 END + (h + 2 * k) * c) AS e FROM f)
        SELECT event_id, CASE WHEN e > 4096 THEN c * 4096 / e ELSE c END AS cell FROM z""",
    "cell_centres": f"WITH {_BOARDS} SELECT event_id, l + k * c + (event_id % w + 0.5) * c AS px, t + k * c + (event_id % h + 0.5) * c AS py FROM b",
    "viewport_taps": "SELECT event_id, (event_id % 900 / 2.0 - event_id % 31 / 2.0) / power(2.0, event_id % 5 - 2) - event_id % 7 AS px, (event_id % 700 / 2.0 - event_id % 17 / 2.0) / power(2.0, event_id % 5 - 2) - event_id % 3 AS py FROM events",
    "preset_sizes": f"WITH {_REQUESTS} SELECT DISTINCT a AS aspect, s AS w, CAST(greatest(1, least(1000, floor(s / a + 0.5))) AS INTEGER) AS h FROM q, (VALUES (50), (80), (100)) v(s)",
    "frame_ratios": f"WITH {_REQUESTS} SELECT DISTINCT t > 0 AS landscape, CASE WHEN t > 0 THEN y ELSE x END AS w, CASE WHEN t > 0 THEN x ELSE y END AS h FROM q, (VALUES {_ASPECT_ROWS}) v(x, y)",
    "u32_reads": f"SELECT event_id, CAST(greatest(0, least(4294967295, try_cast(trim({_TYPED}) AS HUGEINT))) AS BIGINT) AS value, CAST(greatest(0, least(8, event_id % 23 - 7)) AS INTEGER) AS rings FROM events WHERE event_id % 7 NOT IN (0, 3) UNION ALL SELECT event_id, NULL, CAST(greatest(0, least(8, event_id % 23 - 7)) AS INTEGER) FROM events WHERE event_id % 7 IN (0, 3)",
    "stored_settings": "SELECT * FROM (VALUES ('palette_id', 'mard'), ('generator', 'staged'), ('limit_colors', 'true'), ('max_colors', '24'), ('despeckle_on', 'false'), ('despeckle', '2'), ('width', '64'), ('border_rings', '8')) v(name, value)",
}


_IMAGES = f"""images AS (SELECT event_id // {IMAGE} AS image_id, event_id % {IMAGE} AS place, CAST([{', '.join(map(str, SIZES))}][event_id // {IMAGE} % {len(SIZES)} + 1] AS BIGINT) AS width, CAST(user_id * 37 % 256 AS INTEGER) AS r, CAST(CAST(floor(value) AS BIGINT) % 256 AS INTEGER) AS g, CAST(event_id * 7 % 256 AS INTEGER) AS b FROM events),
    boxes AS (SELECT DISTINCT width, {IMAGE} // width AS height, CASE WHEN width * 6 > {IMAGE} // width * 8 THEN {IMAGE} // width * 8 // 6 ELSE width END AS cw, CASE WHEN width * 6 < {IMAGE} // width * 8 THEN width * 6 // 8 ELSE {IMAGE} // width END AS ch FROM images),
    cut AS (SELECT image_id, cw, ch, place % width - (width - cw) // 2 AS x, place // width - (height - ch) // 2 AS y, r, g, b FROM images JOIN boxes USING (width)
      WHERE place // width < height AND place % width - (width - cw) // 2 BETWEEN 0 AND cw - 1 AND place // width - (height - ch) // 2 BETWEEN 0 AND ch - 1)"""
_CHOSEN = f"""{_IMAGES}, chosen AS (SELECT image_id, CAST(ox.range AS INTEGER) AS x, CAST(oy.range AS INTEGER) AS y, r, g, b FROM cut, range(8) ox, range(6) oy WHERE x = (2 * ox.range + 1) * cw // 16 AND y = (2 * oy.range + 1) * ch // 12)"""


def _mixed_triangle_sql() -> str:
    """Weights for each of the sides that occur."""

    def weights(name: str, side: str, target: int) -> str:
        far = f"abs(s.range + 0.5 - (o.range + 0.5) * side / {target}::DOUBLE) / greatest(1.0, side / {target}::DOUBLE)"
        return f"""{name}0 AS (SELECT side, o.range AS o, s.range AS s, 1 - {far} AS w FROM (SELECT DISTINCT {side} AS side FROM boxes), range({target}) o, range({max(SIZES)}) s WHERE s.range < side),
        {name} AS (SELECT side, o, s, w / sum(w) OVER (PARTITION BY side, o) AS w FROM {name}0 WHERE w > 0)"""

    # sums of integers of 2^-30, as the operator states, so that ties do not hang on the order of rows
    total = {c: f"CAST(sum(CAST(round(q.{c} * w * 1073741824) AS BIGINT)) AS DOUBLE) / 1073741824" for c in "rgb"}
    mix = ", ".join(f"{t} AS {c}" for c, t in total.items())
    whole = ", ".join(f"CAST(least(255, greatest(0, floor({t} + 0.5))) AS INTEGER) AS {c}" for c, t in total.items())
    return f"""WITH {_IMAGES}, {weights('wx', 'cw', 8)}, {weights('wy', 'ch', 6)},
    wide AS (SELECT image_id, ch, o AS x, y, {mix} FROM cut q JOIN wx ON q.cw = wx.side AND q.x = wx.s GROUP BY ALL)
    SELECT image_id, CAST(x AS INTEGER) AS x, CAST(o AS INTEGER) AS y, {whole} FROM wide q JOIN wy ON q.ch = wy.side AND q.y = wy.s GROUP BY image_id, x, o"""


def _fault_sql() -> str:
    """One CASE a run; what the options alone decide is written out."""

    def run(k: int, options: GenerateOptions, size: int) -> str:
        w, h = options.width, options.height
        head = f"SELECT {k} AS run, event_id AS image_id, CASE "
        if w == 0 or h == 0:
            return head + f"WHEN true THEN ['InvalidImage', 'target {'width' if w == 0 else 'height'} is 0'] END AS f FROM files"
        cw, ch = f"CASE WHEN fw * {h} > fh * {w} THEN fh * {w} // {h} ELSE fw END", f"CASE WHEN fw * {h} < fh * {w} THEN fw * {h} // {w} ELSE fh END"
        cases = ["WHEN event_type = 'error' THEN ['ImageDecode', 'not a supported image: ' || event_id]", "WHEN fw = 0 THEN ['InvalidImage', 'source width is 0']", "WHEN fh = 0 THEN ['InvalidImage', 'source height is 0']"]
        cases += [f"WHEN ({c}) = 0 THEN ['InvalidImage', 'computed crop {side} floored to 0']" for c, side in ((cw, "width"), (ch, "height"))]
        if options.generator is Generator.SUPERPIXEL:
            cases.append(f"WHEN ({cw}) < {w} OR ({ch}) < {h} THEN ['InvalidImage', 'target {w}x{h} exceeds source ' || ({cw}) || 'x' || ({ch})]")
        rest = "['InvalidImage', 'max_colors must be at least 1']" if options.max_colors == 0 else "['InvalidPalette', 'palette has no colors']" if not size else "['InvalidPalette', 'palette has more than 65536 colors']" if size > 65_536 else "NULL"
        return head + " ".join(cases) + f" ELSE {rest} END AS f FROM files"

    runs = " UNION ALL ".join(run(k, *x) for k, x in enumerate(_FAULTY))
    return f"WITH files AS (SELECT event_id, event_type, user_id % 50 AS fw, event_id % 37 AS fh FROM events) SELECT run, image_id, f[1] AS kind, f[2] AS reason FROM ({runs}) WHERE f IS NOT NULL"


_BROKEN = f"""{_PALETTE_ROWS}, kinds AS (SELECT *, CAST(palette_id AS INTEGER) % 5 AS k FROM rows)"""
ORACLE["pattern_json_joined"] = ORACLE["pattern_json"]
ORACLE |= {
    "cover_scales": f"WITH {_REQUESTS} SELECT event_id, greatest(a / sw, 1.0::DOUBLE / sh) AS scale FROM q",
    "identity_resize": f"WITH {_PIXELS} SELECT * FROM pixels",
    "reduce_not_needed": f"WITH {_MATCHED} SELECT * FROM matched",
    "palette_broken": f"""WITH {_BROKEN}, bad AS (SELECT palette_id, arg_min(code, idx) AS code FROM kinds WHERE k = 3 OR k = 4 AND length(rgb) < 7 GROUP BY 1),
        twice AS (SELECT palette_id, arg_min(code, f) AS code FROM (SELECT palette_id, code, min(idx) AS f FROM kinds WHERE k IN (3, 4) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
        SELECT DISTINCT palette_id, 'PaletteParse' AS kind, 'document or field missing' AS reason FROM kinds WHERE k IN (0, 1)
        UNION ALL SELECT DISTINCT palette_id, 'InvalidPalette', 'palette has no colors' FROM kinds WHERE k = 2
        UNION ALL SELECT palette_id, 'InvalidPalette', coalesce('bad hex for color ' || bad.code, 'duplicate code ' || twice.code) FROM bad FULL JOIN twice USING (palette_id)""",
    "palette_lenient": f"""WITH {_BROKEN}, wide AS (SELECT palette_id, idx, code, CASE WHEN k = 3 AND length(rgb) = 7 THEN '#' || rgb[2] || rgb[2] || rgb[4] || rgb[4] || rgb[6] || rgb[6] ELSE rgb END AS rgb FROM kinds WHERE k IN (1, 3, 4))
        SELECT palette_id, idx, code, """ + ", ".join(f"CASE WHEN length(rgb) = 7 THEN CAST('0x' || substr(rgb, {k}, 2) AS INTEGER) END AS {c}" for c, k in zip("rgb", (2, 4, 6))) + " FROM wide",
    "mixed_triangle": _mixed_triangle_sql(),
    "mixed_nearest": f"WITH {_CHOSEN} SELECT * FROM chosen",
    "mixed_patterns": f"WITH {_CHOSEN}, {_PALETTE}, " + _RGB.replace("FROM pixels", "FROM chosen") + f", matched AS (SELECT image_id, x, y, idx FROM chosen JOIN rgb USING (r, g, b)), {_STATS.format(t='matched')} SELECT * FROM stats",
    "image_fault_rows": _fault_sql(),
}


def queries() -> dict[str, Query]:
    own = (
        match_rgb_stats, match_rgb_cells, match_lab_cells, match_oklab_cells, total_and_missing, color_count, legend_top5, highlight_cells, cell_detail, summary_text, pattern_json,
        center_crop_pixels, nearest_resize, triangle_resize, reduce_rgb, component_sizes_events, despeckle_s1, despeckle_s3, despeckle_s100, despeckle_any, identity_resize, reduce_not_needed, pattern_json_joined, palette_broken, palette_lenient, cover_scales, mixed_triangle, mixed_nearest, mixed_patterns, image_fault_rows, preview_pixels, grid_pixels, superpixel_cells,
        palette_colors, palette_validate, palette_counts, palette_lookup, crop_rects, locked_pairs, hit_tests, layout_ticks,
        catmull_resize, gaussian_resize, lanczos_resize, turned_pixels, preview_missing, board_sizes, saved_cells, cell_centres, viewport_taps, preset_sizes, frame_ratios, u32_reads, stored_settings,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
