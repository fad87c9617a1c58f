"""Small same-colour regions take the colour that most of their border touches.

The grid is cut into square tiles, one shuffle. Each tile joins its cells to pieces of
regions, counts them and the border edges to other colours, and settles the pieces that
touch no other tile at once. What is left are pieces along the tiles' seams: only the cells
on a seam and the totals of such pieces are shuffled, pieces of a colour that meet across a
seam are contracted to regions, and the verdicts go back to their tiles. The number of
rounds follows the logarithm of the longest chain of pieces; it does not depend on the
threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.scratch import stored

#: Cells along a side of a tile.
TILE = 64
#: A label is a cell's place in one number, rows first.
ROW_UNIT = 1 << 32

_PIECE = "array<struct<label:bigint,idx:int,n:bigint,votes:array<struct<idx:int,n:bigint>>>>"
_SEAM = "array<struct<x:int,y:int,idx:int,label:bigint>>"


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the set of each of size members, joined by the pairs (a, b)."""
    root = np.arange(size)
    while len(a):
        one, two = root[a], root[b]
        apart = one != two
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


class _Tile:
    """Cells of one tile on a dense grid with their pieces."""

    def __init__(self, x: np.ndarray, y: np.ndarray, idx: np.ndarray, tile: int):
        self.tile, self.x0, self.y0 = tile, int(x[0]) // tile * tile, int(y[0]) // tile * tile
        self.place = (y - self.y0) * tile + (x - self.x0)
        here, self.idx = np.zeros(tile * tile, dtype=bool), np.zeros(tile * tile, dtype=np.int64)
        here[self.place], self.idx[self.place] = True, idx
        every = np.arange(tile * tile)
        right, down = every[every % tile < tile - 1], every[: tile * (tile - 1)]
        a, b = np.concatenate([right, down]), np.concatenate([right + 1, down + tile])
        both = here[a] & here[b]
        a, b = a[both], b[both]
        same = self.idx[a] == self.idx[b]
        self.root = _roots(tile * tile, a[same], b[same])
        self.n = np.bincount(self.root[here], minlength=tile * tile)
        a, b = np.concatenate([a[~same], b[~same]]), np.concatenate([b[~same], a[~same]])
        pairs, self.votes = np.unique(np.column_stack([self.root[a], self.idx[b]]), axis=0, return_counts=True)
        self.voter, self.voted = pairs[:, 0], pairs[:, 1]
        edge = here & ((every % tile == 0) | (every % tile == tile - 1) | (every < tile) | (every >= tile * (tile - 1)))
        self.edge = np.flatnonzero(edge)
        self.open = np.zeros(tile * tile, dtype=bool)
        self.open[self.root[self.edge]] = True
        self.pieces = np.flatnonzero(self.n)

    def label(self, place: np.ndarray) -> np.ndarray:
        return (self.y0 + place // self.tile) * ROW_UNIT + self.x0 + place % self.tile

    def settled(self, most: int) -> np.ndarray:
        """Colours of all places once the pieces of at most most cells that touch no other tile have their border's."""
        own = np.flatnonzero((self.n[self.voter] <= most) & ~self.open[self.voter])
        own = own[np.lexsort((self.voted[own], -self.votes[own], self.voter[own]))]
        first = own[np.append(True, self.voter[own][1:] != self.voter[own][:-1])] if len(own) else own
        won, new = np.zeros(len(self.root), dtype=bool), np.zeros(len(self.root), dtype=np.int64)
        won[self.voter[first]], new[self.voter[first]] = True, self.voted[first]
        return np.where(won[self.root], new[self.root], self.idx)

    def totals(self, chosen: np.ndarray, most: int) -> list[dict]:
        """Label, colour and size of pieces, and the votes of those of at most most cells."""
        votes: dict[int, list[dict]] = {}
        for piece, colour, n in zip(self.voter.tolist(), self.voted.tolist(), self.votes.tolist()):
            if self.n[piece] <= most:
                votes.setdefault(piece, []).append({"idx": colour, "n": n})
        labels = self.label(chosen).tolist()
        return [{"label": label, "idx": int(self.idx[p]), "n": int(self.n[p]), "votes": votes.get(p, [])} for label, p in zip(labels, chosen.tolist())]

    def seam(self) -> list[dict]:
        x, y = (self.x0 + self.edge % self.tile).tolist(), (self.y0 + self.edge // self.tile).tolist()
        return [{"x": a, "y": b, "idx": c, "label": d} for a, b, c, d in zip(x, y, self.idx[self.edge].tolist(), self.label(self.root[self.edge]).tolist())]


def _tiled(cells: DataFrame, most: int, tile: int, whole: bool = False) -> DataFrame:
    """One row per tile: its cells (x, y, idx with settled pieces recoloured, label of pieces that wait, else -1), pieces along its seams (all if whole) and cells on them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = _Tile(rows["x"].to_numpy(np.int64), rows["y"].to_numpy(np.int64), rows["idx"].to_numpy(np.int64), tile)
        root = t.root[t.place]
        waits = t.open[root] & (t.n[root] <= most)
        row = {"image_id": key[0], "tx": key[1], "ty": key[2], "x": rows["x"].tolist(), "y": rows["y"].tolist(), "idx": t.settled(most)[t.place].tolist()}
        row |= {"label": np.where(waits, t.label(root), -1).tolist(), "pieces": t.totals(t.pieces if whole else t.pieces[t.open[t.pieces]], most), "seam": t.seam()}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    kind = cells.schema["image_id"].dataType.simpleString()
    tiles = [F.floor(F.col(c) / tile).cast("int").alias(f"t{c}") for c in "xy"]
    dealt = cells.select("image_id", *tiles, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("idx").cast("int").alias("idx"))
    return dealt.groupBy("image_id", "tx", "ty").applyInPandas(run, f"image_id {kind}, tx int, ty int, x array<int>, y array<int>, idx array<int>, label array<bigint>, pieces {_PIECE}, seam {_SEAM}")


def _met(tiles: DataFrame, tile: int) -> DataFrame:
    """Neighbouring cells on either side of a seam: labels a, b of their pieces and colours a_idx, b_idx."""
    seam = tiles.select("image_id", F.inline("seam"))
    out = []
    for axis in "xy":
        before = seam.where(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).withColumn(axis, F.col(axis) + 1).withColumnsRenamed({"label": "a", "idx": "a_idx"})
        behind = seam.where(F.pmod(F.col(axis), F.lit(tile)) == 0).withColumnsRenamed({"label": "b", "idx": "b_idx"})
        out.append(before.join(behind, ["image_id", "x", "y"]).select("image_id", "a", "b", "a_idx", "b_idx"))
    return stored(out[0].unionByName(out[1]), "seams")


def _contracted(edges: DataFrame) -> DataFrame:
    """image_id, label and root (the least label reachable) of the labels in edges (image_id, a, b), by large and small stars."""
    edges, before = stored(edges.select("image_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        both = edges.unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("image_id", "a").agg(F.min("b").alias("m")).select("image_id", "a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, ["image_id", "a"]).select("image_id", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("image_id", "a").agg(F.min("b").alias("m"))
        small = large.join(down, ["image_id", "a"]).select("image_id", F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = stored(small, "edges")
        # a round only moves edges to smaller places, so equal sums mean that none has moved
        now = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("image_id", F.col("a").alias("label"), F.col("b").alias("root"))
        before = now


def _rooted(tiles: DataFrame, met: DataFrame) -> DataFrame:
    """Pieces (image_id, label, idx, n, votes) with the root of their region."""
    roots = _contracted(met.where("a_idx = b_idx").select("image_id", "a", "b"))
    pieces = tiles.select("image_id", F.inline("pieces"))
    return pieces.join(roots, ["image_id", "label"], "left").withColumn("root", F.coalesce("root", "label"))


def component_sizes(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """image_id, idx, the region's least place (x, y) and its number of cells."""
    tiles = stored(_tiled(cells, 0, tile, whole=True).select("image_id", "pieces", "seam"), "tiles")
    counted = _rooted(tiles, _met(tiles, tile)).groupBy("image_id", "idx", "root").agg(F.sum("n").alias("n"))
    return counted.select("image_id", "idx", _place("root", "x"), _place("root", "y"), "n")


def _place(label: str, axis: str) -> Column:
    at = F.col(label) % ROW_UNIT if axis == "x" else F.floor(F.col(label) / ROW_UNIT)
    return at.cast("int").alias(axis)


def _recoloured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for image_id, x, y, idx, label, won in zip(*(batch[c] for c in ("image_id", "x", "y", "idx", "label", "won"))):
            idx = np.array(idx)
            if won is not None and len(won):
                names, news = (np.array([w[k] for w in won]) for k in ("label", "new"))
                order = np.argsort(names)
                at = np.minimum(np.searchsorted(names[order], np.array(label)), len(names) - 1)
                hit = names[order][at] == label
                idx = np.where(hit, news[order][at], idx)
            yield pd.DataFrame({"image_id": image_id, "x": x, "y": y, "idx": idx})


def despeckle(cells: DataFrame, min_region: int, sizes: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Cells in which regions of at most ``min_region`` cells have the majority colour of their border (of equals the lowest index).

    Regions and votes are those of the input, whatever its neighbours become. A region
    without a border to another colour stays. With sizes (image_id, width, height), images
    whose cells do not fill their rectangle are given back as they are.
    """
    if min_region <= 0:
        return cells
    tiles = stored(_tiled(cells, min_region, tile), "tiles")
    met = _met(tiles, tile)
    pieces = stored(_rooted(tiles, met), "pieces")
    small = pieces.groupBy("image_id", "root").agg(F.sum("n").alias("n")).where(F.col("n") <= min_region).select("image_id", "root")
    waiting = pieces.join(small, ["image_id", "root"]).select("image_id", "label", "root", "votes")
    inside = waiting.select("image_id", "root", F.inline("votes"))
    across = met.where("a_idx <> b_idx").select("image_id", F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("b_idx").alias("idx")), F.struct(F.col("b").alias("label"), F.col("a_idx").alias("idx")))).alias("v")).select("image_id", "v.*")
    outside = across.groupBy("image_id", "label", "idx").agg(F.count("*").alias("n")).join(waiting, ["image_id", "label"]).select("image_id", "root", "idx", "n")
    votes = inside.unionByName(outside).groupBy("image_id", "root", "idx").agg(F.sum("n").alias("n"))
    best = votes.groupBy("image_id", "root").agg((-F.max(F.struct("n", (-F.col("idx")).alias("k")))["k"]).alias("new"))
    won = waiting.join(best, ["image_id", "root"]).select("image_id", *((F.floor(_place("label", c) / tile)).cast("int").alias(f"t{c}") for c in "xy"), F.struct("label", "new").alias("won"))
    per_tile = won.groupBy("image_id", "tx", "ty").agg(F.collect_list("won").alias("won"))  # at most a tile's cells
    kind = cells.schema["image_id"].dataType.simpleString()
    out = tiles.join(per_tile, ["image_id", "tx", "ty"], "left").select("image_id", "x", "y", "idx", "label", "won").mapInPandas(_recoloured, f"image_id {kind}, x int, y int, idx int")
    if sizes is None:
        return out
    full = tiles.groupBy("image_id").agg(F.sum(F.size("x")).alias("n"), F.sum(F.size(F.array_distinct(F.arrays_zip("x", "y")))).alias("places"), F.min(F.least(F.array_min("x"), F.array_min("y"))).alias("low"), F.max(F.array_max("x")).alias("right"), F.max(F.array_max("y")).alias("below"))
    area = F.col("width").cast("long") * F.col("height")
    sound = full.join(sizes, "image_id").where((F.col("n") == area) & (F.col("places") == area) & (F.col("low") >= 0) & (F.col("right") < F.col("width")) & (F.col("below") < F.col("height"))).select("image_id")
    return out.join(sound, "image_id", "left_semi").unionByName(cells.join(sound, "image_id", "left_anti").select("image_id", *(F.col(c).cast("int").alias(c) for c in ("x", "y", "idx"))))
