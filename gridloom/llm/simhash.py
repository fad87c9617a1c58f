"""SimHash near-duplicates with a Gray-order hierarchical index.

1. Every text gets a 64-bit SimHash of its word shingles (:func:`fingerprints`).
   Documents with equal fingerprints are one *class*; only distinct fingerprints go on.
2. The uppermost nodes of the index are masked bit patterns. The fingerprint is cut into
   blocks; two fingerprints within ``distance`` bits agree on at least
   ``blocks - distance`` of them, so each choice of that many blocks is a mask and each
   (mask, pattern) a node: any linked pair meets in one. Nodes with more than
   ``node_rows`` members get children: their free bits are cut again, ``distance + 1``
   blocks of which one must agree, until every node is small. A node that has used up
   its free bits cannot be large, as fingerprints are distinct.
3. The members of all nodes are range-partitioned and sorted by mask, by the Gray rank of
   their node and by their own. Each stretch of a sorted range becomes a :class:`GrayIndex`:
   consecutive members form groups, groups form upper nodes, and each keeps the bits that
   all below it share (mask and pattern). Searched against itself from the top down, two
   groups are pruned as a whole where a shared bit of the node's mask differs, or where
   the differing shared bits add up to more than ``distance``; only members of groups that
   are left are compared. All links come from this index.
4. A stretch emits a spanning forest of its links, not all pairs: connectivity is kept and
   copies never expand. Large-star and small-star rounds on the links give the components.

Null or empty texts, and texts without words, have fingerprint zero. doc_id may be
null or repeated. A null doc_id links like any other but never names a component that
holds a numbered document. Long texts are hashed whole, their bits counted in slices; a
bit that exactly half of the hashes have is 0. Other columns are ignored, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pinned

#: Members that a node may have before it gets children.
NODE_ROWS = 4096
#: Members of a lowest group of a node.
GROUP = 32
#: Pairs of groups that are compared at once.
PAIRED = 256
BITS = 64


def _simhash(words: list[bytes], shingle: int) -> int:
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_digest
    joined = [words[k : len(words) - shingle + 1 + k] for k in range(shingle)]
    return majority(b"".join([digest(b" ".join(x), 42) for x in zip(*joined)]))


def majority(raw: bytes) -> int:
    """The bits set in over half of the big-endian 64-bit numbers of raw; 0 if there are none."""
    n = len(raw) // 8
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(raw), 8 << 16):
        part = np.frombuffer(raw, dtype=np.uint8, count=min(8 << 16, len(raw) - lo), offset=lo).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of every row.

    Words are runs outside ASCII white space after lower-casing A-Z; shingles are
    hashed by XXH64 with seed 42, repeats counted; a bit is 1 if set in over half of
    the hashes. Texts of fewer words than a shingle hash as one sequence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([_simhash(t.encode().lower().split(), shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps.view(np.int64)})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _blocks(free: list[int], count: int) -> list[int]:
    """The free bit positions cut into count masks."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free, dtype=object), count) if len(part)]


def _root_masks(distance: int) -> list[int]:
    """Masks of which two codes within distance agree on one: all choices of two blocks."""
    cut = _blocks(list(range(BITS)), distance + 2)
    return [a | b for a, b in combinations(cut, 2)]


def _child_masks(mask: int, distance: int) -> list[int]:
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | m for m in _blocks(free, distance + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class GrayIndex:
    """Codes in Gray order of their masked bits, with group patterns over one another.

    Level 0 groups hold ``GROUP`` members; each upper node joins four groups and keeps
    the bits shared by all below it. Members that link must agree on the bits of mask.
    """

    def __init__(self, codes: np.ndarray, mask: int = 0):
        mask = np.uint64(mask)
        self.mask = mask
        self.codes = codes[np.lexsort((gray_rank(codes), gray_rank(codes & mask)))]
        starts = np.arange(0, len(codes), GROUP)
        high, low = np.bitwise_or.reduceat(self.codes, starts), np.bitwise_and.reduceat(self.codes, starts)
        self.levels = [(high, low)]
        while len(high) > 1:
            at = np.arange(0, len(high), 4)
            high, low = np.bitwise_or.reduceat(high, at), np.bitwise_and.reduceat(low, at)
            self.levels.append((high, low))

    def near_groups(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i <= j) of lowest groups that the shared bits of no level rule out."""
        a = b = np.zeros(1, dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[level]
            if level < len(self.levels) - 1:
                step = np.arange(4)
                a = np.repeat(a, 16) * 4 + np.tile(np.repeat(step, 4), len(a))
                b = np.repeat(b, 16) * 4 + np.tile(np.tile(step, 4), len(b))
                ok = (a <= b) & (b < len(high))
                a, b = a[ok], b[ok]
            # a bit differs between all members if all of one side have it and none of the other
            apart = (low[a] & ~high[b]) | (low[b] & ~high[a])
            ok = (np.bitwise_count(apart) <= distance) & (apart & self.mask == 0)
            a, b = a[ok], b[ok]
        return a, b

    def linked(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (x < y) of linked members, a few groups at a time."""
        n = len(self.codes)
        cells = np.append(self.codes, np.zeros(-n % GROUP, dtype=np.uint64)).reshape(-1, GROUP)
        a, b = self.near_groups(distance)
        for lo in range(0, len(a), PAIRED):
            one, two = a[lo : lo + PAIRED], b[lo : lo + PAIRED]
            k, i, j = np.nonzero(np.bitwise_count(cells[one][:, :, None] ^ cells[two][:, None, :]) <= distance)
            x, y = one[k] * GROUP + i, two[k] * GROUP + j
            ok = (x < y) & (y < n)
            yield x[ok], y[ok]

    def forest(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links within distance, as pairs (code, another of its component)."""
        label = np.arange(len(self.codes))
        for x, y in self.linked(distance):
            while len(x):
                one, two = label[x], label[y]
                ok = one != two
                x, y, one, two = x[ok], y[ok], one[ok], two[ok]
                np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
                while True:
                    up = label[label]
                    if np.array_equal(up, label):
                        break
                    label = up
        at = np.flatnonzero(label != np.arange(len(label)))
        signed = self.codes.view(np.int64)
        return signed[at], signed[label[at]]


def _links_of_ranges(distance: int):
    """Batches of (mask, node, fp), sorted, to links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def solved(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            mask, codes = part["mask"].to_numpy(), part["fp"].to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(mask[1:] != mask[:-1]) + 1).tolist(), len(mask)]
            for lo, hi in zip(cuts, cuts[1:]):
                a, b = GrayIndex(codes[lo:hi], int(mask[lo]) & (2**64 - 1)).forest(distance)
                yield pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            if not len(batch):
                continue
            last = batch["node"].iloc[-1], batch["mask"].iloc[-1]
            cut = len(batch) - int(((batch["node"] == last[0]) & (batch["mask"] == last[1])).sum())
            if cut:  # all but the last node are whole
                yield from solved(pd.concat([*held, batch.iloc[:cut]]))
                held = []
            elif held and (held[-1]["node"].iloc[-1], held[-1]["mask"].iloc[-1]) != last:
                yield from solved(pd.concat(held))
                held = []
            held.append(batch.iloc[cut:])
        if held:
            yield from solved(pd.concat(held))

    return run


def _children(distance: int):
    """Batches of (mask, fp) to those of the masks below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mask, own in batch.groupby("mask"):
                for child in _child_masks(int(mask) & (2**64 - 1), distance):
                    yield pd.DataFrame({"mask": np.full(len(own), _signed(child)), "fp": own["fp"].to_numpy()})

    return run


def links(codes: DataFrame, distance: int = 4, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fp of codes that lie within distance bits of one another."""
    most = max(node_rows, 2 << distance)  # a larger node has more free bits than distance, so its children miss no pair
    rank = "aggregate(array(1, 2, 4, 8, 16, 32), {x}, (a, s) -> a ^ shiftrightunsigned(a, s)) ^ shiftleft(1L, 63)"
    mask_array = F.array(*(F.lit(_signed(m)) for m in _root_masks(distance)))
    members = codes.select("fp", F.explode(mask_array).alias("mask"))
    found: list[DataFrame] = []
    while True:
        keyed = members.select("mask", F.expr(rank.format(x="fp & mask")).alias("node"), "fp")
        large = pinned(keyed.groupBy("mask", "node").count().where(F.col("count") > most).select("mask", "node"), "nodes")
        many = large.count()
        side = F.broadcast(large) if many < 10_000 else large
        small = keyed.join(side, ["mask", "node"], "left_anti") if many else keyed
        ranges = small.withColumn("rank", F.expr(rank.format(x="fp"))).repartitionByRange("mask", "node").sortWithinPartitions("mask", "node", "rank")
        found.append(ranges.select("mask", "node", "fp").mapInPandas(_links_of_ranges(distance), "a long, b long"))
        if not many:
            break
        members = pinned(keyed.join(side, ["mask", "node"], "left_semi").select("mask", "fp").mapInPandas(_children(distance), "mask long, fp long").distinct(), "members")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """(a, name): the least vertex reachable from each vertex of the undirected edges (a, b), by large-star and small-star."""
    edges = pinned(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = pinned(small, "edges")
        # a round only moves edges to smaller vertices, so equal sums mean that none has moved
        now = edges.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select("a", F.col("b").alias(name))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of every row."""
    rows = pinned(fingerprints(docs, shingle), "fingerprints")
    classes = pinned(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    parts = components(links(classes.select("fp"), distance, node_rows), "root")
    rooted = classes.join(parts, classes.fp == parts.a, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    per_code = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(per_code, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
