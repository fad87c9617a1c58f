"""SimHash near copies, each link checked by the Jaccard similarity of word shingles.

The 64-bit SimHash of :mod:`.simhash` over ``shingle`` words tells how alike two texts are,
but two texts of Jaccard similarity 0.8 differ in about ten of its bits, more than any
index over all texts can reach. So candidates come in two ways, and all are checked.

1. Every text is the set of its word shingles (64-bit hashes) and a SimHash. Rows with
   equal sets, told by a 64-bit hash, are one *class*; one of each goes on.
2. Gray index: classes whose SimHashes lie within ``distance`` bits, as connected by
   :func:`.simhash.links`.
3. Prefix groups: in any one order of all shingles, two sets of similarity ``t`` share one
   of the first ``n - ceil(t n) + 1`` shingles of each, so they meet in its group. The order
   puts shingles that are frequent in a sample last, so hardly any unlike texts meet. Sizes
   and the places of the shared shingle rule out pairs that cannot be that similar, and no
   others. Of those left a group first gives out
   ``FORESTS`` edge-disjoint spanning forests of least distances and each member's ``HUBS``
   neighbours that lie nearest to all others (copies of one original lie nearer to it than
   to one another): all pairs of a small group, a few per member of a large one.
   Groups of very frequent shingles are cut into blocks, and each pair of blocks is a group.
4. Every candidate is checked on its whole sets, once the parities of their shingles' last
   bits leave it possible. Large-star and small-star rounds on the
   links give components.
5. Members that a group has held pairs of back meet in it again, now with their components
   and parities. Pairs within one component are settled. Of the others a group tells only
   which members have a pair that parities leave possible, each with one name for all that
   such pairs connect: a row a member at most, however many pairs there are. Joined over all
   groups, these names are *clusters*. The sets of a cluster's members meet once, all their
   pairs of unlike components are compared, and a spanning forest of the links joins the
   components. So every pair of the similarity is linked or lies within one component,
   whatever its SimHashes; only the order of the work depends on them. Large clusters are cut
   into blocks, and each pair of blocks is compared.

Null texts and texts without words have the empty set and are copies of one another.
doc_id may be null or repeated: rows are told apart by a number of the scan. Other columns
are kept as they are, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ROW, numbered, pinned, settled, without_rows
from gridloom.llm.simhash import components, links, majority

#: Texts in the sample that frequent shingles are taken from, and most of these.
SAMPLE, FREQUENT = 5_000, 50_000
#: Bits from which on a neighbour does not count as near when central members are chosen.
FAR = 24
#: Spanning forests of a prefix group, and its most central members that each member is paired with at first.
FORESTS, HUBS = 2, 2
#: Members of a block of a group that is expected to be larger.
BLOCK = 5_000
#: Pairs that a task looks at together.
CHUNK = 400_000
#: Members of a block of a cluster, and their shingles in all.
CLUSTER, CLUSTER_SHINGLES = 2_000, 2_000_000


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct shingles of a text, sorted. Words are as for fingerprints; texts of fewer words than a shingle are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = [words[k : max(1, len(words) - size + 1) + k] for k in range(size)] if len(words) > size else [[b" ".join(words)]]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(b" ".join(x), 42) for x in zip(*joined)]), dtype=">u8").astype(np.uint64))


def _key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def least_common(size: int, similarity: float) -> int:
    """Shingles that a set of this size has in common at least with one of the similarity."""
    return math.ceil(similarity * size - 1e-9)


def _prefix(own: np.ndarray, often: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set: rare ones by hash, then frequent ones by their rank."""
    n = len(own) - least_common(len(own), similarity) + 1
    if not len(often):
        return own[:n]
    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
    known = often[at] == own
    rare = own[~known][:n]
    if len(rare) == n:
        return rare
    rest = np.flatnonzero(known)
    return np.concatenate([rare, own[rest[np.argsort(rank[at[rest]])][: n - len(rare)]]])


class _Forests:
    """Edge-disjoint spanning forests of pairs, near ones first."""

    def __init__(self, size: int, count: int):
        self.parents = [np.arange(size) for _ in range(count)]

    def add(self, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[list[int], list[int]]:
        """The pairs that join two trees of a forest, in order of far; a pair goes to the first forest that it joins."""
        order = np.argsort(far, kind="stable")
        x, y = x[order], y[order]
        ones: list[int] = []
        others: list[int] = []
        for parent in self.parents:
            rest = []
            for lo in range(0, len(x), 8192):
                while not np.array_equal(up := parent[parent], parent):
                    parent[:] = up
                one, two = x[lo : lo + 8192], y[lo : lo + 8192]
                left = parent[one] == parent[two]
                for k in np.flatnonzero(~left).tolist():
                    p, q = int(one[k]), int(two[k])
                    while parent[p] != p:
                        p = int(parent[p])
                    while parent[q] != q:
                        q = int(parent[q])
                    if p == q:
                        left[k] = True
                        continue
                    parent[max(p, q)] = min(p, q)
                    ones.append(int(one[k]))
                    others.append(int(two[k]))
                rest.append(lo + np.flatnonzero(left))
            if not rest:
                break
            kept = np.concatenate(rest)
            x, y = x[kept], y[kept]
        return ones, others


def _met(t: np.ndarray, side: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i < j) of all members, sorted by token and size, that meet in a group and may have the similarity."""
    i, d = np.arange(len(t)), 0
    while len(i):
        d += 1
        i = i[i + d < len(t)]
        j = i + d
        # sizes rise within a token, so what is too large now stays so
        ok = (t[i] == t[j]) & (size[i] >= similarity * size[j] - 1e-9)
        i, j = i[ok], j[ok]
        need = np.ceil(similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6)
        ok = (np.minimum(size[i] - place[i], size[j] - place[j]) >= need) & ((side[i] != side[j]) | (side[i] == 2))
        if ok.any():
            yield i[ok], j[ok]


def _by_group(work):
    """work on batches sorted by token, as frames of whole groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["token"].iloc[-1]
            if held and last == held[0]["token"].iloc[-1]:
                held.append(batch)
                continue
            cut = int(batch["token"].searchsorted(last))
            done = pd.concat([*held, batch.iloc[:cut]])
            if len(done):
                yield from work(done)
            held = [batch.iloc[cut:]]
        if held:
            yield from work(pd.concat(held))

    return run


def _pairs(similarity: float):
    """Batches of (token, side, size, place, key, fp), sorted by token, size and key, to candidates (a, b) of side -1, and to the members (token, side, size, place, a) that a pair was held back of."""

    def pairs(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        t, side, size, place, key = (part[c].to_numpy() for c in ("token", "side", "size", "place", "key"))
        fp = part["fp"].to_numpy().view(np.uint64)
        # equal sets have equal prefixes and stand side by side: one of them goes on
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (size[1:] != size[:-1]) | (key[1:] != key[:-1])])
        t, side, size, place, key, fp = t[new], side[new], size[new], place[new], key[new], fp[new]
        forests, closeness = _Forests(len(t), FORESTS), np.zeros(len(t))
        back = np.zeros(len(t), dtype=bool)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def given() -> pd.DataFrame:
            x, y, far = (np.concatenate(c) for c in zip(*held))
            ones, others = forests.add(x, y, far)
            v, u, far = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([far, far])
            closeness[:] += np.bincount(v, weights=np.maximum(FAR + 1.0 - far, 0), minlength=len(t))
            order = np.lexsort((far, -closeness[u], v))
            v, u = v[order], u[order]
            first = np.searchsorted(v, v)
            hubs = np.arange(len(v)) - first < HUBS
            v, u = np.concatenate([v[hubs], np.array(ones, dtype=np.int64)]), np.concatenate([u[hubs], np.array(others, dtype=np.int64)])
            kept = np.isin(x * len(t) + y, np.minimum(v, u) * len(t) + np.maximum(v, u))
            back[x[~kept]] = back[y[~kept]] = True
            a, b = np.minimum(key[v], key[u]), np.maximum(key[v], key[u])
            return pd.DataFrame({"token": 0, "side": -1, "size": 0, "place": 0, "a": a, "b": b}).drop_duplicates()

        for i, j in _met(t, side, size, place, similarity):
            held.append((i, j, np.bitwise_count(fp[i] ^ fp[j])))
            if sum(len(x[0]) for x in held[-1000:]) > CHUNK or len(held) > 1000:
                yield given()
                held.clear()
        if held:
            yield given()
        if back.any():
            yield pd.DataFrame({"token": t[back], "side": side[back], "size": size[back], "place": place[back], "a": key[back], "b": key[back]})

    return _by_group(pairs)


def _parities(own: np.ndarray) -> bytes:
    """Bit k: whether an odd number of shingles ends on k. Two to four times as many bits as shingles, a power of two."""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def _apart(one: bytes, two: bytes) -> int:
    """Shingles that at least are in one set only, by the parities of both."""
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _most_apart(total: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that at most are in one set only, of two sets of the similarity with so many in all."""
    return total - 2 * np.ceil(similarity / (1 + similarity) * total - 1e-6)


class _Sketches:
    """Parities of many sets, compared for many pairs at once."""

    def __init__(self, bits: list[bytes]):
        self.words = np.array([len(x) // 8 for x in bits])
        self.row = np.zeros(len(bits), dtype=np.int64)
        self.tables: dict[tuple[int, int], np.ndarray] = {}
        for n in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == n)
            self.row[at] = np.arange(len(at))
            self.tables[n, n] = np.frombuffer(b"".join([bits[k] for k in at.tolist()]), np.uint64).reshape(-1, n)

    def _folded(self, n: int, to: int) -> np.ndarray:
        if (n, to) not in self.tables:
            x = self._folded(n, 2 * to)
            self.tables[n, to] = x[:, :to] ^ x[:, to:]
        return self.tables[n, to]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As _apart, of the sets i[k] and j[k]."""
        out = np.zeros(len(i), dtype=np.int64)
        one, two = self.words[i], self.words[j]
        for n in np.unique(one).tolist():
            for m in np.unique(two[one == n]).tolist():
                to = min(n, m)
                x, y = self._folded(n, to), self._folded(m, to)
                at, step = np.flatnonzero((one == n) & (two == m)), max(1, 4 * CHUNK // to)
                for k in (at[lo : lo + step] for lo in range(0, len(at), step)):
                    out[k] = np.bitwise_count(x[self.row[i[k]]] ^ y[self.row[j[k]]]).sum(axis=1, dtype=np.int64)
        return out


def _chunks(met: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, about CHUNK at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for i, j in met:
        held.append((i, j))
        count += len(i)
        if count > CHUNK or len(held) > 1000:
            yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held, count = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])


def _united(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label, the least node that is known of each one's tree, once x and y are joined pair by pair."""
    while len(x):
        one, two = label[x], label[y]
        ok = one != two
        x, y, one, two = x[ok], y[ok], one[ok], two[ok]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _likely(similarity: float):
    """Batches of (token, side, size, place, key, root, bits), sorted by token, size and key, to members (key, size, root, head) of a pair of unlike roots that parities leave possible. Such pairs connect members of one head, which is a root."""

    def members(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        t, side, size, place, key, root = (part[c].to_numpy() for c in ("token", "side", "size", "place", "key", "root"))
        sketches = _Sketches(part["bits"].tolist())
        roots, node = np.unique(root, return_inverse=True)
        label, open_ = np.arange(len(roots)), np.zeros(len(t), dtype=bool)
        for i, j in _chunks(_met(t, side, size, place, similarity)):
            # what would tell nothing new is not compared
            ok = (root[i] != root[j]) & ~(open_[i] & open_[j] & (label[node[i]] == label[node[j]]))
            i, j = i[ok], j[ok]
            ok = sketches.apart(i, j) <= _most_apart(size[i] + size[j], similarity)
            i, j = i[ok], j[ok]
            open_[i] = open_[j] = True
            label = _united(label, node[i], node[j])
        if open_.any():
            yield pd.DataFrame({"key": key[open_], "size": size[open_], "root": root[open_], "head": roots[label[node[open_]]]}).drop_duplicates()

    return _by_group(members)


def _joined(similarity: float):
    """Batches of (token, side, size, key, root, bits, own), sorted by token, size and key, to links (a, b), a spanning forest of all those between unlike roots of a token."""

    def forest(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        t, side, size, key, root = (part[c].to_numpy() for c in ("token", "side", "size", "key", "root"))
        sketches, own = _Sketches(part["bits"].tolist()), [np.frombuffer(x, np.uint64) for x in part["own"]]
        roots, node = np.unique(root, return_inverse=True)
        label = np.arange(len(roots))
        ones: list[int] = []
        others: list[int] = []
        for i, j in _chunks(_met(t, side, size, np.zeros_like(size), similarity)):
            ok = label[node[i]] != label[node[j]]
            i, j = i[ok], j[ok]
            apart = sketches.apart(i, j)
            at = np.flatnonzero(apart <= _most_apart(size[i] + size[j], similarity))
            at = at[np.argsort(apart[at], kind="stable")]
            for x, y in zip(i[at].tolist(), j[at].tolist()):
                if label[node[x]] != label[node[y]] and _similar(own[x], own[y], similarity):
                    label = _united(label, node[[x]], node[[y]])
                    ones.append(x)
                    others.append(y)
        a, b = key[ones], key[others]
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return _by_group(forest)


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity. Parities rule out most others, and no more, before whole sets are moved."""

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            most = _most_apart((batch["size_a"] + batch["size_b"]).to_numpy(), similarity)
            apart = np.array([_apart(one, two) for one, two in zip(batch["bits_a"], batch["bits_b"])])
            yield batch.loc[apart <= most, ["a", "b"]]

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [_similar(np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64), similarity) for one, two in zip(batch["own_a"], batch["own_b"])]
            yield batch.loc[np.array(ok, dtype=bool), ["a", "b"]]

    found = pairs.select("a", "b")
    for columns, run in ((("size", "bits"), likely), (("own",), alike)):
        for side in ("a", "b"):
            found = found.join(sets.select(F.col("key").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        found = found.mapInPandas(run, "a long, b long")
    return found


def _found(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the roots of members (key, size, root, head): all pairs of a cluster, which is what heads connect, are compared."""
    heads = components(members.select(F.col("root").alias("a"), F.col("head").alias("b")), "cluster").withColumnRenamed("a", "root")
    named = members.select("key", "size", "root").distinct().join(heads, "root", "left").select("key", "size", "root", F.coalesce("cluster", "root").alias("cluster"))
    cut = F.greatest(F.ceil(F.count("*") / CLUSTER), F.ceil(F.sum("size") / CLUSTER_SHINGLES)).alias("cut")
    own = named.join(named.groupBy("cluster").agg(cut), "cluster").withColumn("block", F.pmod("key", "cut"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side")
    dealt = dealt.select(F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("token"), side, "size", "key", "root")
    met = dealt.join(sets.select("key", "bits", "own"), "key").select("token", "side", "size", "key", "root", "bits", "own")
    return met.repartition("token").sortWithinPartitions("token", "size", "key").mapInPandas(_joined(similarity), "a long, b long")


def _frequent(rows: DataFrame, classes: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample, sorted; their ranks, frequent ones high; and the blocks that their groups are cut into."""
    n = classes.count()
    picked = classes.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0).select(F.col("own").alias(ROW))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"token": shingles(text, shingle).view(np.int64)})

    seen = rows.select(ROW, "text").join(F.broadcast(picked), ROW, "left_semi").mapInPandas(listed, "token long").groupBy("token").count()
    top = seen.where("count > 2").orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    often = np.array([x["token"] for x in top], dtype=np.int64).view(np.uint64)
    blocks = np.array([math.ceil(x["count"] * max(1, n // SAMPLE) / BLOCK) for x in top], dtype=np.int64)
    order = np.argsort(often)
    return often[order], len(often) - order, blocks[order]


def _dealt(token: np.ndarray, key: int, often: np.ndarray, blocks: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, side, place) of the prefix of one set: its shingles, or pairs of blocks where a group is cut; side 2 meets all, sides 0 and 1 each other."""
    at = np.minimum(np.searchsorted(often, token), max(len(often) - 1, 0)) if len(often) else None
    out = []
    for place, x in enumerate(token.tolist()):
        cut = int(blocks[at[place]]) if at is not None and int(often[at[place]]) == x else 1
        if cut < 2:
            out.append((x, 2, place))
            continue
        own = key % cut
        for other in range(cut):
            group = xxhash.xxh3_64_intdigest(b"%d:%d:%d" % (x, min(own, other), max(own, other)))
            out.append((group, 2 if own == other else int(own > other), place))
    return out


def grouped(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """__row and first (the __row of the least doc_id, nulls last, then least __row, of its component) of every row of numbered(docs)."""
    rows = numbered(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingles(t, shingle) for t in batch["text"]]
            fps = np.array([majority(x.astype(">u8").tobytes()) for x in own], dtype=np.uint64)
            yield pd.DataFrame({ROW: batch[ROW], "doc_id": batch["doc_id"], "key": np.array([_key(x) for x in own], dtype=np.int64), "fp": fps.view(np.int64)})

    keyed = pinned(rows.mapInPandas(keys, f"{ROW} long, doc_id {kind}, key long, fp long"), "keys")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("least")
    classes = pinned(keyed.groupBy("key").agg(F.min(ROW).alias("own"), F.min("fp").alias("fp"), least), "classes")

    codes = pinned(classes.groupBy("fp").agg(F.min("key").alias("head")), "codes")
    near = links(codes.select("fp"), distance)
    for c in ("a", "b"):
        near = near.join(codes.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")), c)
    same = classes.join(codes, "fp").select(F.col("key").alias("head_a"), F.col("head").alias("head_b"))
    close = near.select("head_a", "head_b").unionByName(same).where("head_a <> head_b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))

    shared = docs.sparkSession.sparkContext.broadcast(_frequent(rows, classes, shingle))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, rank, blocks = shared.value
        cut = bool(len(blocks)) and int(blocks.max()) > 1
        met: set[int] = set()
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                out = []
                for text in batch["text"].iloc[lo : lo + 1000]:
                    own = shingles(text, shingle)
                    key = _key(own)
                    if key in met:
                        continue  # a copy in this task
                    met.add(key)
                    first = _prefix(own, often, rank, similarity)
                    fp = majority(own.astype(">u8").tobytes())
                    if cut:
                        dealt = _dealt(first, key, often, blocks)
                        token, side, place = (np.array(c, dtype=k) for c, k in zip(zip(*dealt), (np.uint64, np.int64, np.int64))) if dealt else (first, np.empty(0, np.int64), np.empty(0, np.int64))
                    else:
                        token, side, place = first, np.full(len(first), 2), np.arange(len(first))
                    out.append((token, side, place, len(own), key, fp))
                if out:
                    n = [len(x[0]) for x in out]
                    spread = lambda k, kind: np.repeat(np.array([x[k] for x in out], dtype=kind), n)  # noqa: B023, E731
                    token, side, place = (np.concatenate([x[k] for x in out]) for k in range(3))
                    yield pd.DataFrame({"token": token.view(np.int64), "side": side, "size": spread(3, np.int64), "place": place, "key": spread(4, np.int64), "fp": spread(5, np.uint64).view(np.int64)})

    tokens = rows.select("text").mapInPandas(prefixes, "token long, side int, size int, place int, key long, fp long")
    dealt = tokens.repartition("token").sortWithinPartitions("token", "size", "key").mapInPandas(_pairs(similarity), "token long, side int, size int, place int, a long, b long")
    met = pinned(dealt, "met", release=True)
    pairs = pinned(met.where("side = -1").select("a", "b").unionByName(close).distinct(), "candidates")

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingles(t, shingle) for t in batch["text"]]
            yield pd.DataFrame({"key": np.array([_key(x) for x in own], dtype=np.int64), "size": [len(x) for x in own], "bits": [_parities(x) for x in own], "own": [x.tobytes() for x in own]})

    used = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes, "key").select(F.col("own").alias(ROW))
    sets = pinned(rows.select(ROW, "text").join(used, ROW, "left_semi").select("text").mapInPandas(stored, "key long, size int, bits binary, own binary"), "sets", release=True)
    parts = components(_checked(pairs, sets, similarity), "root")

    back = met.where("side > -1").select("token", "side", "size", "place", F.col("a").alias("key"))
    tied = back.join(parts.withColumnRenamed("a", "key"), "key", "left").select(*back.columns, F.coalesce("root", "key").alias("root"))
    tied = pinned(tied, "tied")
    split = tied.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    again = tied.join(split, "token", "left_semi").join(sets.select("key", "bits"), "key").repartition("token").sortWithinPartitions("token", "size", "key")
    again = again.select("token", "side", "size", "place", "key", "root", "bits").mapInPandas(_likely(similarity), "key long, size int, root long, head long")
    again = pinned(again.distinct(), "again", release=True)
    if not again.isEmpty():
        found = pinned(_found(again, sets, similarity), "found", release=True)
        parts = components(parts.withColumnRenamed("root", "b").unionByName(found), "root")
    rooted = classes.join(parts.withColumnRenamed("a", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least")[ROW].alias("first"))
    return keyed.select(ROW, "key").join(rooted.join(named, "root").select("key", "first"), "key").select(ROW, "first")


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one row, that of least doc_id, of each component of near copies."""
    docs = settled(docs)
    gone = grouped(docs, shingle, similarity).where(F.col("first") != F.col(ROW)).select(ROW)
    return without_rows(docs, gone)
