"""Repeated byte strings across documents, by a sparse distributed suffix array.

Removes each byte covered by a string of ``length`` bytes that also starts anywhere
else, in the same or another document.

1. Each window of ``length`` bytes picks anchors by its content (:mod:`.anchors`), so
   two equal windows have equally placed anchors. Only the suffixes at anchors are
   kept: about one in 70 bytes. A suffix row holds the hash of its leading gram, the
   hash of its whole context (all bytes that a window with this anchor can cover) and
   its place.
2. Suffixes whose gram occurs once are dropped. Grams that a sample over the whole table
   shows to be frequent are known to repeat, so they skip the count and are dealt by salt.
3. Equal suffixes (same gram and whole context, told by hashes) stand for one another: one
   of each class goes on, with their number.
4. The suffixes are range-partitioned by their leading bytes, the 64 of the gram, on sampled
   splitters, and each bucket is sorted. Equal windows have equal grams at their anchors, so
   they meet in one bucket. Runs of a bucket go through multikey quicksort to the right
   of the anchor and, reversed, to the left; the two LCP arrays tell which windows are
   equal. A class of several suffixes is covered as a whole.
5. A gram with more than ``bucket_rows`` classes is cut: windows that reach from ``lo`` to
   ``hi`` bytes before the anchor can be equal only if the ``lo`` bytes before it and the
   ``length - hi`` from it on are. Halving the reach gives longer and longer keys to deal the
   suffixes by, down to single windows, which are counted. So equal bytes are compared
   across the bounds of any bucket, and no task ever holds more than ``bucket_rows``.

Null text counts as empty. doc_id may be null or repeated; each row is judged as a
document of its own. Other columns of the input are ignored. Text is encoded as UTF-8;
an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.anchors import GRAM, anchors
from gridloom.llm.common import ROW, numbered, pinned

#: Bytes of documents whose anchors are sought at once, and of one slice of a longer document.
BLOCK = 1 << 20
#: Rows of the sample that finds frequent grams and splitters. It decides where rows go, not the result.
SAMPLE_ROWS = 4000
#: Sampled suffixes that splitters are taken from, at most, and buckets to a partition.
SPLITTER_ROWS, FINER = 20_000, 4
#: Frequent grams that are dealt out by salt, at most; the rest are dealt by gram.
HOT_GRAMS = 2000
#: Suffixes of one key that one task sorts, at most.
BUCKET_ROWS = 50_000
#: Suffixes that a task sorts at once, unless one key has more.
SORT_ROWS = 20_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _slices(data: bytes, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, core start, core end, bytes) of overlapping slices; anchors of the core see their whole surroundings."""
    margin = 2 * length
    for core in range(0, max(1, len(data)), BLOCK):
        end = min(len(data), core + BLOCK)
        start = max(0, core - margin)
        yield start, core, end, data[start : end + margin]


def _suffixes(length: int):
    """Batches of (row, text) to suffix rows.

    A (gram, context) that repeats within a document yields one row with its count n,
    and rows with n = 0 for the spans it covers there: start in pos, end in ctx.
    """
    reach = length - GRAM

    def rows_of(row: int, data: bytes, at: list[int], grams: list[int], out: list) -> None:
        seen: dict[tuple[int, int], list[int]] = {}
        for p, g in zip(at, grams):
            context = data[max(0, p - reach) : p + length]
            seen.setdefault((g, xxhash.xxh3_64_intdigest(context, len(data[max(0, p - reach) : p]))), []).append(p)
        for (g, c), places in seen.items():
            out.append((g, c, row, places[0], len(places)))
            if len(places) > 1:
                start, end = max(0, places[0] - reach), min(len(data), places[0] + length)
                for p in places[1:]:
                    if p - reach > end:
                        out.append((xxhash.xxh3_64_intdigest(b"%d:%d" % (row, start)), end, row, start, 0))
                        start = p - reach
                    end = min(len(data), p + length)
                out.append((xxhash.xxh3_64_intdigest(b"%d:%d" % (row, start)), end, row, start, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[tuple[int, bytes, int, int, int, bytes]] = []
        size = 0

        def flush() -> pd.DataFrame:
            out: list[tuple[int, int, int, int, int]] = []
            part, at, gram = anchors([x[5] for x in block], length)
            cuts = np.searchsorted(part, np.arange(len(block) + 1))
            found: list[int] = []
            hashes: list[int] = []
            for k, (row, data, start, core, end, _) in enumerate(block):
                own = at[cuts[k] : cuts[k + 1]] + start
                inside = (own >= core) & (own < end)
                found += own[inside].tolist()
                hashes += gram[cuts[k] : cuts[k + 1]][inside].tolist()
                if end == len(data):  # the document's last slice
                    held_at, held_grams = held.pop(row, ([], []))
                    rows_of(row, data, held_at + found, held_grams + hashes, out)
                else:
                    old = held.setdefault(row, ([], []))
                    old[0].extend(found)
                    old[1].extend(hashes)
                found, hashes = [], []
            a = np.array(out, dtype=object).reshape(-1, 5)
            return pd.DataFrame({"gram": _signed(a[:, 0]), "ctx": _signed(a[:, 1]), ROW: a[:, 2].astype(np.int64), "pos": a[:, 3].astype(np.int64), "n": a[:, 4].astype(np.int64)})

        held: dict[int, tuple[list[int], list[int]]] = {}
        for batch in batches:
            for row, text in zip(batch[ROW], batch["text"]):
                data = text.encode()
                if len(data) < length:
                    continue
                for start, core, end, piece in _slices(data, length):
                    block.append((row, data, start, core, end, piece))
                    size += len(piece)
                    if size >= BLOCK:
                        yield flush()
                        block.clear()
                        size = 0
        if block:
            yield flush()

    return run


def _leading(length: int):
    """Batches of (row, text) to the grams of their anchors, as hashes and as bytes, with the hashes of their contexts."""
    suffixes = _suffixes(length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = {row: text.encode() for row, text in zip(batch[ROW], batch["text"])}
            for found in suffixes(iter([batch])):
                found = found[found["n"] > 0]
                yield pd.DataFrame({"gram": found["gram"], "ctx": found["ctx"], "lead": [data[row][p : p + GRAM] for row, p in zip(found[ROW], found["pos"])]})

    return run


def _contexts(length: int, splitters: list[bytes]):
    """Batches of (row, text, places) to the suffixes at those places with what stands before them, and their buckets."""
    reach = length - GRAM

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text, places in zip(batch[ROW], batch["text"], batch["places"]):
                data = text.encode()
                for x in places:
                    p = x["pos"]
                    out.append((bisect_right(splitters, data[p : p + GRAM]), x["gram"], x["ctx"], row, p, x["single"], data[max(0, p - reach) : p], data[p : p + length]))
            yield pd.DataFrame(out, columns=["bucket", "gram", "ctx", ROW, "pos", "single", "before", "after"])

    return run


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of words (rows x words), and at how many leading words each row equals the one before it.

    Three-way multikey quicksort with whole runs as work items: the rows of every run
    that is still undecided are parted by their next word, all runs at once, and runs
    of one row leave the work.
    """
    n, width = words.shape
    order = np.arange(n)
    same = np.zeros(n, dtype=np.int64)
    open_at = np.arange(n)
    run = np.zeros(n, dtype=np.int64)
    for depth in range(width):
        if not len(open_at):
            break
        key = words[order[open_at], depth]
        by = np.lexsort((key, run))
        order[open_at] = order[open_at[by]]
        key, held = key[by], run[by]
        joins = np.zeros(len(by), dtype=bool)
        joins[1:] = (held[1:] == held[:-1]) & (key[1:] == key[:-1])
        same[open_at[joins]] = depth + 1
        crowd = joins.copy()
        crowd[:-1] |= joins[1:]
        run = np.cumsum(~joins)[crowd]
        open_at = open_at[crowd]
    return order, same


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    """Bytes of the parts as rows, cut or filled with zeros."""
    return np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in parts), dtype=np.uint8).reshape(len(parts), width)


def _lcp(cells: np.ndarray, order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bytes that each row, in order, shares with the row before it, given its equal leading words."""
    lcp = words * 8
    part = np.flatnonzero((words * 8 < cells.shape[1]) & (np.arange(len(order)) > 0))
    if len(part):
        columns = (words[part] * 8)[:, None] + np.arange(8)
        differ = cells[order[part][:, None], columns] != cells[order[part - 1][:, None], columns]
        lcp[part] += np.argmax(differ, axis=1)
    lcp[:1] = 0
    return lcp


def equal_windows(before: list[bytes], after: list[bytes], length: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """For each suffix and each j from lo to hi, whether the window from j bytes before its anchor equals one of another suffix."""
    n, reach = len(after), length - GRAM
    hi = reach if hi is None else hi
    deep, left = -(-length // 8) * 8, -(-max(reach, 1) // 8) * 8
    right_cells, left_cells = _padded(after, deep), _padded([x[::-1] for x in before], left)
    right_order, right_same = multikey_quicksort(np.ascontiguousarray(right_cells).view(">u8").astype(np.uint64))
    right_lcp = _lcp(right_cells, right_order, right_same)
    left_order, left_same = multikey_quicksort(np.ascontiguousarray(left_cells).view(">u8").astype(np.uint64))
    left_lcp = _lcp(left_cells, left_order, left_same)
    right_len = np.array([len(x) for x in after])
    left_len = np.array([len(x) for x in before])
    hit = np.zeros((n, reach + 1), dtype=bool)
    right_run, left_run = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(lo, hi + 1):
        ok = np.flatnonzero((left_len >= j) & (right_len >= length - j))
        if len(ok) < 2:
            continue
        right_run[right_order] = np.cumsum(right_lcp < length - j)
        left_run[left_order] = np.cumsum(left_lcp < j) if j else 0
        key = right_run[ok] * (n + 1) + left_run[ok]
        by = np.argsort(key, kind="stable")
        equal = key[by[1:]] == key[by[:-1]]
        hit[ok[by[1:][equal]], j] = True
        hit[ok[by[:-1][equal]], j] = True
    return hit


def _spans_of(hit: np.ndarray, rows: np.ndarray, places: np.ndarray, length: int) -> pd.DataFrame:
    """Runs of hit windows as spans of bytes."""
    wide = np.zeros((len(hit), hit.shape[1] + 2), dtype=np.int8)
    wide[:, 1:-1] = hit
    step = np.diff(wide, axis=1)
    who, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return pd.DataFrame({ROW: rows[who], "start": places[who] - (last - 1), "end": places[who] - first + length})


_RUNS = "gram long, ctx long, __row long, start long, end long"


def _sorted_buckets(length: int):
    """Batches of suffixes, sorted by lo, hi and key, to spans of single suffixes, and to the classes (with null spans) that are covered as a whole."""

    def solved(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        new = _changes(part)
        size = np.diff(np.append(np.flatnonzero(new), len(part)))
        alone = np.repeat(size == 1, size)
        single = part["single"].to_numpy(dtype=bool)
        whole = part[~single]
        yield pd.DataFrame({"gram": whole["gram"], "ctx": whole["ctx"], ROW: None, "start": None, "end": None}).astype({ROW: "Int64", "start": "Int64", "end": "Int64"})
        rest = part[~alone]
        for (lo, hi), own in rest.groupby(["lo", "hi"]):
            hit = equal_windows(own["before"].tolist(), own["after"].tolist(), length, int(lo), int(hi))
            hit &= own["single"].to_numpy(dtype=bool)[:, None]
            yield _spans_of(hit, own[ROW].to_numpy(), own["pos"].to_numpy(), length).assign(gram=0, ctx=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= SORT_ROWS:
                whole = pd.concat(held, ignore_index=True)
                ready = int(np.flatnonzero(_changes(whole))[-1])  # rows come sorted: all but the last key are complete
                if ready:
                    yield from solved(whole.iloc[:ready])
                held, count = [whole.iloc[ready:]], len(whole) - ready
        if count:
            yield from solved(pd.concat(held, ignore_index=True))

    return run


def _changes(part: pd.DataFrame) -> np.ndarray:
    """Whether each row has another lo, hi or key than the row before it."""
    new = np.ones(len(part), dtype=bool)
    for c in ("lo", "hi", "key"):
        values = part[c].to_numpy()
        new[1:] &= values[1:] == values[:-1]
    new[1:] = ~new[1:]
    return new


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, maximal runs of the union."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
            data = text.encode()
            runs = merged([(x["start"], x["end"]) for x in spans]) if spans is not None else []
            kept, at = [], 0
            for s, e in runs:
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            out.append((doc_id, len(data), sum(e - s for s, e in runs), [{"start": s, "end": e} for s, e in runs], b"".join(kept)))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _key(length: int) -> F.Column:
    """The bytes that all windows from lo to hi bytes before the anchor hold."""
    return F.expr(f"concat(substring(before, length(before) - lo + 1, lo), substring(after, 1, {length} - hi))")


def _halved(suffixes: DataFrame, length: int) -> DataFrame:
    """suffixes once for each half of their reach from lo to hi, as far as they hold its windows."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
    cut = suffixes.withColumn("half", F.explode(halves)).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).drop("half")
    return cut.where((F.length("before") >= F.col("lo")) & (F.length("after") >= length - F.col("hi"))).withColumn("key", _key(length))


def repeated_spans(rows: DataFrame, length: int = 200, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(__row, start, end) in bytes of spans that cover all repeated windows of rows(__row, doc_id, text); spans may overlap."""
    spark = rows.sparkSession
    found = rows.select(ROW, "text").mapInPandas(_suffixes(length), "gram long, ctx long, __row long, pos long, n long")

    every = max(1, rows.count() // SAMPLE_ROWS)
    sample = pinned(rows.where(F.pmod(F.xxhash64(ROW), F.lit(every)) == 0).select(ROW, "text").mapInPandas(_leading(length), "gram long, ctx long, lead binary"), "sample")
    hot = [x["gram"] for x in sample.groupBy("gram").count().where("count > 9").orderBy(F.desc("count"), "gram").limit(HOT_GRAMS).collect()]
    # equal suffixes stand for one another, so each counts once
    kinds = sample.groupBy("gram", "ctx").agg(F.first("lead").alias("lead"))
    share = SPLITTER_ROWS / max(1, sample.count())
    leads = sorted(bytes(x["lead"]) for x in kinds.where(F.rand(0) < share).select("lead").collect())  # SPLITTER_ROWS of them, but for chance
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = sorted({leads[k * len(leads) // (FINER * parts)] for k in range(1, FINER * parts)}) if leads else []

    is_hot = F.col("gram").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.xxhash64(ROW, "pos") % 4096).otherwise(F.lit(0))
    total = F.sum("n").over(Window.partitionBy("gram", "salt"))
    repeated = pinned(found.withColumn("salt", salt).withColumn("total", total).where((F.col("total") > 1) | (F.col("n") == 0) | is_hot).select("gram", "ctx", ROW, "pos", "n"), "suffixes", release=True)

    within = repeated.where("n = 0").select(ROW, F.col("pos").alias("start"), F.col("ctx").alias("end"))
    suffixes = repeated.where("n > 0")
    classes = pinned(suffixes.groupBy("gram", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct(ROW, "pos")).alias("place")), "classes", release=True)
    place = F.struct(F.col("place.pos").alias("pos"), "gram", "ctx", (F.col("n") == 1).alias("single"))
    crowded = pinned(classes.groupBy("gram").count().where(F.col("count") > bucket_rows).select("gram"), "crowded")
    many = crowded.count()
    side = F.broadcast(crowded) if many < 10_000 else crowded

    def contexts(of: DataFrame) -> DataFrame:
        places = of.select(F.col(f"place.{ROW}").alias(ROW), place.alias("place")).groupBy(ROW).agg(F.collect_list("place").alias("places"))
        schema = "bucket int, gram long, ctx long, __row long, pos long, single boolean, before binary, after binary"
        made = rows.join(places, ROW).select(ROW, "text", "places").mapInPandas(_contexts(length, splitters), schema)
        return made.select("*", F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"))

    def sorted_by(dealt: DataFrame) -> DataFrame:
        return dealt.sortWithinPartitions("lo", "hi", "key", "after").mapInPandas(_sorted_buckets(length), _RUNS)

    usual = classes.join(side, "gram", "left_anti") if many else classes
    runs = [pinned(sorted_by(contexts(usual).repartition(parts, "bucket").withColumn("key", _key(length))), "runs", release=True)]
    if many:
        left = pinned(contexts(classes.join(side, "gram", "left_semi")), "crowded")
        runs.append(left.where("not single").select("gram", "ctx", *(F.lit(None).cast("long").alias(c) for c in (ROW, "start", "end"))))
        while left.limit(1).count():
            halves = pinned(_halved(left, length), "halves")
            large = pinned(halves.groupBy("lo", "hi", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > bucket_rows).select("lo", "hi", "key"), "large")
            few = halves.join(large, ["lo", "hi", "key"], "left_anti")
            runs.append(pinned(sorted_by(few.repartition(parts, "lo", "hi", "key")).where(F.col(ROW).isNotNull()), "runs"))
            crowd = halves.join(large, ["lo", "hi", "key"], "left_semi")
            # a key of one window is that window: over bucket_rows suffixes, all equal
            ends = F.col("pos") - F.col("lo")
            one = crowd.where("lo = hi AND single")
            runs.append(pinned(one.select("gram", "ctx", ROW, ends.alias("start"), (ends + length).alias("end")), "runs"))
            left = pinned(crowd.where("lo < hi").drop("key"), "crowded")
    every_run = runs[0]
    for more in runs[1:]:
        every_run = every_run.unionByName(more)
    covered = every_run.where(F.col(ROW).isNull()).select("gram", "ctx")
    whole = suffixes.drop("n").join(covered, ["gram", "ctx"]).select(ROW, F.greatest(F.col("pos") - (length - GRAM), F.lit(0)).alias("start"), (F.col("pos") + length).alias("end"))
    return within.unionByName(whole).unionByName(every_run.where(F.col(ROW).isNotNull()).select(ROW, "start", "end"))


def remove_repeats(docs: DataFrame, length: int = 200, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start, end; maximal removed runs) and kept (binary) of every row of docs."""
    rows = numbered(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(rows, length, bucket_rows).groupBy(ROW).agg(F.collect_list(F.struct("start", F.col("end"))).alias("spans"))
    ends = rows.join(spans, ROW, "left").select(ROW, "doc_id", "text", "spans")
    clipped = ends.withColumn("spans", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.least(x["end"], F.octet_length("text").cast("long")).alias("end"))))
    return clipped.mapInPandas(_removed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
