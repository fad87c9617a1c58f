"""Packing token pieces into fixed-length sequences by linear grouping and best fit.

1. Texts are tokenised; documents longer than a sequence are cut so that only the first
   piece may be shorter. Pieces are small rows: document, number, start, length.
2. The histogram of lengths (at most ``capacity`` entries) goes to the driver, nothing
   else. Large lengths are put in order and grouped into groups of equal cardinality;
   each is rounded up to its group's greatest. With few sizes left, the best mix of
   configurations (multisets of sizes that fit a sequence) is a linear programme, solved
   by column generation; its solution is rounded down and the rest is packed by best fit.
3. Actual lengths are put in place of the rounded ones, and the small lengths go into the
   room that this leaves, best fit first, then into new sequences.
4. The plan is a table of runs: the pieces of one length that rank between two bounds
   belong to consecutive sequences at one offset. Ranks come from a count per (length,
   partition), so no length gathers in one task, and each piece finds its run in a
   broadcast table whose size depends on ``capacity`` only.

Null text counts as empty: such a document is one piece with the end token alone. doc_id
may be null or repeated; each row is packed, copies too. Long texts become as many pieces
as they need. Pieces of equal length take their places in the order of the scan. Other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ROW, numbered, pinned

#: Groups of large lengths: sizes of the linear programme.
GROUPS = 700
#: Lengths above this share of a sequence are large.
LARGE = 1 / 3
#: Words whose ids a Python worker keeps, unless told otherwise.
CACHED_WORDS = 1_000_000

_CACHE: dict[tuple[str, bool], "_Words"] = {}
_UNSAFE = r" \s"


def byte_ranks(path: str):
    """The encoder of the same vocabulary in its rank form beside path, for words that a cache lacks; None without such a file."""
    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks_path):
        return None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Words(dict):
    """Ids of words (with their leading blank) as little-endian bytes; literal: strings of added tokens are ordinary text."""

    def __init__(self, path: str, literal: bool):
        super().__init__()
        self.most = CACHED_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = literal
        added = [] if literal else [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_UNSAFE, *map(re.escape, added)]))
        self.fast = byte_ranks(path)

    def __missing__(self, word: str) -> bytes:
        ids = self.fast(word) if self.fast else self.model.encode(word, add_special_tokens=False).ids
        out = np.array(ids, dtype="<u4").tobytes()
        if len(word) < 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


def _ids(words: _Words, text: str) -> bytes:
    """Ids of a text as little-endian bytes.

    A blank before a word belongs to it and parts it from what stands before, so words
    are independent; texts with other runs of white space around blanks, or with the
    string of an added token, go in whole.
    """
    if words.whole.search(text):
        return np.array(words.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    first, *rest = text.split(" ")
    if not rest:
        return words[first] if first else b""
    return (words[first] if first else b"") + b"".join([words[x] for x in [" " + w for w in rest]])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, literal: bool = True, cached_words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row of docs.

    Unless literal, ids are those of the tokenizer's plain ``encode(text,
    add_special_tokens=False)``, which reads the strings of added tokens as those tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _CACHE.get((tokenizer, literal)) or _Words(tokenizer, literal)
        _CACHE[tokenizer, literal] = words
        words.most = cached_words
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for row, doc_id, text in zip(batch[ROW], batch["doc_id"], batch["text"]):
                raw = _ids(words, text) + end
                n = len(raw) // 4
                start, number = 0, 0
                size = n % capacity or min(n, capacity)
                while start < n:
                    out.append((row, doc_id, number, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)])))
                    start, number, size = start + size, number + 1, capacity
            yield pd.DataFrame(out, columns=[ROW, "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = numbered(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"__row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _groups(counts: dict[int, int], most: int) -> list[list[int]]:
    """Lengths, in order, in at most about ``most`` groups of equal cardinality; a length is never split."""
    share, out, held = sum(counts.values()) / most, [], 0.0
    for length in sorted(counts, reverse=True):
        if not out or held >= share:
            out.append([])
            held = 0.0
        if out[-1] and held + counts[length] > 1.5 * share:
            out.append([])
            held = 0.0
        out[-1].append(length)
        held += counts[length]
    return out


def _best_column(sizes: np.ndarray, worth: np.ndarray, rest: np.ndarray) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth that fits: a knapsack by number of pieces. rest: room left by each size in each room, negative where it doesn't fit."""
    values = [np.zeros(len(rest))]
    for _ in range((len(rest) - 1) // int(sizes.min())):
        gain = np.where(rest >= 0, values[-1][rest] + worth, 0).max(axis=1)
        values.append(np.maximum(values[-1], gain))
    column, room = np.zeros(len(sizes)), len(rest) - 1
    for before, now in zip(values[-2::-1], values[:0:-1]):
        if now[room] > before[room] + 1e-12:
            k = int(np.argmax(np.where(rest[room] >= 0, before[rest[room]] + worth, 0)))
            column[k] += 1
            room = int(rest[room, k])
    return float(values[-1][-1]), column


def configurations(sizes: list[int], demand: list[int], capacity: int, most: int = 4000) -> list[tuple[list[int], int]]:
    """(multiplicity of each size, times used) of an optimal fractional packing rounded down: column generation with a revised simplex."""
    size, need = np.array(sizes), np.array(demand, dtype=float)
    n = len(sizes)
    columns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / (capacity // size))
    level = inverse @ need
    rest = np.arange(capacity + 1)[:, None] - size
    for _ in range(most):
        worth = inverse.sum(axis=0)
        value, column = _best_column(size, np.maximum(worth, 0), rest)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        grows = np.flatnonzero(step > 1e-9)
        ratio = level[grows] / step[grows]
        out = grows[int(np.argmin(ratio))]
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out] = column
        level = np.maximum(level - step * ratio.min(), 0)
        level[out] = ratio.min()
    return [(columns[:, k].astype(int).tolist(), int(math.floor(level[k] + 1e-9))) for k in range(n) if level[k] >= 1 - 1e-9]


class _Bins:
    """Kinds of sequences by the room left: room -> list of [times, lengths so far]."""

    def __init__(self, capacity: int):
        self.by_room: dict[int, list[list]] = {}
        self.capacity = capacity

    def add(self, room: int, times: int, held: tuple[int, ...]) -> None:
        if times:
            self.by_room.setdefault(room, []).append([times, held])

    def best_fit(self, length: int, count: int) -> None:
        """count pieces of a length, each into the fullest sequence that has room, else a new one."""
        while count:
            room = min((r for r in self.by_room if r >= length), default=None)
            if room is None:
                each = self.capacity // length
                self.add(self.capacity - each * length, count // each, (length,) * each)
                if count % each:
                    self.add(self.capacity - count % each * length, 1, (length,) * (count % each))
                return
            kinds = self.by_room[room]
            times, held = kinds.pop()
            if not kinds:
                del self.by_room[room]
            each = min(room // length, count)
            used = min(times, count // each)
            self.add(room, times - used, held)
            self.add(room - each * length, used, held + (length,) * each)
            count -= used * each

    def kinds(self) -> list[tuple[int, tuple[int, ...]]]:
        return [(times, held) for room in self.by_room for times, held in self.by_room[room]]


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of the kinds of sequences that pack counts[length] pieces of each length."""
    left = {k: v for k, v in counts.items() if v}
    bins = _Bins(capacity)
    large = {k: v for k, v in left.items() if k > capacity * LARGE}
    small = {k: v for k, v in left.items() if k <= capacity * LARGE}
    if capacity in large:
        bins.add(0, large.pop(capacity), (capacity,))
    if large:
        grouped = _groups(large, groups)
        stock = [[[x, large[x]] for x in g] for g in grouped]  # greatest first
        mix = configurations([g[0] for g in grouped], [sum(large[x] for x in g) for g in grouped], capacity)
        for column, times in sorted(mix, key=lambda x: -x[1]):
            while times:
                # the same actual lengths in as many sequences as all of them last for
                wanted = [(k, m) for k, m in enumerate(column) if m]
                if any(sum(n for _, n in stock[k]) < m for k, m in wanted):
                    break
                held, run = [], times
                for k, m in wanted:
                    x, n = stock[k][0]
                    run = min(run, n // m) if n >= m else 0
                if run:
                    for k, m in wanted:
                        held += [stock[k][0][0]] * m
                        stock[k][0][1] -= run * m
                else:  # a length runs out inside this sequence
                    run = 1
                    for k, m in wanted:
                        for _ in range(m):
                            while not stock[k][0][1]:
                                stock[k].pop(0)
                            held.append(stock[k][0][0])
                            stock[k][0][1] -= 1
                for k, _ in wanted:
                    while stock[k] and not stock[k][0][1]:
                        stock[k].pop(0)
                bins.add(capacity - sum(held), run, tuple(held))
                times -= run
        for length, count in sorted((x for g in stock for x in g if x[1]), reverse=True):
            bins.best_fit(length, count)
    for length in sorted(small, reverse=True):
        bins.best_fit(length, small[length])
    return bins.kinds()


def _runs(kinds: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, times, first sequence, offset) of each place of each kind."""
    out, rank, sequence = [], {}, 0
    for times, held in kinds:
        offset = 0
        for length in held:
            first = rank.get(length, 0)
            out.append((length, first, times, sequence, offset))
            rank[length] = first + times
            offset += length
        sequence += times
    return out


def pack(found: DataFrame, capacity: int = 1024, groups: int = GROUPS) -> DataFrame:
    """found (rows with a length from 1 to capacity) with sequence_id and offset; offsets of a sequence are gapless from 0."""
    spark = found.sparkSession
    held = pinned(found, "pieces")
    # a row's rank among its length: its place in its partition, behind the partitions before
    ranked = pinned(held.withColumn("part", F.spark_partition_id()).withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy(F.monotonically_increasing_id()))), "ranked")
    parts = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    counts = {x["length"]: x["n"] for x in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = sorted(_runs(plan(counts, capacity, groups)))
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    starts = {int(x): i for i, x in reversed(list(enumerate(table[:, 0])))}
    ends = {int(x): i + 1 for i, x in enumerate(table[:, 0])}
    shared = spark.sparkContext.broadcast((table, starts, ends))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, starts, ends = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch.pop("rank").to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for x in np.unique(length):
                own = table[starts[int(x)] : ends[int(x)]]
                at = np.flatnonzero(length == x)
                k = np.searchsorted(own[:, 1], rank[at], side="right") - 1
                sequence[at] = own[k, 3] + rank[at] - own[k, 1]
                offset[at] = own[k, 4]
            yield batch.assign(sequence_id=sequence, offset=offset)

    columns = [c for c in held.columns]
    ranks = ranked.join(before, ["length", "part"]).withColumn("rank", (F.col("rank") - 1 + F.col("before")).cast("long")).select(*columns, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", sequence_id long, offset long"
    return ranks.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, groups: int = GROUPS, literal: bool = True, cached_words: int = CACHED_WORDS) -> DataFrame:
    """The pieces of all rows of docs with their sequences."""
    return pack(pieces(docs, tokenizer, capacity, literal=literal, cached_words=cached_words), capacity, groups).drop(ROW)
