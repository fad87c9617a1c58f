"""Ranked lexical search with a hierarchical max tree over document ranges per term.

1. Terms are maximal runs of digits, letters (A-Z lower-cased) and characters beyond
   ASCII. Each document is parsed once; its number of terms and the counts of those terms
   that some query holds are stored (:func:`term_counts`).
2. Sums over all documents give their number N, their terms L and each query term's
   document frequency; with them every posting has its integer score.
3. A task reads its documents in segments of ``SEGMENT`` documents at most. A segment
   is a :class:`MaxTree`: each term has its postings by document and over them, level by
   level, its greatest score in every range of 16, 256, 4,096 ... documents.
4. For each query a best-first branch and bound descends the tree: a node is bound by the
   sum of its terms' greatest scores, the node of the highest bound is opened next, and
   the search ends when that bound is below the last of the best documents found. Nodes of
   an equal bound are opened, as an equal score may belong to a smaller doc_id. What a task
   has found so far also bounds its later segments.
5. The best of all tasks are ranked by a window function that keeps the first few of each
   query before its shuffle.

Queries are taken in blocks of ``BLOCK_WORDS`` words at most, so what is broadcast and held
per task has a fixed bound. Null and empty texts have no terms and count for nothing. doc_id
may be null (such a document comes behind its equals) or repeated (each row is a document).
Equal scores stand by ascending doc_id, then in the order of the scan. Each row of the
queries is a query; those without terms, or whose terms no document holds, have no rows.
Other columns are ignored, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ROW, numbered, pinned
from gridloom.llm.decontamination import words_of

#: Words of queries that one pass over the documents answers.
BLOCK_WORDS = 1_000_000
#: Documents of a tree, and postings at which one is closed earlier.
SEGMENT, POSTINGS = 1 << 15, 1 << 22
#: Children of a node.
FAN = 16


def _blocks(queries: DataFrame, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item_id, words) of the stated query set in blocks of at most ``most`` words, one block on the driver at a time."""
    block, size = [], 0
    for x in queries.select("item_id", "text").where("text is not null").toLocalIterator():
        words = words_of(x["text"])
        if size and size + len(words) > most:
            yield block
            block, size = [], 0
        if words:
            block.append((x["item_id"], words))
            size += len(words)
    if block:
        yield block


def term_counts(rows: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """__row, doc_id, missing (doc_id is null and stands as any value), n (terms with repeats), terms and counts (binary, little-endian numbers of the given terms and how often they occur) of rows that have terms."""
    known = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = known.value.get
        for batch in batches:
            sizes, ids, counts = [], [], []
            for text in batch["text"]:
                words = words_of(text)
                found = Counter(map(get, words))
                found.pop(None, None)
                sizes.append(len(words))
                ids.append(np.fromiter(found.keys(), dtype="<i4", count=len(found)).tobytes())
                counts.append(np.fromiter(found.values(), dtype="<i4", count=len(found)).tobytes())
            out = pd.DataFrame({ROW: batch[ROW], "doc_id": batch["doc_id"], "missing": batch["missing"], "n": sizes, "terms": ids, "counts": counts})
            yield out[out["n"] > 0]

    kind = rows.schema["doc_id"].dataType.simpleString()
    whole = rows.select(ROW, F.coalesce("doc_id", F.lit("0").cast(kind)).alias("doc_id"), F.isnull("doc_id").alias("missing"), "text")
    return whole.mapInPandas(run, f"{ROW} long, doc_id {kind}, missing boolean, n long, terms binary, counts binary")


def _frequencies(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of size terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"]), dtype="<i4"), minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    out = np.zeros(size, dtype=np.int64)
    for x in index.select("terms").mapInPandas(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # as many rows as terms
        out[x["term"]] = x["df"]
    return out


class MaxTree:
    """Scores of the postings of a run of documents, and per term the greatest over ranges of documents, by level.

    ``keys[k]`` holds ``term * width[k] + node`` in order and ``scores[k]`` the greatest
    score of that term below that node; a node of level k is a range of FAN ** k documents.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, score: np.ndarray, size: int):
        order = np.argsort(term.astype(np.int64) * size + doc, kind="stable")
        term, node, score, width = term[order].astype(np.int64), doc[order].astype(np.int64), score[order], size
        self.width, self.keys, self.scores = [width], [term * width + node], [score]
        while width > FAN:
            node, width = node // FAN, -(-width // FAN)
            key = term * width + node
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
            score = np.maximum.reduceat(score, at) if len(at) else score
            term, node = term[at], node[at]
            self.width.append(width)
            self.keys.append(key[at])
            self.scores.append(score)

    def sums(self, level: int, first: int, end: int, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Summed scores of the terms at the nodes first to end of a level."""
        keys, base = self.keys[level], terms * self.width[level]
        lo, hi = np.searchsorted(keys, base + first), np.searchsorted(keys, base + end)
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = np.zeros(end - first, dtype=np.int64)
        np.add.at(out, keys[at] - np.repeat(base, n) - first, self.scores[level][at] * np.repeat(times, n))
        return out

    def best(self, terms: np.ndarray, times: np.ndarray, found: list, most: int, named: list[tuple]) -> None:
        """Brings found, the sorted (-score, *named[document]) of the best documents so far, up to date."""
        top = len(self.width) - 1
        opened = [(0, top + 1, 0)]
        while opened:
            bound, level, node = heapq.heappop(opened)
            floor = -found[-1][0] if len(found) == most else 1
            if level <= top and -bound < floor:
                break
            first = node * FAN
            sums = self.sums(level - 1, first, min(first + FAN, self.width[level - 1]), terms, times)
            for k in np.flatnonzero(sums >= floor).tolist():
                if level > 1:
                    heapq.heappush(opened, (-int(sums[k]), level - 1, first + k))
                else:
                    insort(found, (-int(sums[k]), *named[first + k]))
                    del found[most:]


def _searched(queries: list[list[tuple[int, int]]], weights: np.ndarray, total: int, most: int):
    """Batches of the index to (item, score, missing, doc_id, __row) of the best documents of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [(np.array([t for t, _ in q], dtype=np.int64), np.array([n for _, n in q], dtype=np.int64)) for q in queries.value]
        weight, documents, terms_in_all = weights.value, *total
        found: list[list[tuple]] = [[] for _ in asked]
        held: list[pd.DataFrame] = []
        size = postings = 0

        def solve() -> None:
            part = pd.concat(held, ignore_index=True)
            sizes = part["terms"].map(len).to_numpy() // 4
            doc = np.repeat(np.arange(len(part)), sizes)
            term = np.frombuffer(b"".join(part["terms"]), dtype="<i4")
            count = np.frombuffer(b"".join(part["counts"]), dtype="<i4").astype(np.int64)
            norm = 25 + 75 * part["n"].to_numpy() * documents // terms_in_all
            tree = MaxTree(term, doc, weight[term] * (1_000_000_000 * count // (1000 * count + 8 * norm[doc])), len(part))
            named = list(zip(part["missing"].tolist(), part["doc_id"].tolist(), part[ROW].tolist()))

            for (terms, times), own in zip(asked, found):
                tree.best(terms, times, own, most, named)

        for batch in batches:
            for lo in range(0, len(batch), 1024):
                held.append(batch.iloc[lo : lo + 1024])
                size += len(held[-1])
                postings += sum(map(len, held[-1]["terms"])) // 4
                if size >= SEGMENT or postings >= POSTINGS:
                    solve()
                    held.clear()
                    size = postings = 0
        if held:
            solve()
        out = [(item, -score, missing, doc_id, row) for item, own in enumerate(found) for score, missing, doc_id, row in own]
        yield pd.DataFrame(out, columns=["item", "score", "missing", "doc_id", ROW])

    return run


def _answers(rows: DataFrame, block: list[tuple[object, list[bytes]]], most: int) -> DataFrame:
    """(item, score, missing, doc_id, __row): each task's best documents for the queries of a block."""
    spark = rows.sparkSession
    vocabulary = sorted({w for _, words in block for w in words})
    terms = {w: k for k, w in enumerate(vocabulary)}
    index = pinned(term_counts(rows, terms), "terms")
    sums = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    weights = np.array([math.floor(1000 * math.log((2 * sums["n"] + 2) / (2 * int(x) + 1))) for x in _frequencies(index, len(terms))], dtype=np.int64)
    queries = [sorted(Counter(terms[w] for w in words).items()) for _, words in block]
    share = spark.sparkContext.broadcast
    run = _searched(share(queries), share(weights), (sums["n"], sums["l"]), most)
    return index.mapInPandas(run, f"item long, score long, missing boolean, doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ROW} long")


def search(docs: DataFrame, queries: DataFrame, most: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``most`` best documents of each row of queries (item_id, text)."""
    spark, kind = docs.sparkSession, queries.schema["item_id"].dataType.simpleString()
    rows = numbered(docs, "doc_id", "text")
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for block in _blocks(queries, block_words):
        best = Window.partitionBy("item").orderBy(F.desc("score"), "missing", "doc_id", ROW)
        ranked = _answers(rows, block, most).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
        names = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(block)], f"item long, item_id {kind}")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id"), "score"))
    return out
