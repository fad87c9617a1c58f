"""Benchmark decontamination with a distributed positional inverted index.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and characters beyond
ASCII. A *window* is ``width`` consecutive words of a test item; an item of fewer words,
but not none, is one window. A document word inside any occurrence of a window is hit.

1. The frequency of each test word over all documents is counted (partial sums).
2. Each window names its two rarest words; the rarest is its *anchor*. The postings of
   those words, the rarest test terms, are stored: word, document, position, and the test
   words around it, so a posting can prove a phrase by itself.
3. Lists are intersected from the rarest word on: a posting and a test place give a shift
   (document position less test position), and a (document, item, shift) survives only if
   the lists of anchor and partner meet there, with at most ``SLOP`` words between shifts.
4. Survivors are compared word by word. An exact phrase is a hit. A proximity match is a
   window of which ``NEARLY`` of the words, its two rarest among them, each stand at most
   ``SLOP`` words off their places as seen from the anchor; it is told, but no hit.
5. Hits are gathered per document.

The test items are taken in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast
has a fixed bound, whatever the size of the benchmark. Null texts have no words. doc_id
may be null or repeated: rows are told apart by a number of their own. Equal items all
count, while an id is listed once however many items have it; item_id null is left out of
the lists but its windows still hit. Of equally rare
words the first counts. Other columns are ignored, whatever their names; an empty table
gives an empty result, and without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ROW, numbered, pinned

#: Words of test items that one pass over the documents looks for.
BLOCK_WORDS = 1_000_000
#: Words by which a place may be off in a proximity match, and the share of a window's words that must be there.
SLOP, NEARLY = 3, 0.8
#: Characters of words; everything else in ASCII parts them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def item_words(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id and words (array of binary) of items that have words."""
    rows = benchmark.select(F.col("item_id"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"].map(lambda x: None if pd.isna(x) else str(x)), "words": [words_of(t) for t in batch["text"]]})

    out = rows.withColumn("item_id", F.col("item_id").cast("string")).mapInPandas(run, "item_id string, words array<binary>")
    return out.where(F.size("words") > 0)


def _places(items: list[list[bytes]], width: int, seen: dict[bytes, int]) -> list[tuple[int, int, int, int]]:
    """(item, anchor place, partner place, window start) of each window; the anchor is its rarest word, the partner the next."""
    out = []
    for k, words in enumerate(items):
        rank = [(seen.get(w, 0), p) for p, w in enumerate(words)]
        for start in range(max(1, len(words) - width + 1)):
            best = sorted(rank[start : start + width])[:2]
            if best[0][0]:
                out.append((k, best[0][1], best[-1][1], start))
    return out


def _counts(terms: dict[bytes, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(terms), dtype=np.int64)
        get = terms.get
        for batch in batches:
            for text in batch["text"]:
                found = [x for x in map(get, words_of(text)) if x is not None]
                if found:
                    np.add.at(total, found, 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    return run


def _postings(terms: dict[bytes, int], kept: set[int], around: int):
    """Per document its number of words and the postings of the kept terms, each with the terms around it (-1: no test word)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = terms.get
        mark = np.zeros(len(terms) + 1, dtype=bool)
        mark[list(kept)] = True
        for batch in batches:
            sizes, lists = [], []
            for text in batch["text"]:
                words = words_of(text)
                ids = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
                sizes.append(len(words))
                at = np.flatnonzero(mark[ids]) if len(ids) else ()
                wide = np.pad(ids, around, constant_values=-1) if len(at) else None
                lists.append([{"term": int(ids[p]), "pos": int(p), "around": wide[p : p + 2 * around + 1].tobytes()} for p in at])
            yield pd.DataFrame({ROW: batch[ROW], "doc_id": batch["doc_id"], "n_words": sizes, "postings": lists})

    return run


def _proved(items: list[list[int]], starts: dict[tuple[int, int, int], list[int]], width: int, around: int):
    """Candidates to what their posting's surroundings prove: (row, item, first word, end word) of hit spans; places of -1 for a proximity match alone."""

    def nearly(test: list[int], start: int, place: int, partner: int, near: list[int]) -> bool:
        found, window = 0, range(start, min(len(test), start + width))
        for k in window:
            at = around + k - place
            ok = near[around] == test[k] if k == place else test[k] in near[max(0, at - SLOP) : at + SLOP + 1]
            if not ok and k in (place, partner):
                return False
            found += ok
        return found >= NEARLY * len(window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, item, place, partner, pos, context in zip(batch[ROW], batch["item"], batch["place"], batch["partner"], batch["pos"], batch["around"]):
                test = items[item]
                near = np.frombuffer(context, dtype=np.int32)
                lo, hi = max(0, place - around), min(len(test), place + around + 1)
                same = np.array(test[lo:hi], dtype=np.int32) == near[around - (place - lo) : around + (hi - place)]
                need = min(width, len(test))
                left = place - lo
                while left > 0 and same[left - 1]:
                    left -= 1
                right = place - lo + 1
                while right < len(same) and same[right]:
                    right += 1
                if right - left >= need:
                    shift = pos - place + lo
                    out.append((row, item, shift + left, shift + right))
                else:
                    listed = near.tolist()
                    if any(nearly(test, start, place, partner, listed) for start in starts[item, place, partner]):
                        out.append((row, item, -1, -1))
            yield pd.DataFrame(out, columns=[ROW, "item", "start", "end"]).astype("int64")

    return run


def _block_matches(rows: DataFrame, items: list[list[bytes]], width: int) -> tuple[DataFrame, DataFrame]:
    """(documents with n_words, matches (row, item, start, end)) for a bounded list of items."""
    spark = rows.sparkSession
    vocabulary = sorted({w for words in items for w in words})
    terms = {w: k for k, w in enumerate(vocabulary)}
    counted = rows.select("text").mapInPandas(_counts(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    seen = {vocabulary[x["term"]]: x["n"] for x in counted.collect()}  # as many rows as test words
    places = _places(items, width, seen)
    kept = {terms[items[k][p]] for k, a, b, _ in places for p in (a, b)}
    around = width - 1 + SLOP
    index = pinned(rows.mapInPandas(_postings(terms, kept, around), f"__row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, postings array<struct<term:int,pos:long,around:binary>>"), "postings")
    postings = index.select(ROW, F.explode("postings").alias("p")).select(ROW, "p.term", "p.pos", "p.around")

    starts: dict[tuple[int, int, int], list[int]] = {}
    for k, a, b, start in places:
        starts.setdefault((k, a, b), []).append(start)
    anchors = spark.createDataFrame([(k, a, b, terms[items[k][a]]) for k, a, b in sorted(starts)], "item int, place int, partner int, term int")
    partners = spark.createDataFrame(sorted({(k, b, terms[items[k][b]]) for k, _, b in starts}), "item int, partner int, term int")
    # shifts at most SLOP apart meet in a cell: those of the anchor list stand in every cell that they reach into
    cell = lambda shift: F.floor(shift / (8 * SLOP))
    shift = F.col("pos") - F.col("place")
    first = postings.join(F.broadcast(anchors), "term").withColumn("cell", F.explode(F.array_distinct(F.array(cell(shift - SLOP), cell(shift + SLOP)))))
    second = postings.drop("around").join(F.broadcast(partners), "term").select(ROW, "item", "partner", cell(F.col("pos") - F.col("partner")).alias("cell"))
    met = first.join(second, [ROW, "item", "partner", "cell"], "left_semi")
    coded = [[terms[w] for w in words] for words in items]
    return index.select(ROW, "doc_id", "n_words"), met.select(ROW, "item", "place", "partner", "pos", "around").mapInPandas(_proved(coded, starts, width, around), "__row long, item long, start long, end long")


def _hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for spans in batch["spans"]:
            runs: list[list[int]] = []
            for s, e in sorted((x["start"], x["end"]) for x in spans) if spans is not None else ():
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            out.append([{"start": s, "end": e} for s, e in runs])
        yield pd.DataFrame({ROW: batch[ROW], "doc_id": batch["doc_id"], "n_words": batch["n_words"], "n_items": batch["n_items"], "n_near": batch["n_near"], "items": batch["items"], "hits": out})


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The stated query set in blocks of at most ``most`` words, one block on the driver at a time; an empty one if there are no items."""
    block, size, any_yet = [], 0, False
    for x in item_words(benchmark).toLocalIterator():
        if size and size + len(x["words"]) > most:
            yield block
            block, size, any_yet = [], 0, True
        block.append((x["item_id"], [bytes(w) for w in x["words"]]))
        size += len(x["words"])
    if block or not any_yet:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """__row (of numbered(docs)), doc_id, n_words, n_items (items with occurring windows), n_near (items with proximity matches or occurring windows), items (the ids of the former as sorted strings) and hits (array of start, end in words) of every row of docs."""
    rows = numbered(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    base, spans = None, None
    for number, block in enumerate(_blocks(benchmark, block_words)):
        index, found = _block_matches(rows, [w for _, w in block], width)
        names = docs.sparkSession.createDataFrame([(k, n) for k, (n, _) in enumerate(block)], "item long, item_id string")
        found = found.join(F.broadcast(names), "item").withColumn("item", F.col("item") + F.lit(number << 32))
        base = base if base is not None else index
        spans = found if spans is None else spans.unionByName(found)
    exact = F.col("start") >= 0
    per_doc = spans.groupBy(ROW).agg(
        F.collect_set(F.when(exact, F.struct("start", F.col("end")))).alias("spans"), F.array_sort(F.collect_set(F.when(exact, F.col("item_id")))).alias("items"),
        F.countDistinct(F.when(exact, F.col("item"))).alias("n_items"), F.countDistinct("item").alias("n_near"),
    )
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = base.join(per_doc, ROW, "left").select(ROW, "doc_id", "n_words", number("n_items"), number("n_near"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")
    return joined.mapInPandas(_hits, f"{ROW} long, doc_id {kind}, n_words long, n_items long, n_near long, items array<string>, hits array<struct<start:long,end:long>>")


def positional_index(docs: DataFrame) -> DataFrame:
    """Postings of every word: term (binary), doc_id and its sorted word positions (array of long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                places: dict[bytes, list[int]] = {}
                for p, w in enumerate(words_of(text)):
                    places.setdefault(w, []).append(p)
                out += [(w, doc_id, at) for w, at in places.items()]
            yield pd.DataFrame(out, columns=["term", "doc_id", "positions"])

    return docs.select("doc_id", "text").mapInPandas(run, f"term binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, positions array<long>")


def proximity_matches(index: DataFrame, one: str, two: str, within: int) -> DataFrame:
    """(doc_id, one_at, two_at) of each place of word one and its nearest places of word two, at most within words apart on either side."""
    a = index.where(F.col("term") == F.lit(words_of(one)[0])).select("doc_id", F.explode("positions").alias("one_at"))
    b = index.where(F.col("term") == F.lit(words_of(two)[0])).select("doc_id", F.explode("positions").alias("two_at"))
    # places are cut into cells of the distance, so only neighbouring cells of one document meet
    a = a.withColumn("cell", F.explode(F.array(*(F.floor(F.col("one_at") / within) + d for d in (-1, 0, 1)))))
    b = b.withColumn("cell", F.floor(F.col("two_at") / within))
    near = a.join(b, ["doc_id", "cell"]).where((F.abs(F.col("one_at") - F.col("two_at")) <= within) & (F.col("one_at") != F.col("two_at")))
    nearest = Window.partitionBy("doc_id", "one_at")
    gap = F.abs(F.col("one_at") - F.col("two_at"))
    return near.withColumn("least", F.min(gap).over(nearest)).where(gap == F.col("least")).select("doc_id", "one_at", "two_at")
