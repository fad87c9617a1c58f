"""Alignment of two tokenisers' tokens over the same bytes.

1. Both tokenisers encode each text (:func:`encoded`): A reads a blank and the text, B the
   text alone, as it adds that blank itself. Ids are stored, two bytes each where both
   vocabularies allow it. A text whose joined bytes differ from blank + text on either
   side has no tokens.
2. The tokens of B stand in a static interval index: their byte intervals in order. Each
   token of A asks it by two bisections for the intervals that it stabs
   (:class:`IntervalIndex`); every overlap is a link. A gap between tokens of B that no
   token of A spans ends a group.
3. A pair of ids counts the documents that hold it linked: partial sums per task, one
   shuffle, and the greatest count of each id of A.
4. Links meet the counts of their pairs. The pairs of greatest count, ``SHARED_PAIRS`` at
   most, go to the tasks in a broadcast; any other pair of a document is a row of its own
   that joins the table of counts. A pair beyond the broadcast is in fewer documents than
   all within it, so no key of that join is hot.

Long texts are encoded and aligned in stretches that end where both tokenisers end a
token. Null and empty texts have no tokens: zeros, and an empty digest. doc_id may be null
or repeated: each row is a document of its own, copies count each. Other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ROW, greatest, numbered, pinned
from gridloom.llm.packing import byte_ranks

#: Pairs of ids whose counts are broadcast, at most (17 bytes each).
SHARED_PAIRS = 1 << 19
#: Characters that are encoded at once, and tokens of A that are aligned at once.
STRETCH, TOKENS = 1 << 22, 1 << 18
#: Pairs that a task sums up before it sends them on.
HELD_PAIRS = 1 << 20

_BLANK = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r" \s")
_MODELS: dict[tuple[str, str], "_Pair"] = {}


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class _Pair:
    """Both encoders, and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_file(a)
        self.one.encode_special_tokens = True
        self.two = sentencepiece.SentencePieceProcessor(model_file=b)
        self.fast = byte_ranks(a)
        codes = byte_level()
        size = max(self.one.get_vocab().values()) + 1
        named = [self.one.id_to_token(k) or "" for k in range(size)]
        self.a_bytes = [bytes(codes[c] for c in t) if all(c in codes for c in t) else t.encode() for t in named]
        pieces = [self.two.id_to_piece(k) for k in range(self.two.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.two.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        self.kind = "<u2" if max(size, len(pieces)) <= 1 << 16 else "<u4"

    def _ids(self, spaced: str) -> list[int]:
        return self.fast(spaced) if self.fast else self.one.encode(spaced, add_special_tokens=False).ids

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A for blank + word, of all words in a row, and how many each word has; the same of B for word; whether both sides' bytes are blank + word."""
        raw = [b" " + w.encode() for w in words]
        sizes = np.array([len(x) for x in raw])
        # words that neither begin nor end in white space stay apart in a common text
        odd = [k for k, w in enumerate(words) if not w or w[0].isspace() or w[-1].isspace()]
        lists = {k: self._ids(" " + words[k]) for k in odd}
        kept = np.delete(np.arange(len(words)), odd)
        flat = np.array(self._ids("".join([" " + words[k] for k in kept.tolist()])), dtype=self.kind)
        a_counts = np.zeros(len(words), dtype=np.int64)
        ends = np.searchsorted(np.cumsum(self.a_size[flat]), np.cumsum(sizes[kept])) + 1
        a_counts[kept] = np.diff(ends, prepend=0)
        a_counts[odd] = [len(lists[k]) for k in odd]
        a_starts = np.cumsum(a_counts) - a_counts
        one = np.zeros(int(a_counts.sum()), dtype=self.kind)
        one[_ranges(a_starts[kept], a_counts[kept])] = flat
        for k, ids in lists.items():
            one[a_starts[k] : a_starts[k] + len(ids)] = ids
        found = self.two.encode(words, num_threads=1)
        b_counts = np.array([len(x) for x in found], dtype=np.int64)
        two = np.fromiter(chain.from_iterable(found), dtype=self.kind, count=int(b_counts.sum()))
        same = _spelled(one, a_counts, self.a_bytes, raw) & _spelled(two, b_counts, self.b_bytes, raw)
        return one, a_counts, two, b_counts, same


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one range after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _spelled(ids: np.ndarray, counts: np.ndarray, named: list[bytes], raw: list[bytes]) -> np.ndarray:
    """Whether the tokens of each word join to its raw bytes."""
    parts = [named[k] for k in ids.tolist()]
    ends = np.cumsum(counts)
    lengths = np.cumsum([0, *map(len, parts)])
    same = np.diff(lengths[ends], prepend=0) == [len(x) for x in raw]
    if same.all() and b"".join(parts) == b"".join(raw):
        return same
    return np.array([b"".join(parts[e - n : e]) == x for e, n, x in zip(ends.tolist(), counts.tolist(), raw)], dtype=bool)


def _models(a: str, b: str) -> _Pair:
    if (a, b) not in _MODELS:
        _MODELS[a, b] = _Pair(a, b)
    return _MODELS[a, b]


def _words(text: str) -> list[str]:
    """A text cut at single blanks between other characters: there a token begins on both sides, whatever stands around, so what lies between is encoded by itself.

    U+2581 is a blank to B, so a text that has one, whose bytes differ in any case, stays whole.
    """
    if "▁" in text:
        return [text]
    plain = not _UNSAFE.search(text) and text[:1] != " " and text[-1:] != " "
    return text.split(" ") if plain else _BLANK.split(text)


def _stretches(text: str) -> Iterator[str]:
    """A text in stretches of about ``STRETCH`` characters, cut at single blanks between other characters, which are left out."""
    lo = 0
    while len(text) - lo > STRETCH and "▁" not in text:
        found = _BLANK.search(text, lo + STRETCH)
        if not found:
            break
        yield text[lo : found.start()]
        lo = found.end()
    yield text[lo:] if lo else text


def encode(models: _Pair, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
    """Ids of both sides for each text; empty if it has no characters or its bytes differ from blank + text. Every distinct word of a stretch is encoded once."""
    sides: tuple[list[list[bytes]], ...] = ([[] for _ in texts], [[] for _ in texts])
    failed: set[int] = set()
    owners: list[int] = []
    numbers: list[int] = []
    held: list[str] = []

    def flush() -> None:
        codes, distinct = pd.factorize(np.array(held, dtype=object))
        one, a_counts, two, b_counts, same = models.words(distinct.tolist())
        edges = np.cumsum([0, *numbers])
        right = np.add.reduceat(same[codes], edges[:-1], dtype=np.int64) == numbers
        failed.update(k for k, ok in zip(owners, right.tolist()) if not ok)
        for ids, counts, out in ((one, a_counts, sides[0]), (two, b_counts, sides[1])):
            own = counts[codes]
            raw = ids[_ranges((np.cumsum(counts) - counts)[codes], own)].tobytes()
            places = (np.concatenate([[0], np.cumsum(own)])[edges] * ids.itemsize).tolist()
            for k, lo, hi in zip(owners, places, places[1:]):
                out[k].append(raw[lo:hi])
        held.clear()
        owners.clear()
        numbers.clear()

    size = 0
    for k, text in enumerate(texts):
        for part in _stretches(text) if text else ():
            words = _words(part)
            held += words
            owners.append(k)
            numbers.append(len(words))
            size += len(part)
            if size >= STRETCH:
                flush()
                size = 0
    if held:
        flush()
    return tuple([b"" if k in failed else b"".join(x) for k, x in enumerate(side)] for side in sides)


def encoded(docs: DataFrame, a: str, b: str) -> DataFrame:
    """__row, doc_id, a and b (binary, little-endian ids of both sides) of every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = _models(a, b)
        for batch in batches:
            one, two = encode(models, batch["text"].tolist())
            yield pd.DataFrame({ROW: batch[ROW], "doc_id": batch["doc_id"], "a": one, "b": two})

    # as a string, which keeps long ids beside null ones whole in pandas
    rows = numbered(docs, F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInPandas(run, f"{ROW} long, doc_id string, a binary, b binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


class IntervalIndex:
    """Byte intervals of tokens that follow one another, given by their ends; static."""

    def __init__(self, ends: np.ndarray):
        self.ends = ends
        self.starts = np.concatenate([[0], ends[:-1]])

    def stabbed(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First interval that each query [start, end) overlaps, and the first behind it that it does not."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens that tile the same bytes: first and end of the tokens of B that each token of A overlaps, and the group of each token of B."""
    first, end = IntervalIndex(b_ends).stabbed(np.concatenate([[0], a_ends[:-1]]), a_ends)
    spans = np.zeros(len(b_ends) + 1, dtype=np.int64)
    np.add.at(spans, first, 1)
    np.add.at(spans, end - 1, -1)
    free = np.cumsum(spans[:-1]) == 0  # no token of A reaches over the gap behind this token of B
    return first, end, np.cumsum(free) - free


class _Stretch:
    """Aligned tokens of a run of documents, or of a part of one."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray):
        self.a, self.b, self.b_ids = a, b, len(b_size)
        self.a_ends, self.b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        self.first, self.end, self.b_group = overlaps(self.a_ends, self.b_ends)
        self.a_group = self.b_group[self.first] if len(a) else self.b_group

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in A, pair of ids) of every link."""
        n = self.end - self.first
        at = np.repeat(np.arange(len(self.a)), n)
        return at, self.a[at].astype(np.int64) * self.b_ids + self.b[_ranges(self.first, n)]

    def written(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of all tokens in the order of groups, A before B, each with the mark that follows it; places of the tokens of A."""
        a_last = np.append(self.a_group[1:] != self.a_group[:-1], True)
        b_last = np.append(self.b_group[1:] != self.b_group[:-1], True)
        a_at = np.arange(len(self.a)) + np.searchsorted(self.b_group, self.a_group, "left")
        b_at = np.arange(len(self.b)) + np.searchsorted(self.a_group, self.b_group, "right")
        out = np.empty(len(self.a) + len(self.b), dtype=names.dtype)
        out[a_at] = names[np.where(a_last, 1, 0), self.a]
        out[b_at] = names[np.where(b_last, 2, 0), self.b]
        return out, a_at


def _cuts(a_ends: np.ndarray, b_ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) at which stretches of about most tokens of A end: where tokens of both sides end."""
    out, lo = [], 0
    while len(a_ends) - lo > most:
        at = lo + most
        while at < len(a_ends):
            k = int(np.searchsorted(b_ends, a_ends[at - 1]))
            if b_ends[k] == a_ends[at - 1]:
                out.append((at, k + 1))
                break
            at += 1
        lo = at
    return [*out, (len(a_ends), len(b_ends))]


class _Aligner:
    """Documents of a batch as stretches with their owners."""

    def __init__(self, a: str, b: str):
        models = _models(a, b)
        self.kind, self.a_size, self.b_size = models.kind, models.a_size, models.b_size

    def stretches(self, one: list[bytes], two: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, _Stretch]]:
        """(documents, the places in A where each begins, stretch). Short documents share one, a long one has several to itself."""
        held: list[int] = []
        size, width = 0, np.dtype(self.kind).itemsize
        for k in range(len(one) + 1):
            n = len(one[k]) // width if k < len(one) else 0
            if held and (k == len(one) or size + n > TOKENS):
                a, b = (np.frombuffer(b"".join([x[i] for i in held]), dtype=self.kind) for x in (one, two))
                starts = np.cumsum([0, *(len(one[i]) // width for i in held)])[:-1]
                if size <= TOKENS:
                    yield held, starts, _Stretch(a, b, self.a_size, self.b_size)
                else:
                    i = j = 0
                    for p, q in _cuts(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), TOKENS):
                        yield held, np.zeros(1, dtype=np.int64), _Stretch(a[i:p], b[j:q], self.a_size, self.b_size)
                        i, j = p, q
                held, size = [], 0
            if n:
                held.append(k)
                size += n

    def pairs(self, one: list[bytes], two: list[bytes], seen: Callable = lambda owners, starts, part: None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, links) of the distinct pairs of each document; those of a document come together. seen is called with every stretch."""
        last: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for owners, starts, part in self.stretches(one, two):
            seen(owners, starts, part)
            at, pair = part.links()
            owner = np.searchsorted(starts, at, "right") - 1
            most = len(self.a_size) * len(self.b_size)
            both, n = np.unique(owner * most + pair, return_counts=True)
            found = np.array(owners)[both // most], both % most, n
            if last and last[0][0][0] != owners[0]:
                yield _merged(last)
                last = []
            last.append(found)
            if len(last) > 16:
                last = [_merged(last)]
        if last:
            yield _merged(last)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of one stretch, or of the stretches of one document, as one."""
    if len(parts) == 1:
        return parts[0]
    pair, at = np.unique(np.concatenate([p for _, p, _ in parts]), return_inverse=True)
    links = np.zeros(len(pair), dtype=np.int64)
    np.add.at(links, at, np.concatenate([n for _, _, n in parts]))
    return np.full(len(pair), parts[0][0][0]), pair, links


def _sums(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return pair, np.bincount(at, weights=np.concatenate(counts), minlength=len(pair)).astype(np.int64)


def pair_counts(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """pair (id of A times the ids of B, plus id of B), n (documents that hold it linked) and best (n is the greatest of its id of A)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _Aligner(a, b)
        pairs: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for _, pair, _ in aligner.pairs(batch["a"].tolist(), batch["b"].tolist()):
                pair, n = np.unique(pair, return_counts=True)
                pairs.append(pair)
                counts.append(n)
                if sum(map(len, pairs)) > HELD_PAIRS:
                    pair, n = _sums(pairs, counts)
                    pairs, counts = [pair], [n]
                    if len(pair) > HELD_PAIRS // 2:
                        yield pd.DataFrame({"pair": pair, "n": n})
                        pairs, counts = [], []
        if pairs:
            pair, n = _sums(pairs, counts)
            yield pd.DataFrame({"pair": pair, "n": n})

    found = tokens.select("a", "b").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = pinned(found.withColumn("a", F.expr(f"pair div {len(_Aligner(a, b).b_size)}")), "pairs")
    most = found.groupBy("a").agg(F.max("n").alias("most"))
    return found.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str, shared_pairs: int = SHARED_PAIRS) -> DataFrame:
    """__row (of numbered(docs)), doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs.

    a: path of a byte-level vocabulary for ``tokenizers``; b: path of a ``sentencepiece`` model.
    """
    tokens = pinned(encoded(docs, a, b), "tokens", compression="zstd")
    counts = pinned(pair_counts(tokens, a, b), "pair_counts")
    floor, shared = greatest(counts, "n", shared_pairs)
    top = shared.toArrow().to_pandas().sort_values("pair")
    known = docs.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _Aligner(a, b)
        keys, numbers, bests = known.value
        top_id = max(len(aligner.a_size), len(aligner.b_size))
        names = np.array([[f"{k}{mark}" for k in range(top_id)] for mark in ",|;"], dtype=bytes)
        for batch in batches:
            one, two = batch["a"].tolist(), batch["b"].tolist()
            size = len(one)
            n_groups, n_links, n_best, total = (np.zeros(size, dtype=np.int64) for _ in range(4))
            digests = [hashlib.sha256() for _ in range(size)]
            pending: dict[int, bytes] = {}

            def seen(owners: list[int], starts: np.ndarray, part: _Stretch) -> None:
                own = np.array(owners)
                bounds = np.append(starts, len(part.a))
                np.add.at(n_links, own, np.add.reduceat(part.end - part.first, starts))
                np.add.at(n_groups, own, part.a_group[bounds[1:] - 1] - part.a_group[starts] + 1)
                marks, a_at = part.written(names)
                edges = np.append(a_at[starts], len(marks)).tolist()
                for k, lo, hi in zip(owners, edges, edges[1:]):
                    said = pending.pop(k, b"") + marks[lo:hi].tobytes().translate(None, b"\0")
                    digests[k].update(said[:-1])  # the mark behind the last group waits for another stretch
                    pending[k] = b";"

            rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for owner, pair, links in aligner.pairs(one, two, seen):
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                hit = keys[at] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
                np.add.at(n_best, owner[hit], links[hit] * bests[at[hit]])
                np.add.at(total, owner[hit], links[hit] * numbers[at[hit]])
                rare.append((owner[~hit], pair[~hit], links[~hit]))
            width = np.dtype(aligner.kind).itemsize
            rows = batch[ROW].to_numpy()
            yield pd.DataFrame({
                ROW: rows, "doc_id": batch["doc_id"], "n_a": [len(x) // width for x in one], "n_b": [len(x) // width for x in two], "n_groups": n_groups, "n_links": n_links,
                "groups_sha256": [d.hexdigest() if x else "" for d, x in zip(digests, one)], "pair": -1 - rows, "links": 0, "n_best": n_best, "count_sum": total,
            })
            for owner, pair, links in rare:
                for lo in range(0, len(pair), 50_000):
                    hi = lo + 50_000
                    yield pd.DataFrame({ROW: rows[owner[lo:hi]], "doc_id": None, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pair": pair[lo:hi], "links": links[lo:hi], "n_best": 0, "count_sum": 0})

    sides = tokens.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, f"{ROW} long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, links long, n_best long, count_sum long")
    met = sides.join(counts.where(F.col("n") < F.lit(floor)), "pair", "left")
    best = F.col("n_best") + F.when(F.col("best"), F.col("links")).otherwise(0)
    weight = F.col("count_sum") + F.col("links") * F.coalesce("n", F.lit(0))
    most = [F.max(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return met.groupBy(ROW).agg(F.max("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *most, F.sum(best).alias("n_best"), F.sum(weight).alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
