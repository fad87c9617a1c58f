"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

1. Words (runs of word characters, lower-cased) are framed by marks; each character is
   predicted by the ``ORDER - 1`` before it in its word. Tasks count these n-grams per
   class over the labelled rows (``SAMPLE_ROWS`` of least hash of doc_id at most), and note
   the n-grams of all other texts that may be learned from.
2. Each class has its own counts of the longest n-grams, absolutely discounted. Both back
   off to the same lower orders, continuation counts over the whole corpus: in how many
   different contexts an n-gram stands. An expression that is rare in a class is so
   smoothed by what the corpus shares, and differs between classes only by what they saw.
   All of this is joins and sums of n-gram tables (:func:`log_ratios`).
3. The log-likelihood ratio of a word is the sum of those of its characters. Where a class
   pair saw the context but not the n-gram, the shared part cancels and a weight of the
   context is left. The weights that matter most, ``MODEL_GRAMS`` at most, are broadcast.
4. A text's evidence is length-normalised: its mean log-likelihood ratio per character,
   and the logarithms of the shares of words whose ratio stands out, by four margins, which
   keeps a few telling words from drowning in a long text. Shares are smoothed, so a short
   text needs more to stand out. A logistic curve turns evidence into a score; it is fitted on at most
   ``FITTED_ROWS`` labelled rows, each scored by models that have not seen its half of the
   rows.

Null and empty texts, and texts without words, have the evidence of no word; they get the
score of an empty text, as everything does if nothing could be learned. doc_id may be null
(such rows are neither held out nor learned from) or repeated, in labels too (toxic if any
row of it says so; a null label says nothing). Long texts are read whole, in slices of rows.
Other columns stay as they are, but for those named held_out, score or predicted, which the
results replace. An empty table stays empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ROW, greatest, numbered, pinned
from gridloom.llm.language_id import held_out

#: Characters of the longest n-gram, marks included.
ORDER = 6
#: Taken off every count and given to the order below.
DISCOUNT = 0.75
#: Labelled rows that are counted, and that the curve is fitted on, at most.
SAMPLE_ROWS, FITTED_ROWS = 100_000, 20_000
#: Weights of the model, at most.
MODEL_GRAMS = 1 << 19
#: (margin, width): a word stands out by what its log-likelihood ratio has beyond the margin, wholly from the width on.
PEAKS = ((1.5, 3.0), (2.5, 2.0), (3.5, 1.5), (4.5, 1.0))
#: Added to the words that stand out, and to all words, before their share is taken.
PRIOR = (0.3, 30.0)
#: Least score of a document that is predicted toxic.
THRESHOLD = 0.7
#: Characters of texts that are scored at once.
BLOCK = 1 << 21

_WORD = re.compile(r"\w+")
_FIRST, _LAST = "\x02", "\x03"
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _grams(word: str) -> list[str]:
    framed = _FIRST + word + _LAST
    return [framed[max(0, k - ORDER) : k] for k in range(2, len(framed) + 1)]


def gram_counts(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """gram, t0, t1, o0, o1: how often it stands in toxic (t) and ordinary (o) rows of either half of the sample (__row, toxic, half); zeros for n-grams of other rows of (__row, text) alone."""
    chosen = sample.toArrow().to_pandas().sort_values(ROW)
    known = rows.sparkSession.sparkContext.broadcast((chosen[ROW].to_numpy(), (chosen["half"] + np.where(chosen["toxic"] > 0, 0, 2)).to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, classes = known.value
        words: list[Counter] = [Counter() for _ in range(5)]
        for batch in batches:
            at = np.searchsorted(numbers, batch[ROW])
            kind = [int(classes[k]) if k < len(numbers) and numbers[k] == row else 4 for k, row in zip(at.tolist(), batch[ROW])]
            for k, text in zip(kind, batch["text"]):
                words[k].update(_WORD.findall(text.lower()))
        total: dict[str, list[int]] = {}
        for k, counts in enumerate(words):
            for word, n in counts.items():
                for gram in _grams(word):
                    own = total.get(gram)
                    if own is None:
                        own = total[gram] = [0, 0, 0, 0, 0]
                    own[k] += n
        grams = list(total)
        for lo in range(0, len(grams), 100_000):
            part = grams[lo : lo + 100_000]
            n = np.array([total[g] for g in part], dtype=np.int64)
            yield pd.DataFrame({"gram": part, "t0": n[:, 0], "t1": n[:, 1], "o0": n[:, 2], "o1": n[:, 3]})

    found = rows.select(ROW, F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "gram string, t0 long, t1 long, o0 long, o1 long")
    return found.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "o0", "o1")))


def _context() -> F.Column:
    return F.expr("substring(gram, 1, length(gram) - 1)")


def _suffix() -> F.Column:
    return F.expr("substring(gram, 2)")


def shared_backoff(grams: DataFrame) -> DataFrame:
    """gram and q: the interpolated Kneser-Ney probability of its last character after the others, from continuation counts of the n-grams in grams, for all their proper suffixes."""
    suffixes = F.explode(F.expr("transform(sequence(1, length(gram) - 1), k -> substring(gram, k))"))
    seen = grams.select(suffixes.alias("gram")).distinct()
    counts = seen.select(_suffix().alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).withColumn("context", _context())
    sums = counts.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    counts = pinned(counts.join(sums, "context").withColumn("size", F.length("gram")), "continuations")
    kept = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")
    given = F.lit(DISCOUNT) * F.col("kinds") / F.col("total")
    levels = [pinned(counts.where("size = 1").select("gram", (kept + given / (F.col("kinds") + 1)).alias("q")), "backoff")]
    for size in range(2, ORDER):
        below = levels[-1].withColumnRenamed("gram", "suffix")
        own = counts.where(F.col("size") == size).withColumn("suffix", _suffix()).join(below, "suffix")
        levels.append(pinned(own.select("gram", (kept + given * F.col("q")).alias("q")), "backoff"))
    return reduce(DataFrame.unionByName, levels)


def log_ratios(grams: DataFrame) -> DataFrame:
    """gram, w, w0, w1 and worth: log-likelihood ratios by all rows of the sample, by half 1 alone (w0) and by half 0 alone (w1). A context has that of any character that neither class saw behind it, under its own text and a mark."""
    low = shared_backoff(grams)
    sides = {"w": (F.col("t0") + F.col("t1"), F.col("o0") + F.col("o1")), "w0": (F.col("t1"), F.col("o1")), "w1": (F.col("t0"), F.col("o0"))}
    counted = pinned(grams.where("t0 + t1 + o0 + o1 > 0").withColumn("context", _context()).withColumn("suffix", _suffix()), "counted")
    sums = [f(c).alias(f"{name}{k}{mark}") for name, pair in sides.items() for k, c in enumerate(pair) for f, c, mark in ((F.sum, c, "total"), (F.sum, (c > 0).cast("long"), "kinds"))]
    contexts = pinned(counted.groupBy("context").agg(*sums), "contexts")

    def given(name: str, k: int) -> F.Column:
        total, kinds = F.col(f"{name}{k}total"), F.col(f"{name}{k}kinds")
        return F.when(total > 0, F.lit(DISCOUNT) * kinds / total).otherwise(1.0)

    def likelihood(name: str, k: int) -> F.Column:
        total = F.col(f"{name}{k}total")
        own = F.greatest(sides[name][k] - DISCOUNT, F.lit(0.0)) / total
        return F.when(total > 0, own + given(name, k) * F.col("q")).otherwise(F.col("q"))

    unseen = {name: F.log(given(name, 0)) - F.log(given(name, 1)) for name in sides}
    whole = counted.join(contexts, "context").join(low.withColumnRenamed("gram", "suffix"), "suffix")
    number = F.col("t0") + F.col("t1") + F.col("o0") + F.col("o1")
    ratios = whole.select("gram", *((F.log(likelihood(n, 0)) - F.log(likelihood(n, 1))).alias(n) for n in sides), (F.abs(F.log(likelihood("w", 0)) - F.log(likelihood("w", 1)) - unseen["w"]) * number).alias("worth"))
    # a context that many n-grams fall back to is worth more than any of them
    rest = contexts.select(F.concat("context", F.lit("\x00")).alias("gram"), *(x.alias(n) for n, x in unseen.items()), (F.abs(unseen["w"]) * F.col("w0kinds")).alias("worth"))
    return ratios.unionByName(rest)


def _extended(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    mixed = (keys ^ codes) * _STEP
    return mixed ^ (mixed >> np.uint64(29))


def _keys(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """64-bit keys of the first size characters from each start."""
    out = np.full(len(starts), _SEED, dtype=np.uint64)
    for k in range(size):
        out = _extended(out, codes[starts + k])
    return out


def keys_of(grams: list[str]) -> np.ndarray:
    """64-bit keys of texts."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(len(grams), dtype=np.uint64)
    for size in np.unique(sizes).tolist():
        own = sizes == size
        out[own] = _keys(codes, starts[own], size)
    return out


class Model:
    """Weights of n-grams and of contexts under sorted keys, and the sums of words by them."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def sums(self, words: list[str], which: int = 0) -> np.ndarray:
        """Log-likelihood ratio of each word, by the weights of one column."""
        if not len(self.keys) or not words:
            return np.zeros(len(words))
        framed = [_FIRST + w + _LAST for w in words]
        codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        sizes = np.array([len(w) for w in framed], dtype=np.int64)
        own = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place in the word
        ends = np.flatnonzero(own > 0)
        before = np.minimum(own[ends], ORDER - 1)
        context, gram = np.zeros(len(ends), dtype=np.uint64), np.zeros(len(ends), dtype=np.uint64)
        for size in np.unique(before).tolist():
            at = before == size
            context[at] = _keys(codes, ends[at] - size, size)
            gram[at] = _extended(context[at], codes[ends[at]])
        hit, at = self._found(gram)
        out = np.where(hit, self.weights[at, which], 0.0)
        missed = np.flatnonzero(~hit)
        hit, at = self._found(_extended(context[missed], np.zeros(len(missed), dtype=np.uint64)))
        out[missed] = np.where(hit, self.weights[at, which], 0.0)
        return np.add.reduceat(out, np.searchsorted(ends, np.cumsum(sizes) - sizes))

    def evidence(self, texts: list[str], which: int = 0) -> np.ndarray:
        """Per text: logarithm of the number of words, of the share of words that stand out by each of ``PEAKS``, mean log-likelihood ratio per character."""
        totals = np.zeros((len(texts), 2 + len(PEAKS)))  # sum of ratios, characters, words that stand out
        words = np.zeros(len(texts), dtype=np.int64)
        held: list[str] = []
        numbers: list[int] = []
        owners: list[int] = []

        def flush() -> None:
            codes, distinct = pd.factorize(np.array(held, dtype=object))
            distinct = distinct.tolist()
            ratio = self.sums(distinct, which)
            sizes = np.array([len(w) + 1 for w in distinct], dtype=float)
            edges = (np.cumsum(numbers) - numbers).tolist()
            for k, x in enumerate([ratio, sizes, *(np.clip((ratio - m) / width, 0, 1) for m, width in PEAKS)]):
                np.add.at(totals, (owners, k), np.add.reduceat(x[codes], edges))
            np.add.at(words, owners, numbers)
            held.clear()
            numbers.clear()
            owners.clear()

        size = 0
        for k, text in enumerate(texts):
            for part in _slices(text):
                found = _WORD.findall(part.lower())
                if found:
                    held += found
                    numbers.append(len(found))
                    owners.append(k)
                    size += len(part)
                if size >= BLOCK:
                    flush()
                    size = 0
        if held:
            flush()
        shares = np.log((totals[:, 2:] + PRIOR[0]) / (words[:, None] + PRIOR[1]))
        return np.c_[np.log1p(words), shares, totals[:, 0] / np.maximum(totals[:, 1], 1)]


def _slices(text: str) -> Iterator[str]:
    """A text in slices of about ``BLOCK`` characters that end at blanks."""
    lo = 0
    while len(text) - lo > BLOCK:
        hi = text.find(" ", lo + BLOCK)
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi
    yield text[lo:] if lo else text


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(key=keys_of(batch["gram"].tolist()).view(np.int64))[["key", "w", "w0", "w1"]]


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, penalty: float = 1e-3) -> Callable[[np.ndarray], np.ndarray]:
    """Logistic regression by Newton's steps; without both classes, their share."""
    if len(np.unique(toxic)) < 2:
        share = float(toxic.mean()) if len(toxic) else 0.0
        return lambda x: np.full(len(x), share)
    mean, spread = evidence.mean(axis=0), evidence.std(axis=0) + 1e-9
    extended = np.c_[(evidence - mean) / spread, np.ones(len(evidence))]
    held = np.append(np.full(evidence.shape[1], penalty * len(evidence)), 0.0)
    beta = np.zeros(extended.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(extended @ beta, -30, 30)))
        slope = extended.T @ (p - toxic) + held * beta
        beta = beta - np.linalg.solve((extended * (p * (1 - p))[:, None]).T @ extended + np.diag(held + 1e-9), slope)
    return lambda x: 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / spread, np.ones(len(x))] @ beta, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, model_grams: int = MODEL_GRAMS) -> tuple[Model, Callable[[np.ndarray], np.ndarray]]:
    """Model and curve from the text of docs (doc_id, text) and the labels (doc_id, toxic) of some of them."""
    rows = numbered(docs, "doc_id", "text")
    toxic = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = rows.select(ROW, "doc_id").join(toxic, "doc_id").withColumn("hash", F.xxhash64("doc_id"))
    chosen = marked.orderBy("hash", ROW).limit(sample_rows).select(ROW, "toxic", (F.pmod("hash", F.lit(2))).cast("int").alias("half"), "hash")
    sample = pinned(chosen, "sample")
    grams = pinned(gram_counts(rows, sample.select(ROW, "toxic", "half")), "grams")
    ratios = greatest(pinned(log_ratios(grams), "ratios"), "worth", model_grams)[1].select("gram", "w", "w0", "w1")
    weights = ratios.mapInPandas(_keyed, "key long, w float, w0 float, w1 float").toArrow().to_pandas()
    model = Model(weights["key"].to_numpy().view(np.uint64), weights[["w", "w0", "w1"]].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for half in (0, 1):
                own = batch[batch["half"] == half]
                found = shared.value.evidence(own["text"].tolist(), 1 + half)
                out.append(pd.DataFrame({"toxic": own["toxic"].to_numpy(), "evidence": found.tolist()}))
            yield pd.concat(out)

    # in the order of the hash, so that both halves and all sources are among the first rows
    some = sample.orderBy("hash", ROW).limit(FITTED_ROWS).select(ROW, "toxic", "half")
    judged = rows.select(ROW, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), ROW).mapInPandas(run, "toxic int, evidence array<double>").toArrow().to_pandas()
    evidence = np.array(judged["evidence"].tolist()).reshape(len(judged), 2 + len(PEAKS))
    return model, fit_curve(evidence, (judged["toxic"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model, curve: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """All columns of docs with score and predicted; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.round(curve(shared.value.evidence([t or "" for t in batch.column(place).to_pylist()])), 12)
            yield batch.append_column("score", pa.array(own)).append_column("predicted", pa.array((own >= THRESHOLD).astype(np.int32)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"
    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of docs with held_out, score and predicted, learned from the labels (doc_id, toxic) of rows that are not held out."""
    model, curve = train(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text"), labels.select("doc_id", "toxic"), sample_rows)
    return score(docs.withColumn("held_out", held_out()), model, curve)
