"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and runs of anything else become one blank; n-grams of 1 to
``MOST`` characters are hashed into ``BUCKETS`` buckets. Training counts the buckets per
language over a bounded sample of labelled rows (``SAMPLE_ROWS`` rows of least hash of
doc_id), as partial sums per task; the log-probability matrix (buckets x languages) has a
size fixed by these parameters and the number of languages, which is checked, and is
broadcast. Scoring sums the matrix over the n-grams of whole texts, batch by batch.

A text that is null or has no letter is ``und`` with score 0, as is every text if nothing
could be learned. The score is the posterior probability of the predicted language; of
equal ones the language that sorts first counts. doc_id may be null (such rows are neither
held out nor learned from) or repeated: every row is judged by itself. Other columns stay
as they are, but for those named held_out, lang_pred or score, which the results replace.
Long texts are hashed in slices, and no n-gram counts twice. An empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ROW, numbered

BUCKETS = 1 << 16
#: Longest n-gram.
MOST = 4
#: Labelled rows that are learned from, at most.
SAMPLE_ROWS = 20_000
#: Languages that a model may have.
MOST_LANGUAGES = 1000
#: Characters of texts that are hashed at once.
BLOCK = 1 << 19

_OTHER = re.compile(r"[\W\d_]+")
_STEP = np.uint32(0x9E3779B1)


def letters(text: str | None) -> str:
    """The text's letters in lower case, with one blank for each run of anything else; empty if it has none."""
    kept = _OTHER.sub(" ", text).strip() if text else ""
    return f" {kept.lower()} " if any(map(str.isalpha, kept)) else ""


def _grams(text: str) -> list[np.ndarray]:
    """Buckets of the n-grams of a text, by n; the one at place k starts at character k."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h, out = np.zeros(len(code), dtype=np.uint32), []
    for n in range(1, MOST + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * _STEP
        h ^= h >> np.uint32(15)
        out.append(((h + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(16))
    return out


def _pieces(text: str) -> Iterator[tuple[str, int]]:
    """A text in slices of ``BLOCK`` characters, each with the characters that its last n-grams reach into, and the number of its own."""
    for lo in range(0, max(1, len(text)), BLOCK):
        yield text[lo : lo + BLOCK + MOST - 1], min(BLOCK, len(text) - lo)


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (buckets x languages; the last row is the prior) from rows (doc_id, text, lang)."""
    labelled = numbered(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), "doc_id", "text", "lang")
    chosen = labelled.select(ROW, "doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", ROW).limit(sample_rows).select(ROW)
    sample = labelled.join(F.broadcast(chosen), ROW, "left_semi").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                kept = letters(text)
                if not kept:
                    continue
                own = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for piece, size in _pieces(kept):
                    for g in _grams(piece):
                        own += np.bincount(g[:size], minlength=BUCKETS)
        for lang, own in total.items():
            yield pd.DataFrame({"lang": lang, "counts": [own.tolist()], "docs": docs[lang]})

    parts = sample.mapInPandas(count, "lang string, counts array<long>, docs long")
    added = parts.select("lang", "docs", F.posexplode("counts").alias("bucket", "n")).where("n > 0")
    sums = added.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sizes = {x["lang"]: x["docs"] for x in parts.groupBy("lang").agg(F.sum("docs").alias("docs")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is lang a language column?")
    names = sorted(sizes)
    counts = np.zeros((BUCKETS, len(names)))
    at = {n: k for k, n in enumerate(names)}
    for x in sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).toLocalIterator():
        cells = np.array([(c["bucket"], c["n"]) for c in x["cells"]], dtype=np.int64)
        counts[cells[:, 0], at[x["lang"]]] = cells[:, 1]
    smooth = counts + 0.5
    prior = np.array([[sizes[n] for n in names]], dtype=float)
    return names, np.vstack([np.log(smooth / smooth.sum(axis=0)), np.log(prior / max(prior.sum(), 1))]).astype(np.float32)


def classify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """All columns of docs with lang_pred and score; columns of these names are replaced."""
    names, matrix = model
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))

    def scores(texts: list[str]) -> np.ndarray:
        logs = shared.value
        out = np.tile(logs[:, -1].astype(float), (len(texts), 1))
        block: list[str] = []
        owner: list[int] = []
        own: list[int] = []

        def flush() -> None:
            joined = "".join(block)
            ends = np.cumsum([len(x) for x in block])
            edges = np.concatenate([[0], ends[:-1]])
            for n, g in enumerate(_grams(joined), 1):
                # an n-gram that crosses into the next slice, or that belongs to it, counts for none
                last = np.minimum(edges + own, ends - n + 1)
                foreign = np.concatenate([np.arange(max(a, b), c) for a, b, c in zip(last.tolist(), edges.tolist(), ends.tolist())])
                foreign = foreign[foreign < len(g)]
                inside = edges < len(g)
                for k in range(len(names)):
                    worth = logs[k][g]
                    worth[foreign] = 0
                    np.add.at(out, (np.array(owner)[inside], k), np.add.reduceat(worth, edges[inside], dtype=float))

        size = 0
        for i, text in enumerate(texts):
            for piece, number in _pieces(text) if text else ():
                block.append(piece)
                owner.append(i)
                own.append(number)
                size += len(piece)
                if size >= BLOCK:
                    flush()
                    block.clear()
                    owner.clear()
                    own.clear()
                    size = 0
        if block:
            flush()
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [letters(t) for t in batch["text"]]
            known = np.array([bool(t) and bool(names) for t in texts], dtype=bool)
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if known.any():
                logs = scores(texts)
                best = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                lang[known] = np.array(names, dtype=object)[best[known]]
                score[known] = np.clip(share[known], 0, 1)
            yield batch.assign(lang_pred=lang, score=score)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return docs.mapInPandas(run, schema)


def held_out() -> F.Column:
    """True for the third of the documents that the model may not learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of docs with held_out, lang_pred and score, learned from text and lang of the rows that are not held out."""
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"), sample_rows)
    return classify(docs.withColumn("held_out", held_out()), model)
