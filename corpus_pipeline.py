"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last keep the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, language_id, near_copies, packing, pii
from gridloom.llm.common import ROW, documents, pinned, settled, text_batches, without_rows
from gridloom.llm.queries import tokenizer_file

#: Least posterior of a document's language.
SURE = 0.5
#: Words whose ids a worker keeps; the workers serve all stages, so they keep less than for packing alone.
CACHED_WORDS = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang takes the predicted value where it was null."""
    text_batches(spark)
    known = language_id.identify(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near copies: a Jaccard similarity of 0.8 or more over 5-word shingles links two."""
    text_batches(spark)
    return near_copies.keep_first(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    text_batches(spark)
    docs = settled(docs)
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where(F.size("hits") > 0).select(ROW)
    return without_rows(docs, hit)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the kind in brackets."""
    text_batches(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    text_batches(spark)
    return packing.pack_documents(docs, tokenizer_file(), literal=False, cached_words=CACHED_WORDS)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Fingerprints, models and tokenisers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
