"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "__row"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or a new local one where that is unset and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def pinned(df: DataFrame, name: str, release: bool = False, compression: str | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: lineage ends here.

    release: large shuffles lie behind the table. They are needless now, and Spark drops
    them from the executors' disks once the driver has collected its garbage.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if release:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 4000) -> None:
    """Fewer rows of text to a batch between Spark and Python than Spark's default for narrow rows, unless the session has its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def settled(df: DataFrame) -> DataFrame:
    """df, written first if its rows pass a shuffle, so that they come in the same order each time."""
    return pinned(df, "rows") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def numbered(df: DataFrame, *columns: str | Column) -> DataFrame:
    """columns of df behind a row number ``__row``.

    doc_id may be null or repeated, so operators join on this number instead. It
    depends on the scan's splits alone. A df whose rows pass a shuffle could come in
    another order when a lost part is computed again, so it is written first.
    """
    rows = settled(df.select(*columns))
    return rows.select(F.monotonically_increasing_id().alias(ROW), "*")


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose number, as :func:`numbered` gives it, is in gone (__row); columns may have any name."""
    own = [(c, f"column_{k}") for k, c in enumerate(docs.columns)]
    rows = numbered(docs, *(F.col(f"`{c.replace('`', '``')}`").alias(name) for c, name in own))
    return rows.join(gone, ROW, "left_anti").select(*(F.col(name).alias(c) for c, name in own))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def greatest(df: DataFrame, column: str, most: int) -> tuple[float, DataFrame]:
    """(floor, rows of df whose positive column is no less), at most ``most`` rows: the floor is set by counts per sixteenth of an octave, so no rows are sorted."""
    octave = F.floor(F.log2(column) * 16).cast("int")
    floor, total = float("inf"), 0
    for x in df.where(F.col(column) > 0).groupBy(octave.alias("k")).agg(F.count("*").alias("size"), F.min(column).alias("least")).orderBy(F.desc("k")).collect():
        total += x["size"]
        if total > most:
            break
        floor = float(x["least"])
    return floor, df.where(F.col(column) >= F.lit(floor))
