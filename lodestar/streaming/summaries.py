"""Summaries of appended records, kept up to date by a stream instead of read anew.

Each micro-batch leaves the sums of its records, a row for each combination of behaviour, case type, profile and parse mode, in a folder
of its own number. A batch that is run again, after a failure, overwrites its own folder, so it counts once. Every ``merge`` batches all
sums so far are added up in one folder; sums of earlier batches are not read from then on, and a batch that they hold is
not written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rollup

MERGE = 100
SCHEMA = ", ".join([*(f"{d} string" for d in rollup.DIMS), "n long", *(f"{k} long" for k in rollup.KEYS), *(f"{k} double" for k in rollup.MEANS), "level int", "batch long"])


def sums(records: DataFrame) -> DataFrame:
    """The mergeable part of a summary: counts and totals of each combination."""
    true, total = (lambda k: F.count_if(F.coalesce(F.col(k), F.lit(False)))), (lambda c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    return records.groupBy(*rollup.DIMS).agg(F.count("*").alias("n"), *(true(k).alias(k) for k in rollup.KEYS), *(total(c).alias(k) for k, c in rollup.MEANS.items()))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*rollup.DIMS).agg(*(F.sum(c).alias(c) for c in ("n", *rollup.KEYS, *rollup.MEANS)))


def _upto(spark: SparkSession, path: str) -> int:
    """The last batch that merged sums hold; -1 before there are any. Reads folder names only."""
    folders = spark.read.schema(SCHEMA).option("basePath", path).parquet(path)
    found = folders.where("level = 1").agg(F.max("batch")).head()[0]
    return -1 if found is None else found


def kept_sums(spark: SparkSession, path: str) -> DataFrame:
    """The sums of all batches, each once."""
    upto = _upto(spark, path)
    parts = spark.read.schema(SCHEMA).option("basePath", path).parquet(path)
    return merged(parts.where((F.col("level") == 1) & (F.col("batch") == upto) | (F.col("level") == 0) & (F.col("batch") > upto)))


def apply_batch(records: DataFrame, batch: int, path: str, merge: int = MERGE) -> None:
    """Adds one batch by its number; again with the same number, it changes nothing."""
    spark = records.sparkSession
    if batch and batch <= _upto(spark, path):
        return
    sums(records).coalesce(1).write.mode("overwrite").parquet(f"{path}/level=0/batch={batch}")
    if batch % merge == merge - 1:
        kept_sums(spark, path).coalesce(1).write.mode("overwrite").parquet(f"{path}/level=1/batch={batch}")


def keep_summary(records: DataFrame, path: str, checkpoint: str, *, merge: int = MERGE, available_now: bool = True) -> StreamingQuery:
    """Keeps the sums of a stream of records under ``path``."""
    writer = records.writeStream.foreachBatch(lambda df, batch: apply_batch(df, batch, path, merge)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def summary(spark: SparkSession, path: str) -> DataFrame:
    """``rollup.summary`` of all records so far, from the kept sums."""
    parts = kept_sums(spark, path)
    n = F.sum("n")
    rates = [(F.sum(k) / n).alias(f"{k}_rate") for k in rollup.KEYS]
    return rollup.by_levels(parts, [F.coalesce(n, F.lit(0)).alias("n"), *rates, *((F.sum(k) / n).alias(k) for k in rollup.MEANS)])
