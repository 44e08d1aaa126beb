"""The folder of an evaluation run: its arguments, its cases, one JSON line a record, and the summary."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import run_slug
from .directory import read_json_array, read_jsonl

#: What lies in the folder of a run.
ARGS, SPECS, RECORDS, SUMMARY = "args.json", "generated_specs.json", "records.jsonl", "summary.json"
FILE_ROWS = 100_000  # of a compressed file, which one task reads as a whole


def run_name(spark: SparkSession, parts: list[str]) -> str:
    """The parts of a run's name, each made fit for a folder, joined by two underscores."""
    made = spark.range(1).select(*(run_slug(F.lit(p)).alias(f"p{i}") for i, p in enumerate(parts))).head()
    return "__".join(made)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One small JSON value as one file; a file of that name is replaced."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray((json.dumps(value, indent=2, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """The one JSON object of a small file."""
    return json.loads(spark.read.text(path, wholetext=True).head()[0])


def write_run(path: str, args: dict, specs: DataFrame, records: DataFrame, summary: dict) -> None:
    """A run's folder. Cases and records are folders of gzipped JSON lines, written by the tasks that hold them."""
    spark = records.sparkSession
    write_json(spark, f"{path}/{ARGS}", args)
    for df, name in ((specs, SPECS), (records, RECORDS)):
        df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).json(f"{path}/{name}", ignoreNullFields=False, compression="gzip")
    write_json(spark, f"{path}/{SUMMARY}", summary)


def read_run(spark: SparkSession, path: str, records: str) -> tuple[dict, DataFrame]:
    """(summary, records) of a run's folder; ``records`` is their schema."""
    return read_json(spark, f"{path}/{SUMMARY}"), read_jsonl(spark, f"{path}/{RECORDS}", records)


def load_or_generate(spark: SparkSession, path: str | None, schema: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Cases from a file with a JSON array or from a folder of JSON lines, if one is named; otherwise new ones."""
    if path is None:
        return make()
    fs, p = _file(spark, path)
    return (read_jsonl if fs.getFileStatus(p).isDirectory() else read_json_array)(spark, path, schema)
