"""Evaluation records as a stream: one JSON line a finished record, each written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def append_jsonl(records: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Appends the rows of a streaming DataFrame as JSON lines; restarts go on where the checkpoint ends."""
    writer = records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("ignoreNullFields", "false").outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_stream(spark: SparkSession, path: str, schema, *, fmt: str = "parquet", files: int = 64) -> DataFrame:
    # a glob, so that a table may be one file as well as a folder
    path = f"{path[:-1]}[{path[-1]}]" if not any(c in path for c in "*?[{") else path
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)
