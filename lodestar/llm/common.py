"""Helpers shared by the training-data operators: shared-folder tables and small numeric kernels."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); one is set only where none is named and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Saved:
    """A DataFrame written as Parquet in the shared folder: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, what: str):
        self.spark = df.sparkSession
        self.path = shared_path(self.spark, what)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


class Scratch:
    """Saved tables that are dropped together, once what was made of them is saved too."""

    def __init__(self) -> None:
        self.tables: list[Saved] = []

    def save(self, df: DataFrame, what: str) -> DataFrame:
        self.tables.append(Saved(df, what))
        return self.tables[-1].df

    def drop(self) -> None:
        for x in self.tables:
            x.drop()


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT = 1000  # keys that hold at least one row in HOT are joined by broadcast: there can be no more than HOT of them


def joined_apart(rows: DataFrame, keys: DataFrame, hot: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys``, of which ``hot`` are those that hold the most rows.

    Rows of a hot key stay where they are and meet a broadcast of at most ``HOT`` keys; only the others are shuffled, so no
    task gets all rows of a key that a large part of the table holds.
    """
    few = F.broadcast(hot)
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(keys, on, how))


def hot_from(rows: int) -> int:
    """The number of rows from which on a key of a table of that size is a hot one."""
    return max(2, -(-rows // HOT))


def row_key(id_col: str, text_col: str) -> Column:
    """Sixteen bytes that tell a row by its id, null or not, and its text."""
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(name, F.lit("\0"), F.col(text_col)).cast("binary")))


BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """Lets Python see at most ``BATCH_ROWS`` rows at a time, so long texts don't add up; the session's limit stays if lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE_INV, k, 1 << 64))])


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p[i] = sum over j < i of (data[j] + 1) * base**j; span hashes are (p[e] - p[s]) / base**s."""
    POWERS.reach(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((prefix[end] - prefix[start]) * POWERS.down[start])


def blocks(texts: list[bytes], limit: int = 256 << 10) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes together; a longer text stands alone."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < limit):
            size += len(texts[j]) + 1
            j += 1
        yield i, j
        i = j
