"""The records of many runs as one table: ``spark.read.format("runs")``.

Every run has a folder with ``records.jsonl``, one file or a folder of files that tasks wrote. Option ``path`` names the folder
that holds the folders of the runs; option ``runs``, a JSON object, names runs and their folders instead. Option ``only``, a JSON list of
names, leaves the other runs out before they are listed. Filters are not pushed to the source: Spark 4.1 keeps what it planned for one
scan of a DataFrame for the other scans of it, so a name pushed by one would hold for all and lose rows. The table has the
columns of the schema that is given; one called ``run`` holds the run's name. A part is at most ``SPLIT`` bytes of one file, so
a large run is read by many tasks, and a task holds some ``BLOCK`` bytes at a time. A gzipped file (``.gz``) is one part, read as a stream. A field that a line lacks is NULL, fields that
the schema lacks are left out, and a line that is no JSON, or holds a value of another type, is an error. Files are opened by Arrow's file systems (local or
mounted folders, HDFS, S3, GCS); ``runs.read_run`` reads a run from any store that Spark reaches.

As a stream, each part of the table is what was appended since the last batch, complete lines only. Offsets hold a length for
every file, so a run that goes on for long should append to few files. To a gzipped file whole members are appended.
"""

from __future__ import annotations

import gzip
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .runs import RECORDS

NAME = "run"
SPLIT = 64 << 20
BLOCK = 4 << 20
GZIP = ".gz"


@dataclass
class Part(InputPartition):
    """The lines of a file that begin at ``start`` or after it and before ``end``; of a gzipped file, those of its bytes from ``start`` to ``end``."""

    run: str
    file: str
    start: int
    end: int


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _folders(options: dict[str, str]) -> dict[str, str]:
    """Names of runs and their folders."""
    if options.get("runs"):
        return dict(json.loads(options["runs"]))
    root = options["path"].rstrip("/")
    store, path = _place(root)
    found = store.get_file_info(fs.FileSelector(path))
    return {x.base_name: f"{root}/{x.base_name}" for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith(("_", "."))}


def _files(folder: str) -> list[tuple[str, int]]:
    """(place, bytes) of the files with records; none if the run has not written any."""
    at = f"{folder.rstrip('/')}/{RECORDS}"
    store, path = _place(at)
    it = store.get_file_info(path)
    if it.type == fs.FileType.File:
        return [(at, it.size)]
    listed = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f"{at}/{x.base_name}", x.size) for x in listed if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def _parts(run: str, file: str, start: int, end: int) -> Iterator[Part]:
    step = max(end - start, 1) if file.endswith(GZIP) else SPLIT
    for a in range(start, end, step):
        yield Part(run, file, a, min(a + step, end))


def _lines(part: Part) -> Iterator[bytes]:
    store, path = _place(part.file)
    with store.open_input_file(path) as raw:
        if part.file.endswith(GZIP):
            with gzip.GzipFile(fileobj=raw.get_stream(part.start, part.end - part.start)) as plain, io.BufferedReader(plain, 1 << 20) as f:
                yield from f
            return
        with io.BufferedReader(raw, 1 << 20) as f:
            at = max(part.start - 1, 0)
            f.seek(at)
            if part.start:  # the line that the part before began
                at += len(f.readline())
            while at < part.end and (line := f.readline()):
                at += len(line)
                yield line


def _blocks(part: Part) -> Iterator[bytes]:
    """The lines of a part, some at a time; blank ones are left out."""
    lines, held = [], 0
    for line in _lines(part):
        if line.strip():
            lines.append(line if line.endswith(b"\n") else line + b"\n")
            held += len(line)
        if held >= BLOCK:
            yield b"".join(lines)
            lines, held = [], 0
    if lines:
        yield b"".join(lines)


class _Reader:
    """What the reader of a table and that of a stream have in common."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields = to_arrow_schema(schema)
        self.options = dict(options)
        self.only = json.loads(self.options["only"]) if self.options.get("only") else None

    def runs(self) -> dict[str, str]:
        """Folders of the runs that are asked for."""
        return {k: v for k, v in sorted(_folders(self.options).items()) if self.only is None or k in self.only}

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # so Spark reads a table without parts
            return
        told = pa.schema([x for x in self.fields if x.name != NAME])
        for block in _blocks(part):
            how = pj.ParseOptions(explicit_schema=told, unexpected_field_behavior="ignore")
            # one block of Arrow's for a block of lines: none of them is cut
            rows = pj.read_json(io.BytesIO(block), pj.ReadOptions(use_threads=False, block_size=len(block) + 1), how)
            named = pa.array([part.run], pa.string()).take(pa.array([0] * len(rows), pa.int32()))
            columns = [named if x.name == NAME else rows[x.name] for x in self.fields]
            yield from pa.table(columns, schema=self.fields).to_batches()


class RunReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Part]:
        return [p for run, folder in self.runs().items() for file, size in _files(folder) for p in _parts(run, file, 0, size)]


class RunStream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For every file, the bytes up to its last line end."""
        found = {f"{run}\n{file}": _ended(file, size) for run, folder in self.runs().items() for file, size in _files(folder)}
        return {k: n for k, n in found.items() if n}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [p for k, n in end.items() for p in _parts(*k.split("\n", 1), start.get(k, 0), n)]


def _ended(file: str, size: int) -> int:
    """The length of a file's complete lines; a gzipped file counts as complete."""
    if file.endswith(GZIP):
        return size
    store, path = _place(file)
    with store.open_input_file(path) as f:
        while size > 0:
            start = max(size - (1 << 16), 0)
            f.seek(start)
            cut = f.read(size - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            size = start
    return 0


class RunSource(DataSource):
    """The data source; a schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "runs"

    def schema(self) -> str:
        raise ValueError("name the columns: spark.read.format('runs').schema(...)")

    def reader(self, schema: StructType) -> RunReader:
        return RunReader(schema, self.options)

    def streamReader(self, schema: StructType) -> RunStream:
        return RunStream(schema, self.options)


def read_runs(spark: SparkSession, runs: str | dict[str, str], schema: str, *, only: list[str] | None = None, stream: bool = False) -> DataFrame:
    """(run, columns of ``schema``) of all runs: of those in one folder, or of those that are named with their folders; of these, those in ``only``."""
    spark.dataSource.register(RunSource)
    reader = (spark.readStream if stream else spark.read).format(RunSource.name()).schema(f"{NAME} string, {schema}")
    reader = reader if only is None else reader.option("only", json.dumps(only))
    return reader.load(runs) if isinstance(runs, str) else reader.option("runs", json.dumps(runs)).load()
