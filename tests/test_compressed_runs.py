"""Gzipped records of runs, as tables and as streams."""

import gzip
from pathlib import Path

from pyspark.sql import functions as F

from lodestar.sources import run_source, runs


def test_runs_are_written_compressed_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "FILE_ROWS", 400)
    records = spark.range(0, 1000, 1, 1).select(F.col("id").alias("record_id"), F.concat(F.lit("é " * 40), "id").alias("text"))
    runs.write_run(f"file://{tmp_path}/a", {}, records.limit(2), records, {"n": 1000})
    files = [x for x in Path(tmp_path, "a", runs.RECORDS).iterdir() if x.name.startswith("part-")]
    assert len(files) == 3 and all(x.suffix == ".gz" for x in files) and sum(x.stat().st_size for x in files) < 20_000
    schema = "record_id long, text string"
    for got in (run_source.read_runs(spark, f"file://{tmp_path}", schema).drop("run"), runs.read_run(spark, f"file://{tmp_path}/a", schema)[1]):
        assert sorted(got.collect()) == sorted(records.collect())


def test_members_are_read_once(tmp_path, monkeypatch):
    monkeypatch.setattr(run_source, "SPLIT", 10)
    file = tmp_path / "part-0.json.gz"
    file.write_bytes(gzip.compress(b'{"a": 1}\n{"a": 2}'))
    first = run_source._ended(str(file), file.stat().st_size)
    file.write_bytes(file.read_bytes() + gzip.compress(b'\n{"a": 3}\n'))
    size = file.stat().st_size
    read = lambda a, b: [x for p in run_source._parts("r", str(file), a, b) for block in run_source._blocks(p) for x in block.split()]
    assert read(0, first) == [b'{"a":', b"1}", b'{"a":', b"2}"] and read(first, size) == [b'{"a":', b"3}"] and len(read(0, size)) == 6
    assert read(size, size) == []
