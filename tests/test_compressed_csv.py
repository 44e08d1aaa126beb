"""A tagged table lies in compressed files of a bounded number of rows, and is read back whole."""

from pathlib import Path

from lodestar.plans import QUERIES, evaluation_queries
from lodestar.sources import directory as src

from .test_queries import SF


def test_round_trip_is_compressed(spark, monkeypatch, tmp_path):
    plain = sorted(map(str, QUERIES["tagged_csv_round_trip"](spark, SF).collect()))
    monkeypatch.setattr(src, "TASK_ROWS", 500)
    monkeypatch.setattr(evaluation_queries, "scratch", lambda spark, what: f"file://{tmp_path}/{what}")
    assert sorted(map(str, QUERIES["tagged_csv_round_trip"](spark, SF).collect())) == plain and plain
    files = [p.name for p in Path(tmp_path, "tagged-csv").iterdir() if p.name.startswith("part-")]
    assert len(files) >= len(plain) // 500 and all(x.endswith(".csv.gz") for x in files)
