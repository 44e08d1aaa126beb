"""Kept summaries, cells without records, and large numbers."""

import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import rollup
from lodestar.sources import directory as src
from lodestar.sources.storage import scratch
from lodestar.streaming import summaries
from lodestar.streaming.records import read_stream

from .test_queries import SF


def rows(df):
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted(str({c: plain(r[c]) for c in sorted(df.columns)}) for r in df.collect())


def test_batches_count_once(spark):
    records = src.records(spark, SF).where("record_id < 900").cache()
    path = scratch(spark, "sums")
    for batch in (0, 0, 1, 2, 2, 3, 1, 4, 0):  # run again in place, and after they were merged
        summaries.apply_batch(records.where(F.col("record_id") % 5 == batch), batch, path, merge=2)
        seen = records.where(F.col("record_id") % 5 <= max(batch, 0 if batch == 0 else batch))
        if batch in (2, 3):
            assert rows(summaries.summary(spark, path)) == rows(rollup.summary(seen))
    assert rows(summaries.summary(spark, path)) == rows(rollup.summary(records))


def test_a_restarted_stream_goes_on(spark):
    path = scratch(spark, "stream")
    events = spark.read.parquet(f"{SF}/events.parquet")

    def run():
        stream = src.records_of(read_stream(spark, f"{path}/in", events.schema, files=1))
        summaries.keep_summary(stream, f"{path}/sums", f"{path}/checkpoint", merge=2).awaitTermination()

    events.where("event_id % 2 = 0").repartition(3).write.parquet(f"{path}/in")
    run()
    events.where("event_id % 2 = 1").repartition(2).write.mode("append").parquet(f"{path}/in")
    run()
    run()
    assert rows(summaries.summary(spark, f"{path}/sums")) == rows(rollup.summary(src.records(spark, SF)))


def test_cells_without_records(spark):
    records = src.records(spark, SF)
    some = records.where("NOT (user_behavior = 'normal' AND case_type = 'single')")
    empty = [r for r in rollup.dense_cells(some).collect() if r["n"] == 0]
    assert {(r["case_type"], r["user_behavior"]) for r in empty} == {("single", "normal")} and all(r["all_match_rate"] is None for r in empty)
    compared = rollup.compare_runs(rollup.concat_runs({"a": records, "b": records.where("user_behavior <> 'rambling'")})).collect()
    assert [r["n"] for r in compared if (r["method"], r["user_behavior"]) == ("b", "rambling")] == [0]


@pytest.mark.parametrize("x", [0.125, 0.0625, 2.5, -1.23456, 2 / 3, 1e14, 1e15, 1e18, 1e22, -3e25])
def test_three_decimals(spark, x):
    assert spark.range(1).select(text.fmt(F.lit(x)).alias("f")).head()["f"] == f"{x:.3f}"
