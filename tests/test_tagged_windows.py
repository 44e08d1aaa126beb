"""Windows of a tagged table are read once for each text, with the same results on every row."""

from pyspark.sql import functions as F

from lodestar.functions import schedule
from lodestar.sources import directory as src


def test_each_text_is_read_once(spark, capsys):
    raw = [('[{"day":"mon","start":"09:00","end":"17:00"}]', "Weekends noon-midnight"), ("x", "Weekends noon-midnight"), ("x", "Daily 24 hours"), (None, "Daily 24 hours"), ("[]", None), (None, None)]
    rows = spark.createDataFrame([(f"r{i}", *x) for i, x in enumerate(raw * 3)], "resource_id string, schedule_windows string, site_schedule string")
    out = src.resources_from_rows(rows)
    plain = rows.select("resource_id", schedule.windows_from_json(F.col("schedule_windows"), F.col("site_schedule")).alias("w"))
    assert {r["resource_id"]: r["schedule_windows"] for r in out.collect()} == {r["resource_id"]: r["w"] for r in plain.collect()}
    out.explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out
