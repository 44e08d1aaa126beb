"""A larger directory makes more tasks, not larger ones, with the same rows."""

from lodestar.plans import QUERIES
from lodestar.sources import directory as src

from .test_queries import SF


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        before = sorted(src.directory(spark, SF).collect())
        monkeypatch.setattr(src, "TASK_ROWS", 200)
        n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 200)
        df = src.directory(spark, SF)
        assert n > 20 and df.rdd.getNumPartitions() == n and sorted(df.collect()) == before
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_an_index_of_categories_parses_no_texts(spark):
    plan = QUERIES["category_index"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "site_schedule" not in plan and "documents_required" not in plan
