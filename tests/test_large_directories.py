"""Cases from a directory so large that few of its resources are among any first results."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import search, specgen
from lodestar.sources.storage import kept


def _alike(spark, n, categories=("Food-Aid", "food aid", "Other"), counties=("A-B", "a b")):
    """``n`` resources that no request tells apart, with repeated and oddly written categories and counties."""
    listed = lambda *xs: F.array(*map(F.lit, xs))
    windows = F.array().cast("array<struct<day:string,start_minute:int,end_minute:int>>")
    return spark.range(n).select(
        F.format_string("r%04d", "id").alias("resource_id"), F.lit("Same").alias("service_name"), listed(*categories).alias("service_categories"), listed(*counties).alias("counties"),
        F.lit("City").alias("city"), F.lit("46000").alias("zipcode"), windows.alias("schedule_windows"), listed("call").alias("intake_methods"), listed("none").alias("document_requirements"), listed("none").alias("eligibility_tags"),
    )


def test_no_cases_is_no_error_if_some_will_do(spark):
    few = specgen.build_specs(_alike(spark, 400, ("Food", "Other"), ("A",)), 24, 1, tries=50, draw=specgen.arithmetic, partial=True)
    got = few.select("slot", "try").distinct().collect()
    assert 0 < len(got) < 24 and all(r["try"] < 50 for r in got)


@pytest.mark.parametrize("most", [None, 10])
def test_many_known_rows_among_repeated_categories(spark, most):
    res = kept(_alike(spark, 600), "resources")
    none = F.array().cast("array<string>")
    known = res.select(F.col("resource_id").alias("request_id"), "resource_id")
    asked = known.select("request_id", F.array(F.lit("other"), F.lit("FOOD AID")).alias("service_categories"), F.array(F.lit("a-b")).alias("counties"), F.array(F.lit("city")).alias("cities"), none.alias("zipcodes"), none.alias("intake_methods"), none.alias("available_documents"), none.alias("eligibility"), F.lit(None).cast("struct<day:string,start_time:string,end_time:string,time:string,requires_24_hours:boolean>").alias("schedule"))
    got = {r["request_id"]: r["before"] for r in search.standing(search.request_from_args(asked), known, res, most).collect()}
    expected = {f"r{i:04d}": i for i in range(600)}
    assert got == expected if most is None else {k: min(b, most) for k, b in got.items()} == {k: min(b, most) for k, b in expected.items()}


def test_only_buckets_with_a_drawn_place_are_put_in_order(spark):
    d = specgen.Directory.of(_alike(spark, 300))
    assert {r["category"]: r["size"] for r in d.categories.collect()} == {"Food-Aid": 300, "food aid": 300, "Other": 300}
    asked = spark.createDataFrame([("Other", i) for i in (0, 7, 299)], "category string, place long")
    order = sorted((r["b"], r["resource_id"]) for r in d.resources.select(specgen._bucket().alias("b"), "resource_id").collect())
    assert {(r["place"], r["resource_id"]) for r in d.at_places(asked).collect()} == {(i, order[i][1]) for i in (0, 7, 299)}
