"""Cases in the order of attempts, places found by counting, and searches that stop early, each against the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import search, specgen
from lodestar.sources import directory as src
from lodestar.sources.storage import kept

from .test_queries import SF


@pytest.fixture(scope="module")
def resources(spark):
    return kept(src.resources(spark, SF), "resources")


def test_counts_equal_a_loop(spark):
    r = random.Random(1)
    for n, first, start, width in ((1, 0, 0, 4), (7, 5, 3, 4), (300, 11, 2, 4), (300, 0, 0, 256)):
        gains = [[int(r.random() < 0.4) for _ in range(4)] for _ in range(n)]
        steps = spark.createDataFrame([(first + i, g) for i, g in enumerate(gains)], "index long, gain array<long>").repartition(3)
        got = {x["index"]: (x["before"], x["got"]) for x in specgen.counts_before(steps, first, n, start, width).collect()}
        count, expected = start, {}
        for i, g in enumerate(gains):
            expected[first + i] = (count, g[count % 4])
            count += g[count % 4]
        assert got == expected


def test_cases_in_order_equal_a_loop(spark, resources):
    d, u = specgen.Directory.of(resources), specgen.hashed(5)
    gains = {r["index"]: r["gain"] for r in specgen.outcomes(d, spark.range(120), u).collect()}
    assert {g for x in gains.values() for g in x} == {0, 1}
    accepted, count, i = [], 0, 0
    while count < 12:
        if gains[i][count % 4]:
            accepted.append((i, f"user-spec-{count + 1:03d}", ("single", "composite")[count % 2], ("all_hard", "acceptable")[count // 2 % 2]))
            count += 1
        i += 1
    rows = specgen.specs_in_order(resources, 12, 5).select("slot", "user_spec_id", "case_type", "constraint_profile", "need").collect()
    assert sorted(tuple(r)[:4] for r in rows if r["need"] == 1) == sorted(accepted)
    assert sum(r["need"] == 2 for r in rows) == 6
    with pytest.raises(RuntimeError, match="No resources"):
        specgen.specs_in_order(resources.limit(0), 4, 5)


def test_a_known_row_stands_where_a_search_puts_it(spark, resources):
    asked = kept(search.request_from_args(src.requests(spark, SF).limit(60)), "asked")
    ranked = kept(search.search(asked, resources, 20).select("request_id", "resource_id", (F.col("rank") - 1).cast("long").alias("before")), "ranked")
    some = ranked.where("request_id % 3 = 0 AND before % 4 = 1 OR request_id % 3 = 1 AND before = 19 OR request_id % 3 = 2 AND before = 0").groupBy("request_id").agg(F.min_by("resource_id", "before").alias("resource_id"))
    stray = asked.join(some, "request_id", "left_anti").select("request_id").crossJoin(resources.select("resource_id").limit(1))
    known = kept(some.unionByName(stray), "known")
    got = {(r["request_id"], r["before"]) for r in search.standing(asked, known, kept(search.prepare_resources(resources), "facets")).collect()}
    expected = {(r["request_id"], r["before"]) for r in ranked.join(some, ["request_id", "resource_id"]).collect()}
    assert expected and expected <= got
    assert not ({i for i, _ in got} - {i for i, _ in expected}) & {r["request_id"] for r in some.collect()}


def test_early_stops_lose_nothing(spark, resources, monkeypatch):
    r, none = src.requests(spark, SF), F.array().cast("array<string>")
    lists = {c: none for c in ("counties", "cities", "zipcodes", "intake_methods", "available_documents", "eligibility")}
    more = [r, r.limit(40).withColumn("service_categories", none), r.limit(20).withColumns({"service_categories": none, "counties": none}), r.limit(20).withColumns({"cities": none, "zipcodes": none}), r.limit(12).withColumns(lists), r.limit(12).withColumns(lists | {"service_categories": none})]
    asked = None
    for i, x in enumerate(more):
        x = x.withColumn("request_id", F.col("request_id") + 1000 * i)
        asked = x if asked is None else asked.unionByName(x)
    asked = kept(search.request_from_args(asked), "asked")

    def rows():
        return {(x["request_id"], x["rank"], x["resource_id"], x["score"], tuple(x["matched_filters"])) for x in search.search(asked, resources, 6).collect()}

    monkeypatch.setattr(search, "MANY", 10**9)
    plain = rows()
    monkeypatch.setattr(search, "MANY", 1)
    assert rows() == plain
