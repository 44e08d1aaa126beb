"""Every customer and every order is a request."""

from lodestar.plans import ORACLES, QUERIES, views

from .test_queries import SF, duck, rows  # noqa: F401


def test_search_leaves_no_order_out(spark, duck):  # noqa: F811
    twin = ORACLES["search_batch_topk"]
    assert twin.count(views.CUSTOMERS) == 1
    df, other = QUERIES["search_every_request"](spark, SF), duck.sql(twin.replace(views.CUSTOMERS, views.ORDERS))
    got = df.collect()
    assert rows(df.columns, got) == rows(other.columns, other.fetchall())
    assert any(r["request_id"] % 50 for r in got)


def test_a_request_for_each_row(spark):
    for name, table in (("expected_calls", "customer"), ("expected_calls_every_request", "orders"), ("acceptable_ids", "customer")):
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_hidden_facts_of_every_order(spark):
    assert QUERIES["hidden_facts_json"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
