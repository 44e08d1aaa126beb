"""Shortened ids against a scan of all ids."""

import random

from lodestar.operators.resolve import resolve, resolve_lists


def test_equals_a_scan(spark):
    r = random.Random(1)
    ids = sorted({"".join(r.choice("abé") for _ in range(r.randrange(1, 7))) for _ in range(150)})
    texts = sorted({"".join(r.choice("abé") for _ in range(r.randrange(6))) for _ in range(400)} | {"zz", "", "éé"} | set(ids[:20]))
    df = resolve(spark.createDataFrame([(t,) for t in [*texts, None, texts[3]]], "text string"), spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "id string"))
    got = {x["text"]: x["resolved"] for x in df.collect()}
    expected = {t: t if t in ids or sum(i.startswith(t) for i in ids) != 1 else next(i for i in ids if i.startswith(t)) for t in texts}
    assert got == expected
    assert any(k != x for k, x in got.items())


def test_lists_keep_their_order(spark):
    ids = spark.createDataFrame([("ab1",), ("ac1",), ("ac2",)], "id string")
    rows = spark.createDataFrame([(1, ["ac", "ab", "ab1", "q", "ac"]), (2, []), (3, None), (4, [None, "ac2"])], "k int, p array<string>")
    assert {x["k"]: x["ids"] for x in resolve_lists(rows, ids, key="k", predicted="p").collect()} == {1: ["ac", "ab1", "q"], 2: [], 3: [], 4: [None, "ac2"]}


def test_no_ids_or_one(spark):
    none, asked = spark.createDataFrame([], "id string"), spark.createDataFrame([("",), ("a",)], "text string")
    assert {tuple(x) for x in resolve(asked, none).collect()} == {("", ""), ("a", "a")}
    assert {tuple(x) for x in resolve(asked, spark.createDataFrame([("abc",)], "id string")).collect()} == {("", "abc"), ("a", "abc")}
