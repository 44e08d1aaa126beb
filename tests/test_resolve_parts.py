"""More ids make more tasks, not larger ones, with the same results."""

from lodestar.operators import resolve


def test_many_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(resolve, "ROWS", 5)
    ids = [f"a{i:03d}" for i in range(100)]
    texts = sorted({t[:n] for t in ids[::7] for n in (2, 3, 4)} | {"z", ""})
    rows = spark.createDataFrame([(i, [t, None, t]) for i, t in enumerate(texts)] + [(-1, None), (-2, [])], "k int, p array<string>")
    got = resolve.resolve_lists(rows, spark.createDataFrame([(i,) for i in ids], "id string"), key="k", predicted="p")
    one = lambda t: t if t in ids or sum(i.startswith(t) for i in ids) != 1 else next(i for i in ids if i.startswith(t))
    assert {r["k"]: r["ids"] for r in got.collect()} == {i: [one(t), None] for i, t in enumerate(texts)} | {-1: [], -2: []}
    assert resolve._parts(spark.range(101)) == 21
