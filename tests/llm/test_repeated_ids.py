"""Rows that repeat an id, with the same or with another value."""

import hashlib

from lodestar.llm import ann, warc


def test_other_payload_of_a_repeated_id_is_stored(spark):
    a, b = "<p>" + "a" * 150, "<p>" + "b" * 150
    pages = spark.createDataFrame([(3, "u", a), (4, "u", a), (5, "u", a), (5, "u", b)], "page_id long, url string, html string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(tuple(r) for r in warc.op10(pages).collect())
    assert got == sorted([(3, 153, sha(a), "response", None), (4, 153, sha(a), "revisit", 3), (5, 153, sha(a), "revisit", 3), (5, 153, sha(b), "response", None)])


def test_repeated_rows_hide_no_other_id(spark):
    kind = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(1, [1.0, 0.0])] * 15 + [(i, [1.0, 0.0]) for i in range(2, 7)] + [(50, [0.0, 1.0])], kind)
    got = ann.search(df, spark.createDataFrame([(1, [1.0, 0.0])], kind), k=5)
    assert sorted((r["vec_id"], r["score"]) for r in got.collect()) == [(i, 0.0) for i in range(2, 7)]


def test_texts_of_a_repeated_id_stay(spark):
    from lodestar.llm import neardup

    from .test_operators import docs

    a, b = "a b c d e f g h", "totally other words than those of the first one"
    rows = [(5, a), (5, b), (6, b), (5, a), (7, ""), (7, ""), (5, None), (8, a + " i")]
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in neardup.near_components(docs(spark, rows)).collect())
    assert got == [(5, 0, 5), (5, 4, 5), (5, 4, 5), (5, 5, 5), (6, 5, 5), (7, 0, 7), (7, 0, 7), (8, 5, 5)]
    kept = sorted(((x["doc_id"], x["text"]) for x in neardup.keep_one(docs(spark, rows)).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (7, ""), (7, ""), (5, None)], key=str)
