"""Nulls, repeated ids, shards, archives and numbers at the edge of their range."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import ann, decontaminate, quality, warc

from .test_operators import docs, words


def test_benchmark_in_shards(spark):
    items = [(f"i{k}", " ".join(words(30, 100 + k))) for k in range(6)] + [("none", None), ("i0", " ".join(words(30, 100)))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(i, " ".join([*words(40, i), *items[i % 6][1].split()[3 : 10 + 2 * i], *words(30, 50 + i), *items[(i + 2) % 6][1].split()])) for i in range(8)] + [(None, None), (9, "")]
    one = sorted(map(str, decontaminate.match_benchmark(docs(spark, rows), bench).collect()))
    assert one == sorted(map(str, decontaminate.match_benchmark(docs(spark, rows), bench, max_item_words=40).collect()))
    assert len(list(decontaminate.shards(bench, "item_id", "text", 40))) == 7


def test_spans_are_cut(spark):
    item = " ".join(words(20, 1))
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    long_ = " ".join(words(900, 2))
    rows = [(1, f"{long_}, ({item.upper()}!) {long_}"), (2, f"few {item}"), (3, "clean"), (4, None)]
    got = {x["doc_id"]: x["text"] for x in decontaminate.without_spans(docs(spark, rows), bench).collect()}
    assert got == {1: f"{long_}, (!) {long_}", 3: "clean", 4: None}
    same = docs(spark, rows).withColumn("_spans", F.lit("x")).withColumn("_N_words", F.lit(1))
    assert decontaminate.clean_documents(same, bench).columns == same.columns and decontaminate.without_spans(same, bench).count() == 3


def test_archives_roll_over_and_null_ids(spark, tmp_path):
    big, other = "<p>" + "x" * 300, "<p>" + "y" * 300
    rows = [(None, "u", big), (None, None, None), (7, "u", big), (3, "v", big), (5, "é\n", other)] + [(100 + i, "w", big + str(i % 4)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    index = warc.write_archives(pages, f"file://{tmp_path}/a", archive_bytes=2000)
    sizes = [x["s"] for x in index.groupBy("file").agg(F.sum("length").alias("s")).collect()]
    assert len(sizes) > 4 and max(sizes) <= 2000
    got = sorted((x["page_id"] or -1, x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.read_records(index).collect())
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h, i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and len(raw) >= 100 and first[h] != i
        want.append((i or -1, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    few = warc.write_archives(pages, f"file://{tmp_path}/b", archive_records=3)
    assert max(x["count"] for x in few.groupBy("file").count().collect()) == 3


def test_distances_out_of_range(spark):
    rows = [(0, [1e200, 1.0]), (100, [-1e200, 1.0]), (1, [1.0, 0.0]), (2, [1e-200, 0.0]), (3, [1.7e308, 0.0]), (200, [-1.7e308, 0.0])]
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in ann.op6(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0, 1] == (1, 1e200) or got[0, 1] == (2, 1e200)
    assert got[100, 3] == (0, 2e200) and got[200, 5] == (3, float("inf")) and len(got) == 15


def test_repeated_ids_of_vectors(spark):
    rows = [(0, [0.0, 1.0])] + [(1, [0.0, 1.0 + i / 100]) for i in range(30)] + [(2 + i, [5.0 + i, 1.0]) for i in range(12)]
    got = [x["vec_id"] for x in ann.op6(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()]
    assert got == list(range(1, 11))
    d = ann.distances(np.array([[3.0, 4.0], [1e-170, 0.0]]), np.zeros(2))
    assert d.tolist() == [5.0, 1e-170]


def test_quality_of_repeated_and_null_ids(spark):
    rows = [(i % 30, " ".join(words(30, i)) if i % 2 else "### " * 20) for i in range(120)] + [(None, "x " * 200_000), (None, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] * 2, "doc_id long, quality int, toxic int")
    got = quality.op3(docs(spark, rows), labels).collect()
    assert len(got) == 122 and sum(x["doc_id"] is None and x["held_out"] is False for x in got) == 2
