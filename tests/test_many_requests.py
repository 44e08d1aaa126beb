"""Searches of many requests do not pair requests with resources, and texts are read once."""

from pyspark.sql import functions as F

from lodestar.operators import search
from lodestar.sources import directory as src
from lodestar.sources.storage import kept

from .test_queries import SF


def asked(spark, times):
    r = src.requests(spark, SF)
    each = r.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("request_id", F.col("request_id") * 100 + F.col("i"))
    # another ZIP code makes another request, which has to be searched on its own
    return search.prepare_requests(search.request_from_args(each.withColumn("zipcodes", F.array(F.concat(F.lit("9"), F.col("i").cast("string"))))).drop("i"))


def test_lookups_are_shared(spark, monkeypatch):
    read = []
    plain = search._looked_up

    def looked_up(due, fits, listed, kinds, k):
        if kinds in ("c", "t", "ct"):
            read.append((kinds, fits.count(), listed.count(), due.select("_ask", "q_county", "q_city").distinct().count(), due.count()))
        return plain(due, fits, listed, kinds, k)

    monkeypatch.setattr(search, "_looked_up", looked_up)
    whole = kept(search.prepare_resources(src.resources(spark, SF)).withColumn("_row", F.monotonically_increasing_id()), "prepared")
    for times in (1, 4):
        search.search_many(asked(spark, times), whole, 10, ["resource_id"]).count()
    one, four = read[: len(read) // 2], read[len(read) // 2 :]
    assert one and len(one) == len(four)
    for a, b in zip(one, four, strict=True):
        assert a[:4] == b[:4] and b[4] == 4 * a[4]


def test_a_name_of_a_place_holds_the_mark_between_two(spark):
    """County ``a|1:b`` with city ``c`` is not county ``a`` with city ``b|1:c``."""
    kinds = {"c": F.col("x"), "t": F.col("y")}
    pairs = spark.createDataFrame([(["a|1:b"], ["c"]), (["a"], ["b|1:c"]), (["a"], ["b"])], "x array<string>, y array<string>")
    assert pairs.select(F.explode(search._joint("ct", kinds)).alias("k")).distinct().count() == 3


def test_more_texts_than_are_kept(spark, monkeypatch):
    monkeypatch.setattr(src, "FEW_TEXTS", 3)
    d = src.directory(spark, "/root/testdata/sf0.001").limit(300).withColumn("site_schedule", F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("site_schedule")))
    d = kept(d, "raw")
    got = src.read_once(d, src.READERS)
    own = d.select("resource_id", *(reader(F.col(c)).alias(k) for k, (c, reader) in src.READERS.items()))
    assert got.count() == d.count()
    assert got.select(own.columns).exceptAll(own).isEmpty() and own.exceptAll(got.select(own.columns)).isEmpty()
