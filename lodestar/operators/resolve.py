"""Shortened ids completed against a whole directory: a sorted range join, without pairing ids with ids.

A shortened id is followed, in the order of texts, by all ids that it starts; it stands for one of them if the first id after it
starts with it and the second doesn't. So both sides are put in one order, by ranges that many tasks sort side by side,
and each shortened id looks at the two ids after it, which may lie in a later range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import kept

ROWS = 250_000  # of one task: more of them make more tasks, not larger ones


def _parts(df: DataFrame) -> int:
    """Tasks for the rows of a saved table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def resolve(shortened: DataFrame, ids: DataFrame) -> DataFrame:
    """(text, resolved) of each different ``text`` of ``shortened``: itself if it is one of ``ids`` (a column ``id``), the one id that it starts, or else itself again.

    Null texts and ids take no part; repeated ones count once; the empty text starts every id.
    """
    spark = shortened.sparkSession
    asked = shortened.select("text", F.lit(True).alias("asked"), F.lit(False).alias("known"))
    both = asked.unionByName(ids.select(F.col("id").alias("text"), F.lit(False).alias("asked"), F.lit(True).alias("known"))).where("text IS NOT NULL")
    both = kept(both, "both")
    parts = _parts(both)
    texts = both.repartition(parts, "text").groupBy("text").agg(F.bool_or("asked").alias("asked"), F.bool_or("known").alias("known"))
    texts = kept(texts.repartitionByRange(parts, "text").withColumn("range", F.spark_partition_id()), "texts")

    # the first two ids of each range, at most two rows a range, say what follows the ranges before it
    first = Window.partitionBy("range").orderBy("text")
    heads = texts.where("known").withColumn("n", F.row_number().over(first)).where("n <= 2").select("range", "text").collect()
    by_range, rest, follows = {}, [], []
    for r in heads:
        by_range.setdefault(r["range"], []).append(r["text"])
    for k in reversed(range(parts)):
        follows.append((k, rest))
        rest = [*sorted(by_range.get(k, [])), *rest][:2]
    after = spark.createDataFrame(follows, "range int, after array<string>")

    # backwards, the last id seen is the next one; it brings the one after it along
    later = Window.partitionBy("range").orderBy(F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    one = texts.repartition(parts, "range").withColumn("next", F.last(F.when(F.col("known"), F.col("text")), ignorenulls=True).over(later))
    two = one.withColumn("second", F.last(F.when(F.col("known"), F.struct("next")), ignorenulls=True).over(later)["next"])
    found = two.where("asked").join(F.broadcast(after), "range").withColumn("follow", F.concat(F.array_compact(F.array("next", "second")), "after"))
    unique = F.get("follow", 0).startswith(F.col("text")) & ~F.coalesce(F.get("follow", 1).startswith(F.col("text")), F.lit(False))
    return found.select("text", F.when(~F.col("known") & unique, F.get("follow", 0)).otherwise(F.col("text")).alias("resolved"))


def resolve_lists(rows: DataFrame, ids: DataFrame, *, key: str, predicted: str) -> DataFrame:
    """(key, ids): the predicted ids of each row completed, in order and without repeats; null lists are empty."""
    each = kept(rows.select(key, F.posexplode_outer(predicted).alias("at", "text")), "predicted")
    parts = _parts(each)
    done = each.repartition(parts, "text").join(resolve(each.where("at IS NOT NULL").select("text"), ids), "text", "left").repartition(parts, key)
    listed = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("resolved", "text").alias("id")))))
    return done.groupBy(key).agg(F.array_distinct(F.transform(listed, lambda x: x["id"])).alias("ids"))
