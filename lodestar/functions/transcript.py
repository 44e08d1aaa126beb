"""Transcripts: the messages of a conversation as one record, and what is counted in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transcripts(turns: DataFrame, *, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, messages, raw_agent_outputs): rows of role and text as records; null texts are empty."""
    content = F.coalesce("text", F.lit(""))
    said = F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), "role", content.alias("content"))))
    whole = turns.groupBy(key).agg(said.alias("said"))
    messages = F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return whole.select(key, messages.alias("messages"), F.transform(F.filter("said", lambda m: m["role"] == "assistant"), lambda m: m["content"]).alias("raw_agent_outputs"))


def some_turns(turns: DataFrame, most: int, *, last: bool = False, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The first or last rows of each conversation; Spark cuts each task's rows before it moves them."""
    by = F.desc(order) if last else F.asc(order)
    place = F.row_number().over(Window.partitionBy(key).orderBy(by))
    return turns.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def agent_turn_count(outputs: Column) -> Column:
    return F.coalesce(F.size(outputs), F.lit(0))


def user_message_count(messages: Column) -> Column:
    return F.coalesce(F.size(F.filter(messages, lambda m: m["role"] == "user")), F.lit(0))


def average_count(lists: Column) -> Column:
    """The mean length of lists, as an aggregate; zero without any."""
    return F.coalesce(F.avg(F.coalesce(F.size(lists), F.lit(0))), F.lit(0.0))
