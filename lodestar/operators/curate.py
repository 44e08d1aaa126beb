"""Curation: a cascade of predicates, and how many rows each step keeps, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tagging


def in_state_local_area() -> Column:
    area = F.transform("counties_served", F.upper)
    return (F.upper("state_province") == "IN") & (F.size(area) > 0) & ~F.arrays_overlap(area, F.array(F.lit("STATEWIDE"), F.lit("ALL")))


def parseable_schedule() -> Column:
    return F.size("schedule_windows") > 0


def parseable_documents() -> Column:
    return tagging.documents_usable(F.col("documents_required"), F.col("document_requirements"))


def parseable_intake() -> Column:
    return (F.col("site_details") != "") & ~F.array_contains("intake_methods", "empty")


def benchmark_metadata() -> Column:
    return F.size("service_categories").between(1, 3) & (F.col("zipcode") != "") & ((F.col("site_number") != "") | (F.col("service_website") != ""))


def steps() -> list[tuple[str, Column]]:
    return [("in_state_local_service_area", in_state_local_area()), ("parseable_schedule", parseable_schedule()), ("parseable_or_empty_documents", parseable_documents()), ("parseable_intake_methods", parseable_intake()), ("benchmark_metadata", benchmark_metadata())]


def filter_step(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def curate(df: DataFrame, cascade: list[tuple[str, Column]] | None = None) -> DataFrame:
    for _, predicate in cascade or steps():
        df = filter_step(df, predicate)
    return df


def funnel(df: DataFrame, cascade: list[tuple[str, Column]] | None = None) -> DataFrame:
    """(step, name, kept, removed) for every step, from a single aggregation."""
    cascade = cascade or steps()
    so_far, sums = F.lit(True), [F.count("*").alias("k0")]
    for i, (_, predicate) in enumerate(cascade, 1):
        so_far = so_far & F.coalesce(predicate, F.lit(False))
        sums.append(F.count_if(so_far).alias(f"k{i}"))
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"k{i}").alias("kept"), (F.col(f"k{i - 1}") - F.col(f"k{i}")).alias("removed")) for i, (name, _) in enumerate(cascade, 1)))
    return df.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")
