"""Roll-ups of evaluation records and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The flags of a record, the columns that are averaged, and the names under which failures are counted.
KEYS = ("valid_tool_call", "tool_call_count_match", "service_match", "location_match", "schedule_match", "intake_match", "documents_match", "eligibility_match", "all_match", "resource_exact_match", "end_to_end_match")
MEANS = {"resource_precision_avg": "resource_precision", "resource_recall_avg": "resource_recall", "predicted_tool_call_count_avg": "predicted_call_count"}
FAILURES = {
    "invalid_tool_call": "valid_tool_call", "tool_call_count": "tool_call_count_match", "service": "service_match", "location": "location_match", "schedule": "schedule_match", "intake": "intake_match",
    "documents": "documents_match", "eligibility": "eligibility_match", "resource_selection": "resource_exact_match", "end_to_end": "end_to_end_match", "not_all_match": "all_match",
}


def rate(key: str) -> Column:
    return F.avg(F.coalesce(F.col(key), F.lit(False)).cast("double"))


def metrics() -> list[Column]:
    return [F.count("*").alias("n"), *(rate(k).alias(f"{k}_rate") for k in KEYS), *(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(k) for k, c in MEANS.items())]


def overall(records: DataFrame) -> DataFrame:
    """One row; rates are NULL without records."""
    return records.agg(*metrics())


DIMS = ("user_behavior", "case_type", "constraint_profile", "parse_mode")


def summary(records: DataFrame) -> DataFrame:
    """All one-column groupings, their cross and the total in one pass, told apart by ``level``."""
    return by_levels(records, metrics())


def by_levels(rows: DataFrame, measures: list[Column]) -> DataFrame:
    """``measures`` for each grouping of a summary."""
    sets = [["user_behavior", "case_type", "constraint_profile"], *([d] for d in DIMS), []]
    level = F.when(F.col("gid") == 0b0001, "cell").when(F.col("gid") == 0b0111, "user_behavior").when(F.col("gid") == 0b1011, "case_type").when(F.col("gid") == 0b1101, "constraint_profile").when(F.col("gid") == 0b1110, "parse_mode").otherwise("overall")
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(d) for d in DIMS)).agg(F.grouping_id().alias("gid"), *measures)
    return grouped.withColumn("level", level).drop("gid")


def dense_cells(records: DataFrame) -> DataFrame:
    """Every combination of the values seen; those without records have ``n`` 0 and no rates."""
    dims = ["case_type", "constraint_profile", "user_behavior"]
    cells = records.groupBy(*dims).agg(*metrics())
    grid = cells.select(dims[0]).distinct()
    for d in dims[1:]:
        grid = grid.crossJoin(cells.select(d).distinct())  # a few values of each column, after aggregation
    same = [F.col(f"g.{d}").eqNullSafe(F.col(f"c.{d}")) for d in dims]
    out = grid.alias("g").join(cells.alias("c"), same[0] & same[1] & same[2], "left")
    return out.select(*(f"g.{d}" for d in dims), F.coalesce("c.n", F.lit(0)).alias("n"), *(f"c.{c}" for c in cells.columns if c not in (*dims, "n")))


def parse_modes(records: DataFrame) -> DataFrame:
    n = F.sum("n").over(Window.partitionBy())  # over a handful of groups
    return records.groupBy("parse_mode").agg(F.count("*").alias("n")).select("parse_mode", "n", (F.col("n") / n).alias("share"))


def parse_none_rate(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.avg((F.col("parse_mode") == "none").cast("double")), F.lit(0.0)).alias("parse_none_rate"))


def turn_stats(records: DataFrame) -> DataFrame:
    made = lambda c, name: [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{name}_avg"), F.coalesce(F.median(c), F.lit(0.0)).alias(f"{name}_median"), F.coalesce(F.max(c), F.lit(0)).alias(f"{name}_max")]
    return records.agg(*made("agent_turns", "agent_turns"), *made("user_messages", "user_messages"))


def token_usage(records: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))
    parts = {"input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens")}
    parts["total_tokens"] = F.coalesce(parts["input_tokens"], F.lit(0)) + F.coalesce(parts["output_tokens"], F.lit(0))
    return records.agg(*(total(c).alias(k) for k, c in parts.items()), *((F.when(F.count("*") > 0, total(c) / F.count("*")).otherwise(0.0)).alias(f"avg_{k}") for k, c in parts.items()))


def usage_by_conversation(usage: DataFrame, key: str) -> DataFrame:
    """Running sums of a conversation's usage; providers name the counts in two ways."""
    get = lambda *names: F.coalesce(*(F.col(n) for n in names if n in usage.columns), F.lit(0))
    return usage.groupBy(key).agg(F.sum(get("input_tokens", "prompt_tokens")).alias("input_tokens"), F.sum(get("output_tokens", "completion_tokens")).alias("output_tokens"), F.sum(get("total_tokens")).alias("total_tokens"))


def failure_counts(records: DataFrame, *by: str) -> DataFrame:
    missed = lambda k: F.count_if(~F.coalesce(F.col(k), F.lit(False)))
    return records.groupBy(*by).agg(*(missed(k).alias(name) for name, k in FAILURES.items()), F.count("*").alias("n"))


def field_failures(records: DataFrame) -> DataFrame:
    """The same counts under the flags' own names."""
    return records.agg(*(F.count_if(~F.coalesce(F.col(k), F.lit(False))).alias(k) for k in KEYS))


def behavior_report(records: DataFrame) -> DataFrame:
    """Per behaviour: rates, turns, messages, and how many runs were shorter than the same spec's normal run.

    Of several normal runs of a spec the one with the largest record id counts.
    """
    normal = records.where("user_behavior = 'normal'").groupBy("user_spec_id").agg(F.max_by("agent_turns", "record_id").alias("normal_turns"))
    shorter = (F.col("user_behavior") != "normal") & (F.col("agent_turns") < F.coalesce("normal_turns", F.lit(0)))
    joined = records.join(normal, "user_spec_id", "left")
    return joined.groupBy("user_behavior").agg(
        F.count("*").alias("n"), *(rate(k).alias(a) for a, k in (("end_to_end", "end_to_end_match"), ("tool_all", "all_match"), ("resource", "resource_exact_match"), ("valid", "valid_tool_call"))),
        F.avg("agent_turns").alias("agent_turns_avg"), F.median("agent_turns").alias("agent_turns_median"), F.avg("user_messages").alias("user_msgs_avg"), F.median("user_messages").alias("user_msgs_median"), F.count_if(shorter).alias("shorter_than_normal"),
    )


def most_common_failures(records: DataFrame) -> DataFrame:
    """(user_behavior, place, failure, count), most frequent first; ties by the first record that fails, then by key order."""
    keys = list(FAILURES.values())
    failed = F.explode(F.filter(F.array(*(F.when(~F.coalesce(F.col(k), F.lit(False)), F.struct(F.lit(i).alias("k"), F.lit(k.removesuffix("_match")).alias("failure"))) for i, k in enumerate(keys))), lambda x: x.isNotNull()))
    rows = records.select("user_behavior", "record_id", failed.alias("f")).groupBy("user_behavior", "f.failure").agg(F.count("*").alias("count"), F.min(F.struct("record_id", "f.k")).alias("first"))
    place = Window.partitionBy("user_behavior").orderBy(F.desc("count"), "first")
    return rows.select("user_behavior", F.row_number().over(place).alias("place"), "failure", "count")


def examples(records: DataFrame, limit: int) -> DataFrame:
    """The first records of each behaviour, failed ones and short ones first."""
    order = Window.partitionBy("user_behavior").orderBy(F.coalesce("all_match", F.lit(True)), "agent_turns", "record_id")
    return records.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def shown_messages(messages: Column, most: int = 6, chars: int = 240) -> Column:
    """Lines for a report: the first messages on one line each, cut to a length."""
    line = lambda m: F.concat_ws(": ", m["role"], F.substring(F.trim(F.replace(F.coalesce(m["content"], F.lit("")), F.lit("\n"), F.lit(" "))), 1, chars))
    return F.transform(F.slice(messages, 1, most), line)


def compare_runs(records: DataFrame, method: str = "method") -> DataFrame:
    """Methods against the union of behaviours; a behaviour that a method lacks has ``n`` 0 and no rates."""
    cells = records.groupBy(method, "user_behavior").agg(*metrics())
    grid = cells.select(method).distinct().crossJoin(cells.select("user_behavior").distinct())  # names only
    out = grid.join(cells, [method, "user_behavior"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def concat_runs(runs: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in runs.items():
        named = df.withColumn("method", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def top_counts(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    """The most frequent values; ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)


def unique_counts(df: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """(column, n): distinct values of plain columns and of list items, from one pass over named values."""
    named = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in scalars]
    items = [F.transform(F.col(c), _named(c)) for c in lists]
    return df.select(F.explode(F.concat(F.array(*named), *items)).alias("x")).select("x.*").where("value IS NOT NULL").distinct().groupBy("column").agg(F.count("*").alias("n"))


def _named(c: str):
    return lambda x: F.struct(F.lit(c).alias("column"), x.alias("value"))


def window_stats(df: DataFrame, column: str = "schedule_windows") -> DataFrame:
    n = F.size(column)
    return df.agg(F.count_if(n > 0).alias("with_windows"), F.sum(n).alias("windows"), F.avg(n).alias("mean_windows"))


def blank_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in columns]
    return df.agg(*counts).unpivot([], columns, "column", "blanks")


def sites_with_many(df: DataFrame, key: str, item: str, least: int = 2) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(item).alias("n")).where(F.col("n") >= least)


def most_per(df: DataFrame, key: str, item: str) -> DataFrame:
    """(n, keys): the largest number of distinct items that one key has, and how many keys have so many."""
    n = df.groupBy(key).agg(F.count_distinct(item).alias("n")).groupBy("n").agg(F.count("*").alias("keys"))
    return n.agg(F.max(F.struct("n", "keys")).alias("m")).select("m.n", "m.keys")


#: Titles and columns of the comparison report.
OVERALL = {
    "Method": "method", "Cases": "n", "E2E": "end_to_end_match_rate", "Tool All": "all_match_rate", "Resource": "resource_exact_match_rate", "Valid": "valid_tool_call_rate", "Calls": "tool_call_count_match_rate",
    "Service": "service_match_rate", "Location": "location_match_rate", "Schedule": "schedule_match_rate", "Intake": "intake_match_rate", "Documents": "documents_match_rate", "Eligibility": "eligibility_match_rate",
}
BY_BEHAVIOR = {"Method": "method", "Behavior": "user_behavior", "N": "n", "E2E": "end_to_end_match_rate", "Tool All": "all_match_rate", "Resource": "resource_exact_match_rate", "Valid": "valid_tool_call_rate", "Location": "location_match_rate"}
DIAGNOSTICS = {"Method": "method", "Parse None": "parse_none", "Parse None Rate": "parse_none_rate", "Avg Agent Turns": "agent_turns_avg", "Avg Resource Precision": "resource_precision_avg", "Avg Resource Recall": "resource_recall_avg"}
FIELD_FAILURES = {
    "Method": "method", "Calls": "tool_call_count", "Service": "service", "Location": "location", "Schedule": "schedule", "Intake": "intake", "Documents": "documents", "Eligibility": "eligibility",
    "Resource": "resource_selection", "E2E": "end_to_end",
}


def method_table(records: DataFrame) -> DataFrame:
    """All that the report says of a method as a whole, from one pass: rates, means, parse failures, turns and failure counts."""
    none = F.col("parse_mode") == "none"
    missed = [F.count_if(~F.coalesce(F.col(k), F.lit(False))).alias(name) for name, k in FAILURES.items()]
    return records.groupBy("method").agg(*metrics(), F.count_if(none).alias("parse_none"), F.avg(F.coalesce(none, F.lit(False)).cast("double")).alias("parse_none_rate"), F.avg("agent_turns").alias("agent_turns_avg"), *missed)


def comparison_report(runs: dict[str, DataFrame]) -> str:
    """The four tables of a comparison as text, methods in the order in which they are given; a method without records is left out."""
    records, names = concat_runs(runs), list(runs)
    by_method = sorted(method_table(records).collect(), key=lambda r: names.index(r["method"]))  # one row a method
    by_behavior = sorted(compare_runs(records).collect(), key=lambda r: (names.index(r["method"]), r["user_behavior"] or ""))
    tables = (("Overall", OVERALL, by_method), ("By Behavior", BY_BEHAVIOR, by_behavior), ("Diagnostics", DIAGNOSTICS, by_method), ("Field Failures", FIELD_FAILURES, by_method))
    shown = [[f"## {title}", "", *_lines(columns, ([_cell(r[c], 2 if c == "agent_turns_avg" else 3) for c in columns.values()] for r in rows), 2 if title == "By Behavior" else 1), ""] for title, columns, rows in tables]
    return "\n".join(["# Algorithm Run Comparison", "", *(line for part in shown for line in part)])


def _cell(x, digits: int = 3) -> str:
    return "NA" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def _lines(columns, rows, names: int = 1) -> list[str]:
    rule = "|" + "---|" * names + "---:|" * (len(columns) - names)
    return ["| " + " | ".join(columns) + " |", rule, *("| " + " | ".join(r) + " |" for r in rows)]


def markdown(rows: DataFrame, title: str, *, most: int = 10_000) -> str:
    """A small result as a table of text; NULL is NA and fractions have three decimals. More than ``most`` rows are refused."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows are no report")
    return "\n".join([f"## {title}", "", *_lines(rows.columns, (map(_cell, r) for r in got))])


def run_summary(records: DataFrame) -> dict:
    """The summary of one run as plain values. Groups have few names each; cells without records have a count alone."""
    dims = ("user_behavior", "case_type", "constraint_profile", "parse_mode", "level")
    plain = lambda r: {k: v for k, v in r.items() if k not in dims} if r["n"] else {"n": 0}
    rows = [r.asDict() for r in summary(records).collect()]
    by = lambda d: {r[d]: plain(r) for r in sorted((r for r in rows if r["level"] == d), key=lambda r: r[d])}
    cells = {"__".join(r[d] for d in ("case_type", "constraint_profile", "user_behavior")): plain(r.asDict()) for r in dense_cells(records).collect()}
    whole, modes = plain(overall(records).head().asDict()), by("parse_mode")
    missed = lambda r: {k: r[k] for k in FAILURES}
    failures = {r["user_behavior"]: missed(r) for r in failure_counts(records, "user_behavior").collect()}
    out = {
        "cases": whole["n"], "overall": whole, **{f"by_{d}": by(d) for d in ("user_behavior", "case_type", "constraint_profile")}, "by_case_type_constraint_behavior": dict(sorted(cells.items())),
        "parse_modes": {k: r["n"] for k, r in modes.items()}, "parse_none_rate": parse_none_rate(records).head()[0], "score_by_parse_mode": modes, "turn_stats": turn_stats(records).head().asDict(),
        "failure_counts": {k: sum(r[k] for r in failures.values()) for k in FAILURES}, "by_user_behavior_failure_counts": dict(sorted(failures.items())),
    }
    return out | ({"token_usage": token_usage(records).head().asDict()} if {"input_tokens", "output_tokens"} <= set(records.columns) else {})
