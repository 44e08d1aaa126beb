"""Scores of predicted calls and of selected resources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, same_set

FIELDS = ("service_match", "location_match", "schedule_match", "intake_match", "documents_match", "eligibility_match")
PLACES = ("counties", "cities", "zipcodes")


def location_matches(p: Column, e: Column) -> Column:
    """One expected field: the very same map of fields. Several: nothing outside them, and at least one field in full."""
    asked = {c: F.size(e[c]) > 0 for c in PLACES}
    given = {c: F.size(p[c]) > 0 for c in PLACES}
    n = sum((F.when(x, 1).otherwise(0) for x in asked.values()), F.lit(0))
    equal = {c: (F.size(p[c]) > 0) & same_set(p[c], e[c]) for c in PLACES}
    none_given, all_equal, inside, one = F.lit(True), F.lit(True), F.lit(True), F.lit(False)
    for c in PLACES:
        none_given = none_given & ~given[c]
        all_equal = all_equal & F.when(asked[c], equal[c]).otherwise(~given[c])
        inside = inside & (F.size(F.array_except(p[c], e[c])) == 0)
        one = one | (asked[c] & equal[c])
    return F.when(n == 0, none_given).when(n == 1, all_equal).otherwise(inside & one)


def arg_scores(p: Column, e: Column) -> Column:
    """Seven flags of one normalised prediction against one normalised expectation; all false without a prediction."""
    flags = let(F.struct(p.alias("p"), e.alias("e")), lambda x: _flags(x["p"], x["e"]))
    return let(flags, _with_all)


def _with_all(f: Column) -> Column:
    every = F.lit(True)
    for k in FIELDS:
        every = every & f[k]
    return F.struct(f["valid_tool_call"].alias("valid_tool_call"), *(f[k].alias(k) for k in FIELDS), every.alias("all_match"))


def _flags(p: Column, e: Column) -> Column:
    flags = {
        "service_match": same_set(p["service_categories"], e["service_categories"]), "location_match": location_matches(p, e), "schedule_match": p["schedule"].eqNullSafe(e["schedule"]),
        "intake_match": same_set(p["intake_methods"], e["intake_methods"]), "documents_match": same_set(p["available_documents"], e["available_documents"]), "eligibility_match": same_set(p["eligibility"], e["eligibility"]),
    }
    flags = {k: p.isNotNull() & F.coalesce(c, F.lit(False)) for k, c in flags.items()}
    return F.struct(p.isNotNull().alias("valid_tool_call"), *(c.alias(k) for k, c in flags.items()))


def field_match_count(score: Column) -> Column:
    return sum((score[k].cast("int") for k in FIELDS), F.lit(0))


def score_calls(predicted: Column, expected: Column) -> Column:
    """Greedy one-to-one matching: each expectation, in order, takes the first unused prediction with most matching fields.

    Both are arrays of normalised arguments.
    """
    n = F.size(predicted)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    scored = F.transform(expected, lambda e: F.transform(every, lambda i: F.struct(i.alias("i"), arg_scores(F.get(predicted, i), e).alias("s"))))
    grid = F.transform(scored, lambda row: F.transform(row, lambda x: F.struct(field_match_count(x["s"]).alias("c"), (-x["i"]).alias("neg"), x["s"].alias("s"))))
    blank = F.struct(*(F.lit(False).alias(k) for k in ("valid_tool_call", *FIELDS, "all_match")))
    kind = "struct<" + ",".join(f"{k}:boolean" for k in ("valid_tool_call", *FIELDS, "all_match")) + ">"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{kind}>").alias("per"))

    def step(a: Column, row: Column) -> Column:
        best = F.array_max(F.filter(row, lambda x: ~F.array_contains(a["used"], -x["neg"])))
        used = F.when(best.isNotNull(), F.concat(a["used"], F.array(-best["neg"]))).otherwise(a["used"])
        return F.struct(used.alias("used"), F.concat(a["per"], F.array(F.coalesce(best["s"], blank).cast(kind))).alias("per"))

    folded = F.aggregate(grid, start, step, lambda a: a["per"])
    return let(F.struct(folded.alias("per"), n.alias("n"), F.size(expected).alias("m")), _call_score)


def _call_score(x: Column) -> Column:
    per, n = x["per"], x["n"]
    some = F.size(per) > 0
    flags = [(some & F.forall(per, _flag(k))).alias(k) for k in FIELDS]
    counts = n == x["m"]
    return F.struct((n > 0).alias("valid_tool_call"), x["m"].alias("expected_call_count"), n.alias("predicted_call_count"), counts.alias("tool_call_count_match"), *flags, (some & counts & F.forall(per, _flag("all_match"))).alias("all_match"), per.alias("per_expected"))


def _flag(k: str):
    return lambda x: x[k]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def selection(predicted: Column, expected: Column) -> Column:
    """Precision, recall and exactness against one list of ids."""
    p, e = F.array_distinct(predicted), F.array_distinct(expected)
    right = F.size(F.array_intersect(p, e))
    exact = F.when(F.size(e) > 0, F.array_sort(p) == F.array_sort(e)).otherwise(F.size(p) == 0)
    return F.struct(F.size(e).alias("expected_resource_count"), F.size(p).alias("predicted_resource_count"), right.alias("correct_resource_count"), _share(right, F.size(p)).alias("resource_precision"), _share(right, F.size(e)).alias("resource_recall"), exact.alias("resource_exact_match"))


def selection_by_need(predicted: Column, acceptable: Column) -> Column:
    """The same against one set of acceptable ids a need; needs without any are dropped, and correct counts needs."""
    p = F.array_distinct(predicted)
    needs = F.filter(acceptable, lambda x: F.size(x) > 0)
    every = F.array_distinct(F.flatten(needs))
    covered = F.size(F.filter(needs, lambda x: F.arrays_overlap(x, p)))
    invalid = F.array_except(p, every)
    exact = (F.size(needs) > 0) & (covered == F.size(needs)) & (F.size(invalid) == 0)
    sets = F.transform(needs, lambda x: F.array_sort(F.array_distinct(x)))
    return F.struct(F.size(needs).alias("expected_resource_count"), F.size(p).alias("predicted_resource_count"), covered.alias("correct_resource_count"), _share(F.size(p) - F.size(invalid), F.size(p)).alias("resource_precision"), _share(covered, F.size(needs)).alias("resource_recall"), exact.alias("resource_exact_match"), sets.alias("acceptable_resource_ids_by_need"), invalid.alias("invalid_resource_ids"))


def resolve_prefixes(predicted: Column, candidates: Column) -> Column:
    """Ids that are no candidate but the start of exactly one become that one; order kept, repeats dropped."""

    def one(p: Column) -> Column:
        starts = F.filter(F.array_distinct(candidates), lambda c: c.startswith(p))
        return F.when(F.coalesce(F.array_contains(candidates, p), F.lit(True)), p).otherwise(let(starts, lambda s: F.when(F.size(s) == 1, F.get(s, 0)).otherwise(p)))

    return F.array_distinct(F.transform(predicted, one))


def end_to_end(calls: Column, chosen: Column) -> Column:
    return calls["all_match"] & chosen["resource_exact_match"]
