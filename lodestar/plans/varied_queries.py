"""Schedules, places, chosen resources and calls that differ from row to row, with the rules worked out anew in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls, schedule, scoring
from ..sources import directory as src
from .evaluation_queries import _call, _t
from .registry import query


def _div(c, n: int):
    return F.call_function("div", c, F.lit(n))


_FULL = ("Monday", "Tues", "Wednesday", "thur", "FRIDAY", "Sat", "sunday")
_FROM, _TO = "k * 37 % 1440", "(k * 53 + 11) % 1440"


def _clock(minute):
    """``9am`` or ``12:05 pm``: the minute is left out if it is nought."""
    hour, rest = _div(minute, 60) % 12, minute % 60
    return F.concat(F.when(hour == 0, 12).otherwise(hour).cast("string"), F.when(rest == 0, "").otherwise(F.format_string(":%02d", rest)), F.when(rest % 2 == 0, "").otherwise(" "), F.when(minute < 720, "am").otherwise("pm"))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 7 AS a, o_orderkey // 7 % 7 AS b, o_orderkey % 4 AS form FROM orders), t AS (SELECT *, {_FROM} AS s, {_TO} AS e FROM o),
w AS (SELECT o_orderkey, d, s, e FROM t, range(7) r(d) WHERE CASE form WHEN 0 THEN (d - a + 7) % 7 <= (b - a + 7) % 7 WHEN 1 THEN d IN (a, b) WHEN 2 THEN d = a ELSE TRUE END UNION SELECT o_orderkey, b, e, s FROM t WHERE form = 2)
SELECT o_orderkey, ['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'][d + 1] AS day, CAST(s AS INT) AS start_minute, CAST(e AS INT) AS end_minute FROM w""")
def schedule_windows_by_row(spark, sf_dir):
    """Opening hours of every order, in four forms, with days, spellings and minutes that follow the key; ranges go over Sunday and over midnight."""
    k = F.col("k")
    name = lambda d: F.when(k % 3 == 0, src.pick(schedule.DAYS, d)).otherwise(src.pick(_FULL, d))
    a, b, s, e = name(k % 7), name(_div(k, 7) % 7), _clock(F.expr(_FROM)), _clock(F.expr(_TO))
    hours = F.concat(F.lit(" "), s, F.when(k % 5 == 0, " – ").otherwise("-"), e)
    back = F.concat(F.lit(" "), e, F.lit("-"), s)
    said = F.when(k % 4 == 0, F.concat(a, F.lit(" - "), b, hours)).when(k % 4 == 1, F.concat(a, F.lit(", "), b, hours)).when(k % 4 == 2, F.concat(a, hours, F.lit("; "), b, back)).otherwise(F.concat(F.lit("Daily"), hours))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("k")).select("o_orderkey", F.explode(schedule.schedule_windows(said)).alias("w"))
    return o.select("o_orderkey", "w.day", "w.start_minute", "w.end_minute")


def _place_sql(side: str, j: int, bits: int, kind: int, more: int) -> str:
    also = f"CASE WHEN k // {more} % 2 = 1 THEN ['W'] ELSE [] END" if j == 0 else "[]"
    return f"CASE WHEN k // {bits << j} % 2 = 1 THEN list_concat(['V' || ((k // {kind} + {j}) % 2)], {also}) ELSE [] END AS {side}{j}"


#: Bits of the key: which fields are given, of which kind, and whether the first has a second value.
_EXPECTS, _PREDICTS = (1, 64, 256), (8, 128, 512)
_SAME = [f"(len(p{j}) > 0 AND list_sort(p{j}) = list_sort(e{j}))" for j in range(3)]
_NONE = " AND ".join(f"len(p{j}) = 0" for j in range(3))
_EACH = " AND ".join(f"CASE WHEN len(e{j}) > 0 THEN {_SAME[j]} ELSE len(p{j}) = 0 END" for j in range(3))
_INSIDE = " AND ".join(f"list_has_all(e{j}, p{j})" for j in range(3))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey AS k FROM orders), s AS (SELECT o_orderkey, {', '.join(_place_sql(side, j, *how) for side, how in (('e', _EXPECTS), ('p', _PREDICTS)) for j in range(3))} FROM o),
n AS (SELECT *, (len(e0) > 0)::INT + (len(e1) > 0)::INT + (len(e2) > 0)::INT AS n FROM s)
SELECT o_orderkey, CASE n WHEN 0 THEN {_NONE} WHEN 1 THEN {_EACH} ELSE {_INSIDE} AND ({' OR '.join(_SAME)}) END AS location_match FROM n""")
def location_score_by_row(spark, sf_dir):
    """Places asked for and expected, in all combinations of fields, kinds and second values."""
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    even = lambda n: _div(k, n) % 2 == 1

    def side(bits: int, kind: int, more: int):
        one = lambda j: F.array(F.concat(F.lit("V"), ((_div(k, kind) + j) % 2).cast("string")))
        first = F.concat(one(0), F.when(even(more), F.array(F.lit("W"))).otherwise(none))
        return F.struct(*(F.when(even(bits << j), first if j == 0 else one(j)).otherwise(none).alias(c) for j, c in enumerate(scoring.PLACES)))

    o = _t(spark, sf_dir, "orders").select("o_orderkey", side(*_EXPECTS).alias("e"), side(*_PREDICTS).alias("p"))
    return o.select("o_orderkey", scoring.location_matches(F.col("p"), F.col("e")).alias("location_match"))


_TAKEN, _NEEDED = "(l_partkey + l_orderkey) % 3 <> 0", "l_linenumber % 4 <> 0 AND NOT (l_orderkey % 7 = 0 AND l_linenumber <= 2)"


@query(f"""WITH pred AS (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS id FROM lineitem WHERE {_TAKEN} UNION SELECT l_orderkey, 'x' FROM lineitem WHERE l_orderkey % 5 = 0),
acc AS (SELECT DISTINCT l_orderkey, (l_linenumber + 1) // 2 AS need, l_partkey::VARCHAR AS id FROM lineitem WHERE {_NEEDED}),
a AS (SELECT l_orderkey, count(DISTINCT need) AS needs, count(DISTINCT need) FILTER (pred.id IS NOT NULL) AS covered FROM acc LEFT JOIN pred USING (l_orderkey, id) GROUP BY 1),
p AS (SELECT l_orderkey, count(*) AS n, count_if(EXISTS (SELECT 1 FROM acc WHERE acc.l_orderkey = pred.l_orderkey AND acc.id = pred.id)) AS good FROM pred GROUP BY 1),
j AS (SELECT l_orderkey, coalesce(needs, 0) AS needs, coalesce(covered, 0) AS covered, coalesce(n, 0) AS n, coalesce(good, 0) AS good FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN a USING (l_orderkey) LEFT JOIN p USING (l_orderkey))
SELECT l_orderkey, needs::INT AS needs, covered::INT AS covered, CASE WHEN n > 0 THEN good / n ELSE 0 END AS resource_precision, CASE WHEN needs > 0 THEN covered / needs ELSE 0 END AS resource_recall,
  needs > 0 AND covered = needs AND good = n AS resource_exact_match FROM j""")
def selection_by_need_by_row(spark, sf_dir):
    """Parts of an order as the resources chosen, pairs of its lines as needs; some needs accept nothing."""
    i = F.col("l_partkey").cast("string")
    need = _div(F.col("l_linenumber") + 1, 2)
    o = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.expr(_TAKEN), i)).alias("p"), F.collect_list(F.when(F.expr(_NEEDED), F.struct(need.alias("need"), i.alias("id")))).alias("x"), F.max(need).alias("most"),
    )
    ids = lambda n: F.transform(F.filter("x", lambda x: x["need"] == n), lambda x: x["id"])
    p = F.when(F.col("l_orderkey") % 5 == 0, F.concat("p", F.array(F.lit("x")))).otherwise(F.col("p"))
    s = o.select("l_orderkey", scoring.selection_by_need(p, F.transform(F.sequence(F.lit(1).cast("long"), F.col("most").cast("long")), ids)).alias("s"))
    return s.select("l_orderkey", F.col("s.expected_resource_count").alias("needs"), F.col("s.correct_resource_count").alias("covered"), *(F.col(f"s.{c}").alias(c) for c in ("resource_precision", "resource_recall", "resource_exact_match")))


_BEST = "row_number() OVER (PARTITION BY o_orderkey ORDER BY s::INT + l::INT + g::INT DESC, i)"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey AS k FROM orders),
pair AS (SELECT o_orderkey, e, i, (k // 4 + e) % 3 = (k // 12 + i) % 3 AS s, (k // 36 + e) % 2 = (k // 72 + i) % 2 AS l, (k // 144 + i) % 2 = 0 AS g FROM o, range(2) x(e), range(3) y(i) WHERE i < k % 4),
first AS (SELECT * FROM pair WHERE e = 0 QUALIFY {_BEST} = 1),
second AS (SELECT pair.* FROM pair JOIN first USING (o_orderkey) WHERE pair.e = 1 AND pair.i <> first.i QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY pair.s::INT + pair.l::INT + pair.g::INT DESC, pair.i) = 1),
f AS (SELECT o_orderkey, k % 4 AS n, second.i IS NOT NULL AS two, coalesce(first.s AND second.s, FALSE) AS s, coalesce(first.l AND second.l, FALSE) AS l, coalesce(first.g AND second.g, FALSE) AS g FROM o LEFT JOIN first USING (o_orderkey) LEFT JOIN second USING (o_orderkey))
SELECT o_orderkey, n > 0 AS valid_tool_call, n = 2 AS tool_call_count_match, s AS service_match, l AS location_match, g AS eligibility_match, two AS schedule_match, n = 2 AND s AND l AND g AS all_match, n::INT AS predicted_call_count FROM f""")
def greedy_match_by_row(spark, sf_dir):
    """None to three calls against two expected ones, whose categories, counties and eligibility meet in all combinations."""
    k = F.col("o_orderkey")
    word = lambda letter, by, n, i: F.concat(F.lit(letter), ((_div(k, by) + i) % n).cast("string"))
    want = F.array(*(_call(k, word("s", 4, 3, e), word("C", 36, 2, e)) for e in range(2)))
    made = F.array(*(_call(k, word("s", 12, 3, i), word("C", 72, 2, i), elig=F.when((_div(k, 144) + i) % 2 == 0, "senior").otherwise("youth")) for i in range(3)))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", calls.normalize_calls(F.slice(made, F.lit(1), (k % 4).cast("int"))).alias("p"), calls.normalize_calls(want).alias("e"))
    s = o.select("o_orderkey", scoring.score_calls(F.col("p"), F.col("e")).alias("s"))
    return s.select("o_orderkey", *(F.col(f"s.{c}").alias(c) for c in ("valid_tool_call", "tool_call_count_match", "service_match", "location_match", "eligibility_match", "schedule_match", "all_match", "predicted_call_count")))
