"""Queries from recorded turns to scored records, and on the comparison of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls
from ..operators import assembly, rollup, search
from ..sources import directory as src
from ..sources import run_source, runs
from ..sources.storage import kept, scratch
from . import views as v
from .evaluation_queries import _METRICS, _MISSED, _bar, _t
from .registry import query

#: What goes wrong in a recorded conversation, by the order's key: a number that doesn't divide it leaves the thing right.
NO_CALL, TWICE, OTHER_TYPE, OTHER_PLACE, ALSO_WRONG, SHORT_ID, NO_ANSWER = 11, 7, 5, 3, 13, 2, 17


def _recorded(spark, sf_dir):
    """Turns of one conversation an order: an opening, a call for the order's status and clerk, its result, an answer, and a turn too many."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conv_id"), "o_orderstatus", "o_orderpriority")
    k = F.col("conv_id")
    wrong = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    call = F.concat(
        F.lit('<tool_call>{"name":"search_resources","arguments":{"service_categories":["'), wrong(OTHER_TYPE, F.lit("none such"), F.col("o_orderstatus")), F.lit('"],"counties":["'),
        wrong(OTHER_PLACE, F.lit("Far"), F.lower("o_orderpriority")), F.lit('"]}}</tool_call>'),
    )
    asks = F.when(k % NO_CALL == 0, "<think>no</think> Where are you?").otherwise(F.concat(F.lit("<think>search</think>"), call, F.when(k % TWICE == 0, call).otherwise("")))
    answer = F.when(k % NO_ANSWER == 0, "Nothing found.").otherwise(F.concat(F.lit("Go to in211-"), k, F.when(k % SHORT_ID == 0, "").otherwise("-food"), F.when(k % ALSO_WRONG == 0, F.concat(F.lit(" or in211-x"), k)).otherwise("")))
    said = [("user", F.lit("hello")), ("assistant", asks), ("user", F.lit("Tool result")), ("assistant", answer), ("user", F.lit("thanks")), ("assistant", F.lit("in211-0-0"))]
    turns = F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role"), t.cast("string").alias("text")) for i, (r, t) in enumerate(said))))
    return o.select("conv_id", turns.alias("t")).select("conv_id", "t.*")


def _cases(spark, sf_dir):
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    none = F.array().cast("array<string>")
    args = F.struct(F.array("o_orderstatus").alias("service_categories"), F.array("o_orderpriority").alias("counties"), *(none.alias(c) for c in calls.LISTS[2:]), F.lit(None).alias("schedule")).cast(calls.ARGS)
    right = F.concat(F.lit("in211-"), k, F.lit("-food"))
    return o.select(
        k.alias("conv_id"), F.concat(F.lit("spec-"), k).alias("user_spec_id"), src.pick(src.BEHAVIORS, k).alias("user_behavior"), F.lit(None).cast("string").alias("case_type"), F.lit("").alias("constraint_profile"),
        F.array(calls.normalize_args(args)).alias("expected"), F.array(F.array(right, F.lit("in211-other"))).alias("acceptable"),
    ), o.select(k.alias("conv_id"), F.lit(1).alias("call_index"), F.array(right, F.concat(F.lit("in211-z"), k)).alias("ids"))


def _records(spark, sf_dir):
    specs, results = _cases(spark, sf_dir)
    return assembly.assemble(assembly.spoken(_recorded(spark, sf_dir)), specs, results)


_ASSEMBLED = f"""k AS (SELECT o_orderkey AS conv_id, {v.pick(src.BEHAVIORS, 'o_orderkey')} AS user_behavior, o_orderkey % {NO_CALL} <> 0 AS called, o_orderkey % {TWICE} <> 0 AS once, o_orderkey % {OTHER_TYPE} <> 0 AS typed,
  o_orderkey % {OTHER_PLACE} <> 0 AS placed, o_orderkey % {NO_ANSWER} <> 0 AS said, o_orderkey % {ALSO_WRONG} <> 0 AS clean FROM orders),
asm AS (SELECT conv_id, user_behavior, CASE WHEN called THEN 'qwen_xml' ELSE 'none' END AS parse_mode, CASE WHEN NOT called THEN 0 WHEN once THEN 1 ELSE 2 END AS predicted_call_count, called AS valid_tool_call,
  called AND once AS tool_call_count_match, called AND typed AS service_match, called AND placed AS location_match, called AND once AND typed AND placed AS all_match,
  called AND said AS answered, called AND said AND clean AS resource_exact_match, CASE WHEN NOT (called AND said) THEN 0.0::DOUBLE WHEN clean THEN 1 ELSE 0.5 END AS resource_precision,
  called AND once AND typed AND placed AND said AND clean AS end_to_end_match, CASE WHEN called THEN 2 ELSE 3 END AS agent_turns, CASE WHEN called THEN 2 ELSE 3 END AS user_messages FROM k)"""


@query(f"""WITH {_ASSEMBLED} SELECT conv_id, user_behavior, 'single' AS case_type, 'all_hard' AS constraint_profile, parse_mode, valid_tool_call, tool_call_count_match, service_match, location_match, all_match, predicted_call_count,
  resource_exact_match, resource_precision, CASE WHEN answered THEN 1.0::DOUBLE ELSE 0 END AS resource_recall, end_to_end_match, agent_turns, user_messages,
  CASE WHEN answered THEN 'in211-' || conv_id || '-food' || CASE WHEN conv_id % {ALSO_WRONG} = 0 THEN '|in211-x' || conv_id ELSE '' END ELSE '' END AS chosen FROM asm""")
def assembled_records(spark, sf_dir):
    """Recorded turns of every order to a scored record: calls read, answer found, ids completed, both scores and their sum."""
    r = _records(spark, sf_dir)
    flat = ("valid_tool_call", "tool_call_count_match", "service_match", "location_match", "all_match", "predicted_call_count", "resource_exact_match", "resource_precision", "resource_recall", "end_to_end_match")
    counts = (F.size("raw_agent_outputs").alias("agent_turns"), F.size(F.filter("messages", lambda m: m["role"] == "user")).alias("user_messages"))
    return r.select("conv_id", "user_behavior", "case_type", "constraint_profile", "parse_mode", *(F.col(f"score.{c}").alias(c) for c in flat), *counts, _bar(F.col("predicted_resource_ids")).alias("chosen"))


@query(f"""WITH {_ASSEMBLED} SELECT user_behavior, count(*) AS n, avg(end_to_end_match::INT::DOUBLE) AS end_to_end_match_rate, avg(service_match::INT::DOUBLE) AS service_match_rate, avg(resource_precision) AS resource_precision_avg,
  avg(predicted_call_count::DOUBLE) AS predicted_tool_call_count_avg FROM asm GROUP BY 1""")
def assembled_summary(spark, sf_dir):
    """From recorded turns to the summary by behaviour in one plan."""
    s = rollup.summary(assembly.measures(_records(spark, sf_dir))).where("level = 'user_behavior'")
    return s.select("user_behavior", "n", "end_to_end_match_rate", "service_match_rate", "resource_precision_avg", "predicted_tool_call_count_avg")


def _said(spark, sf_dir):
    """(turns, cases) of a conversation with each customer, whose agent asks for what the customer needs and answers from what the directory has, both at times amiss."""
    asked = src.requests(spark, sf_dir)
    none, k = F.array().cast("array<string>"), F.col("conv_id")
    args = F.struct(*(F.col(c) for c in calls.LISTS), "schedule").cast(calls.ARGS)
    a = asked.join(search.acceptable_ids(src.resources(spark, sf_dir), asked), "request_id").select(F.col("request_id").alias("conv_id"), args.alias("args"), "ids")
    a = kept(a, "needs")
    far = F.struct(*(F.array(F.lit("Far")).alias(c) if c == "counties" else none.alias(c) if c in ("cities", "zipcodes") else F.col(f"args.{c}") for c in calls.LISTS), "args.schedule")
    block = F.concat(F.lit('<tool_call>{"name":"search_resources","arguments":'), F.when(k % OTHER_PLACE == 0, F.to_json(far)).otherwise(F.to_json("args")), F.lit("}</tool_call>"))
    asks = F.when(k % NO_CALL == 0, "<think>no</think> Where are you?").otherwise(F.concat(F.lit("<think>search</think>"), block, F.when(k % TWICE == 0, block).otherwise("")))
    best = F.get("ids", 0)
    named = F.concat(F.lit("Go to "), F.when(k % SHORT_ID == 0, F.regexp_extract(best, "^in211-[0-9]+-[0-9]+", 0)).otherwise(best), F.when(k % ALSO_WRONG == 0, F.concat(F.lit(" or in211-x"), k)).otherwise(""))
    answer = F.when((k % NO_ANSWER == 0) | (F.size("ids") == 0), "Nothing found.").otherwise(named)
    said = [("user", F.lit("hello")), ("assistant", asks), ("user", F.lit("Tool result")), ("assistant", answer), ("user", F.lit("thanks")), ("assistant", F.lit("in211-0-0"))]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role"), t.cast("string").alias("text")) for i, (r, t) in enumerate(said))))
    case = (F.concat(F.lit("spec-"), k).alias("user_spec_id"), src.pick(src.BEHAVIORS, k).alias("user_behavior"), F.lit(None).cast("string").alias("case_type"), F.when(k % 2 == 0, "acceptable").otherwise("").alias("constraint_profile"))
    return a.select("conv_id", each.alias("t")).select("conv_id", "t.*"), a.select("conv_id", *case, F.array(calls.normalize_args(F.col("args"))).alias("expected"))


def _evaluated(spark, sf_dir):
    turns, cases = _said(spark, sf_dir)
    return assembly.evaluated(turns, cases, src.resources(spark, sf_dir))


_RETURNED = "list_filter(returned, lambda c: starts_with(c, p))"
_EVALUATED = f"""{v.hits()}, found AS (SELECT request_id AS k, coalesce(list(resource_id ORDER BY rank) FILTER (resource_id IS NOT NULL), []) AS ids FROM req LEFT JOIN (SELECT * FROM top WHERE rank <= 10) USING (request_id) GROUP BY 1),
said AS (SELECT k, ids, k % {NO_CALL} <> 0 AS called, k % {TWICE} <> 0 AS once, k % {OTHER_PLACE} <> 0 AS placed, CASE WHEN k % {NO_ANSWER} = 0 OR len(ids) = 0 OR k % {NO_CALL} = 0 THEN []
  ELSE list_concat([CASE WHEN k % {SHORT_ID} = 0 THEN regexp_extract(ids[1], '^in211-[0-9]+-[0-9]+') ELSE ids[1] END], CASE WHEN k % {ALSO_WRONG} = 0 THEN ['in211-x' || k] ELSE [] END) END AS named FROM found),
given AS (SELECT *, CASE WHEN called AND placed THEN ids ELSE [] END AS returned FROM said),
named AS (SELECT k, unnest(named) AS p, generate_subscripts(named, 1) AS pos, returned FROM given),
done AS (SELECT k, list(CASE WHEN NOT list_contains(returned, p) AND len({_RETURNED}) = 1 THEN {_RETURNED}[1] ELSE p END ORDER BY pos) AS chosen FROM named GROUP BY 1),
picked AS (SELECT given.*, coalesce(chosen, []) AS chosen, coalesce(len(list_intersect(chosen, ids)), 0) AS hit FROM given LEFT JOIN done USING (k)),
ev AS (SELECT k AS conv_id, {v.pick(src.BEHAVIORS, 'k')} AS user_behavior, 'single' AS case_type, CASE WHEN k % 2 = 0 THEN 'acceptable' ELSE 'all_hard' END AS constraint_profile, CASE WHEN called THEN 'qwen_xml' ELSE 'none' END AS parse_mode,
  called AS valid_tool_call, called AND once AS tool_call_count_match, called AS service_match, called AND placed AS location_match, called AS schedule_match, called AS intake_match, called AS documents_match, called AS eligibility_match,
  called AND once AND placed AS all_match, CASE WHEN NOT called THEN 0 WHEN once THEN 1 ELSE 2 END AS predicted_call_count, hit > 0 AND hit = len(chosen) AS resource_exact_match, called AND once AND placed AND hit > 0 AND hit = len(chosen) AS end_to_end_match,
  CASE WHEN len(chosen) = 0 THEN 0.0::DOUBLE ELSE hit::DOUBLE / len(chosen) END AS resource_precision, CASE WHEN hit > 0 THEN 1.0::DOUBLE ELSE 0 END AS resource_recall, array_to_string(chosen, '|') AS chosen, array_to_string(ids, '|') AS acceptable FROM picked)"""


@query(f"WITH {_EVALUATED} SELECT * FROM ev")
def recorded_run(spark, sf_dir):
    """Recorded turns with every customer: calls read and run against the directory, the answer's ids completed, both scores."""
    kept_columns = ("valid_tool_call", "tool_call_count_match", "service_match", "location_match", "schedule_match", "intake_match", "documents_match", "eligibility_match", "all_match", "predicted_call_count", "resource_exact_match", "end_to_end_match", "resource_precision", "resource_recall")
    need = F.coalesce(F.get("acceptable_resource_ids_by_need", 0), F.array().cast("array<string>"))
    return _evaluated(spark, sf_dir).select("conv_id", "user_behavior", "case_type", "constraint_profile", "parse_mode", *(F.col(f"score.{c}").alias(c) for c in kept_columns), _bar(F.col("predicted_resource_ids")).alias("chosen"), _bar(need).alias("acceptable"))


@query(f"""WITH {_EVALUATED} SELECT user_behavior, case_type, constraint_profile, parse_mode, {_METRICS},
  CASE GROUPING(user_behavior, case_type, constraint_profile, parse_mode) WHEN 1 THEN 'cell' WHEN 7 THEN 'user_behavior' WHEN 11 THEN 'case_type' WHEN 13 THEN 'constraint_profile' WHEN 14 THEN 'parse_mode' ELSE 'overall' END AS level
FROM ev GROUP BY GROUPING SETS ((user_behavior, case_type, constraint_profile), (user_behavior), (case_type), (constraint_profile), (parse_mode), ())""")
def recorded_run_summary(spark, sf_dir):
    """The whole of an evaluation: turns, calls, search, records, and the summary of all levels."""
    return rollup.summary(assembly.measures(_evaluated(spark, sf_dir)))


@query(f"""WITH {v.REC}, m AS (SELECT 'base' AS method, * FROM rec UNION ALL SELECT 'longer', * REPLACE (agent_turns + 1 AS agent_turns, NOT valid_tool_call AS valid_tool_call) FROM rec
UNION ALL SELECT 'no-xml', * REPLACE (CASE WHEN parse_mode = 'qwen_xml' THEN 'none' ELSE parse_mode END AS parse_mode) FROM rec)
SELECT method, {_METRICS}, count_if(parse_mode = 'none') AS parse_none, avg((parse_mode = 'none')::INT::DOUBLE) AS parse_none_rate, avg(agent_turns) AS agent_turns_avg, {_MISSED} FROM m GROUP BY 1""")
def runs_by_method(spark, sf_dir):
    """Three runs, written to folders of their own and read back as one table, side by side."""
    r, root = src.records(spark, sf_dir), scratch(spark, "runs")
    made = {
        "base": r, "longer": r.withColumns({"agent_turns": F.col("agent_turns") + 1, "valid_tool_call": ~F.col("valid_tool_call")}),
        "no-xml": r.withColumn("parse_mode", F.when(F.col("parse_mode") == "qwen_xml", "none").otherwise(F.col("parse_mode"))),
    }
    for name, df in made.items():
        runs.write_run(f"{root}/{name}", {"run_name": name}, df.select("user_spec_id", "case_type", "constraint_profile").distinct(), df, rollup.overall(df).head().asDict())
    return rollup.method_table(run_source.read_runs(spark, root, ", ".join(f"{c} {t}" for c, t in r.dtypes)).withColumnRenamed(run_source.NAME, "method"))


@query(f"""WITH {v.REC}, m AS (SELECT 'a' AS method, * FROM rec UNION ALL SELECT 'b', * REPLACE (agent_turns + 1 AS agent_turns, NOT valid_tool_call AS valid_tool_call) FROM rec)
SELECT method, {_METRICS}, count_if(parse_mode = 'none') AS parse_none, avg((parse_mode = 'none')::INT::DOUBLE) AS parse_none_rate, avg(agent_turns) AS agent_turns_avg, {_MISSED} FROM m GROUP BY 1""")
def comparison_tables(spark, sf_dir):
    """What the comparison report says of each of two runs as a whole."""
    r = src.records(spark, sf_dir)
    other = r.withColumns({"agent_turns": F.col("agent_turns") + 1, "valid_tool_call": ~F.col("valid_tool_call")})
    return rollup.method_table(rollup.concat_runs({"a": r, "b": other}))


@query("""WITH s AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), c AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)
SELECT 'site' AS "key", n, count(*) AS keys FROM s WHERE n = (SELECT max(n) FROM s) GROUP BY 2 UNION ALL SELECT 'agency', n, count(*) FROM c WHERE n = (SELECT max(n) FROM c) GROUP BY 2""")
def most_per_site_and_agency(spark, sf_dir):
    """The most services of one site and the most sites of one agency, with the number of keys that have so many."""
    site = rollup.most_per(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    agency = rollup.most_per(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return site.select(F.lit("site").alias("key"), "n", "keys").unionByName(agency.select(F.lit("agency").alias("key"), "n", "keys"))
