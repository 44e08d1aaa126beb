"""Recorded turns become scored records, reports and the folder of a run."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import calls
from lodestar.operators import assembly, rollup
from lodestar.sources import directory as src
from lodestar.sources import runs

SF = "/root/testdata/sf0.001"
CALL = '<tool_call>{"name":"search_resources","arguments":{"service_categories":["%s"],"counties":["%s"]}}</tool_call>'
TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "<think>x</think> Where?"), (1, 2, "user", "there"), (1, 3, "assistant", "ok " + CALL % ("Food", "Lake")),
    (1, 4, "user", "Tool result"), (1, 5, "assistant", "Take in211-1-2 please"), (1, 6, "user", "late"), (1, 7, "assistant", "in211-9-9"),
    (2, 0, "user", "hi"), (2, 1, "assistant", CALL % ("Rent", "Lake") + CALL % ("Food", "Lake")), (2, 2, "user", None), (2, 3, "assistant", "in211-5-5-a"),
    (3, 0, "user", "hi"), (3, 1, "assistant", None),
    *((4, i, "assistant", f"question {i}") for i in range(12)),
]


def made(spark):
    said = assembly.spoken(spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string"))
    need = spark.createDataFrame([(c, f"s{c}", "normal", None, "", ["Food"], [["in211-1-2-food"], []]) for c in (1, 2, 3, 4, 5)], "conv_id long, user_spec_id string, user_behavior string, case_type string, constraint_profile string, cats array<string>, acceptable array<array<string>>")
    none = F.array().cast("array<string>")
    args = F.struct(F.col("cats").alias("service_categories"), F.array(F.lit("LAKE")).alias("counties"), *(none.alias(c) for c in calls.LISTS[2:]), F.lit(None).alias("schedule"))
    specs = need.withColumn("expected", F.array(calls.normalize_args(args.cast(calls.ARGS)))).drop("cats")
    results = spark.createDataFrame([(1, 1, ["in211-1-2-food", "in211-3-3"]), (2, 1, [])], "conv_id long, call_index int, ids array<string>")
    return said, assembly.assemble(said, specs, results)


def test_records(spark):
    got = {r["conv_id"]: r for r in made(spark)[1].collect()}
    a, b, c, d, e = (got[i] for i in range(1, 6))
    assert (a["final_text"], a["predicted_resource_ids"], a["score"]["end_to_end_match"]) == ("Take in211-1-2 please", ["in211-1-2-food"], True)
    assert [m["content"] for m in a["messages"]] == ["hello", "Where?", "there", TURNS[3][3], "Tool result", "Take in211-1-2 please"]
    assert a["raw_agent_outputs"][0] == "<think>x</think> Where?" and len(a["raw_agent_outputs"]) == 3
    assert (a["user_id"], a["case_type"], a["constraint_profile"], a["parse_modes"]) == ("s1__normal", "single", "all_hard", ["qwen_xml"])
    assert [x["service_categories"] for x in b["predicted_tool_calls"]] == [["Rent"], ["Food"]]
    assert (b["score"]["tool_call_count_match"], b["score"]["service_match"], b["score"]["resource_precision"], b["final_text"]) == (False, True, 0.0, "in211-5-5-a")
    assert (c["parse_mode"], c["final_text"], len(c["messages"]), c["score"]["valid_tool_call"]) == ("none", "", 2, False)
    assert len(d["raw_agent_outputs"]) == assembly.MOST_TURNS and d["final_text"] == ""
    assert (e["messages"], e["predicted_tool_calls"], e["score"]["end_to_end_match"]) == ([], [], False)


def test_measures_and_report(spark):
    flat = assembly.measures(made(spark)[1])
    assert rollup.overall(flat).head()["end_to_end_match_rate"] == pytest.approx(0.2)
    assert rollup.turn_stats(flat).head()["agent_turns_max"] == 8
    text = rollup.comparison_report({"new": flat, "old": flat.where("user_spec_id = 's1'")})
    assert "| old | 1 | 1.000 |" in text and "| new | normal | 5 | 0.200 |" in text and "| new | 3 | 0.600 | 2.80 |" in text
    assert [x for x in text.splitlines() if x.startswith("## ")] == ["## Overall", "## By Behavior", "## Diagnostics", "## Field Failures"]
    with pytest.raises(ValueError):
        rollup.markdown(spark.range(3), "t", most=2)


def test_calls_are_executed(spark):
    res = src.resources(spark, SF)
    r = res.where(F.size("counties") > 0).orderBy("resource_id").head()
    turns = spark.createDataFrame([(7, 1, "assistant", CALL % (r["service_categories"][0], r["counties"][0])), (7, 2, "assistant", CALL % ("nothing such", "x")), (7, 3, "assistant", CALL % ("late", "x"))], "conv_id long, turn int, role string, text string")
    got = {x["call_index"]: x["ids"] for x in assembly.executed(assembly.spoken(turns, most=2), res, 20).collect()}
    cat, county = r["service_categories"][0].lower(), r["counties"][0].lower()
    want = {x["resource_id"] for x in res.collect() if cat in [c.lower() for c in x["service_categories"]] and county in [c.lower() for c in x["counties"]]}
    assert set(got) == {1, 2} and got[2] == [] and set(got[1]) <= want and len(got[1]) == min(20, len(want))


def test_one_search_for_calls_made_and_expected(spark):
    res = src.resources(spark, SF)
    r = res.where("size(counties) > 0 AND size(service_categories) > 0").orderBy("resource_id").head()
    cat, county = r["service_categories"][0], r["counties"][0]
    good = [i for (i,) in assembly.executed(assembly.spoken(spark.createDataFrame([(1, 0, "assistant", CALL % (cat, county))], "conv_id long, turn int, role string, text string")), res).select("ids").collect()][0]
    turns = [(1, 0, "assistant", CALL % (cat, county)), (1, 1, "assistant", good[-1]), (2, 0, "assistant", CALL % ("none such", county)), (2, 1, "assistant", good[0]), (4, 0, "user", "hi")]
    turns = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    none = F.array().cast("array<string>")
    args = lambda c: F.struct(F.array(F.lit(c)).alias("service_categories"), F.array(F.lit(county)).alias("counties"), *(none.alias(x) for x in calls.LISTS[2:]), F.lit(None).alias("schedule")).cast(calls.ARGS)
    both = F.array(calls.normalize_args(args(cat)), calls.normalize_args(args("none such")))
    k = F.col("conv_id")
    specs = spark.range(1, 6).withColumnRenamed("id", "conv_id").select(
        k, F.concat(F.lit("s"), k).alias("user_spec_id"), F.lit("normal").alias("user_behavior"), F.lit(None).cast("string").alias("case_type"), F.lit("").alias("constraint_profile"),
        F.when(k == 5, F.slice(both, 1, 0)).when(k == 2, both).otherwise(F.slice(both, 1, 1)).alias("expected"),
    )
    got = {x["conv_id"]: x for x in assembly.evaluated(turns, specs, res).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1]["score"]["end_to_end_match"] and got[1]["acceptable_resource_ids_by_need"] == [good]
    assert (got[2]["case_type"], got[2]["acceptable_resource_ids_by_need"], got[2]["predicted_resource_ids"], got[2]["score"]["resource_precision"], got[2]["score"]["all_match"]) == ("composite", [good, []], [good[0]], 1.0, False)
    assert got[3]["acceptable_resource_ids_by_need"] == [good] and got[3]["predicted_tool_calls"] == [] and len(got[4]["messages"]) == 1
    assert got[5]["acceptable_resource_ids_by_need"] == [] and not got[5]["score"]["resource_exact_match"]


def test_empty(spark):
    said, records = made(spark)
    assert assembly.spoken(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    assert "## Overall" in rollup.comparison_report({"a": assembly.measures(records).limit(0)})


def test_run_folder(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    records = spark.range(3).select(F.col("id").alias("record_id"), F.lit(None).cast("string").alias("parse_mode"))
    specs = spark.createDataFrame([("s1", "é"), ("s2", None)], "user_spec_id string, note string")
    for _ in range(2):
        runs.write_run(path, {"seed": 1}, specs, records, {"cases": 3, "überschrift": None})
    summary, back = runs.read_run(spark, path, "record_id long, parse_mode string")
    assert summary == {"cases": 3, "überschrift": None} and sorted(r["record_id"] for r in back.collect()) == [0, 1, 2]
    assert runs.read_json(spark, f"{path}/{runs.ARGS}") == {"seed": 1}
    one = tmp_path / "specs.json"
    one.write_text(json.dumps([{"user_spec_id": "s1", "note": "é"}, {"user_spec_id": "s2", "note": None}]))
    load = lambda p: {tuple(r) for r in runs.load_or_generate(spark, p, "user_spec_id string, note string", lambda: specs).collect()}
    assert load(None) == load(f"file://{one}") == load(f"{path}/{runs.SPECS}")
    assert runs.run_name(spark, ["A b", "qwen/3", ""]) == "a-b__qwen-3__run"


def test_summary_of_a_run(spark):
    got = rollup.run_summary(assembly.measures(made(spark)[1]))
    assert got["cases"] == 5 and got["parse_modes"] == {"none": 3, "qwen_xml": 2}
    assert got["by_user_behavior"]["normal"]["n"] == 5 and got["by_case_type_constraint_behavior"]["single__all_hard__normal"]["end_to_end_match_rate"] == pytest.approx(0.2)
    assert got["turn_stats"]["agent_turns_max"] == 8 and got["failure_counts"]["end_to_end"] == 4
    assert json.loads(json.dumps(got)) == got
