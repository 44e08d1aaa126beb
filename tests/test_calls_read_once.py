"""Frequent outputs with calls are read once; which of them are known changes no result."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import calls, scoring, text
from lodestar.operators import assembly
from lodestar.sources import directory as src

from .test_assembly import CALL, TURNS


def said(spark):
    more = [(5, i, "assistant", CALL % ("Food", "Lake")) for i in range(3)] + [(6, 0, "user", CALL % ("Food", "Lake")), (6, 1, "assistant", "{no call}")]
    return assembly.spoken(spark.createDataFrame(TURNS + more, "conv_id long, turn int, role string, text string"))


def test_known_texts_change_nothing(spark, monkeypatch):
    every = said(spark)
    got = sorted(map(str, every.collect()))
    assert "approx_top_k" not in str(every) and "_text" in every._jdf.queryExecution().analyzed().toString()  # outputs are looked up
    assert sum(len(r["calls"]) for r in every.where("conv_id = 5").collect()) == 3 and every.where("conv_id = 6 AND size(calls) + size(asked) > 0").count() == 0
    monkeypatch.setattr(src, "FEW_TEXTS", 1)
    assert sorted(map(str, said(spark).collect())) == got
    known = src.frequent_texts(spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "t string"), "t").collect()
    assert [tuple(r) for r in known] == [("t", "b")]
    assert src.frequent_texts(spark.createDataFrame([(None,)], "t string"), "t").count() == 0


@pytest.mark.parametrize("t, clean", [("<tool_<think>x</think>call>{}</tool_call> a", "a"), (" a <think> ", "a <think>"), ("<tool_call> {1}\n</tool_call>b", "b"), (None, ""), (" c　", "c")])
def test_cleaning_looks_behind_reasoning(spark, t, clean):
    assert spark.createDataFrame([(t,)], "t string").select(calls.clean_tool_call_text(F.col("t"))).head()[0] == clean


def test_shortcuts(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a", "a"], ["a", None], None)], "a array<string>, b array<string>, n array<string>, z array<string>")
    same = lambda x, y: df.select(text.same_set(F.col(x), F.col(y))).head()[0]
    assert (same("a", "b"), same("a", "a"), same("a", "n"), same("n", "n"), same("a", "z"), same("z", "z")) == (True, True, False, True, None, None)
    assert df.select(scoring.resolve_prefixes(F.array(F.lit("a"), F.lit("")), F.col("n"))).head()[0] == ["a", ""]
