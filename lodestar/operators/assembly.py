"""Evaluation records from recorded turns: calls are read, executed and scored, and the answer's resources compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calls, scoring, transcript
from ..sources.directory import frequent_texts, read_once
from ..sources.storage import kept
from . import search

MOST_TURNS = 8


def _by(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order)


def spoken(turns: DataFrame, *, key: str = "conv_id", order: str = "turn", most: int = MOST_TURNS) -> DataFrame:
    """Turns as they belong to a record: (key, order, role, text, content, calls, asked, final).

    ``calls`` and ``asked`` are what scores and the search take of an agent's output. The first output without calls after
    one with calls is the ``final`` text; nothing after it belongs to the record, nor do outputs after the ``most``-th and
    what follows them. An output with calls is kept as it is, any other is cleaned.
    """
    agent = F.col("role") == "assistant"
    told = turns.select(key, order, "role", F.coalesce("text", F.lit("")).alias("text"), F.when(agent & F.col("text").contains("{"), F.col("text")).alias("_asking"))
    made = {"calls": calls.tagged_calls, "asked": calls.tagged_arguments}
    read = read_once(told, {k: ("_asking", f) for k, f in made.items()}, frequent_texts(told, "_asking")).drop("_asking")
    before = _by(key, order).rowsBetween(Window.unboundedPreceding, -1)
    nth = F.count_if(agent).over(_by(key, order).rowsBetween(Window.unboundedPreceding, 0))
    called = F.coalesce(F.sum(F.size("calls")).over(before), F.lit(0))
    marked = read.withColumns({"_nth": nth, "final": agent & (F.size("calls") == 0) & (called > 0)})
    ended = F.coalesce(F.count_if(F.col("final")).over(before), F.lit(0))
    content = F.when(agent & (F.size("calls") == 0), calls.clean_tool_call_text(F.col("text"))).otherwise(F.col("text"))
    return marked.withColumn("_ended", ended).where((F.col("_ended") == 0) & (F.col("_nth") <= most)).withColumn("content", content).drop("_nth", "_ended")


def _numbered(said: DataFrame, key: str, order: str) -> DataFrame:
    """The search's arguments of every call, the calls of a conversation counted from 1."""
    one = said.where(F.size("asked") > 0).select(key, order, F.posexplode("asked").alias("_at", "a"))
    numbered = one.withColumn("call_index", F.row_number().over(Window.partitionBy(key).orderBy(order, "_at")))
    return numbered.select(F.to_json(F.struct(F.col(key).alias("key"), "call_index")).alias("request_id"), key, "call_index", "a.*")


def executed(said: DataFrame, resources: DataFrame, limit: object = None, *, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, call_index, ids): what the search returns for every call of ``spoken`` turns, counted from 1 in a conversation."""
    asked = _numbered(said, key, order)
    found = search.acceptable_ids(resources, asked.drop(key, "call_index"), limit)
    return asked.select("request_id", key, "call_index").join(found, "request_id").select(key, "call_index", "ids")


def evaluated(turns: DataFrame, specs: DataFrame, resources: DataFrame, limit: object = None, *, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Recorded turns to scored records: the calls made and the calls expected run through one search of the directory.

    ``specs``: as ``assemble`` takes them, but for ``acceptable``, which is what the expected calls return. Turns are read once and
    kept, as are the search's results; a case without turns, or without expected calls, stays. ``resources``: as a search takes them.
    """
    said = kept(spoken(turns, key=key, order=order), "said")
    made = _numbered(said, key, order)
    need = specs.select(key, F.posexplode("expected").alias("need", "e"))
    clock = F.when(F.col("e.schedule").isNotNull(), F.struct(*(F.col(f"e.schedule.{c}").alias(c) for c in ("day", "start_time", "end_time", "time", "requires_24_hours"))))
    need = need.select(F.to_json(F.struct(F.col(key).alias("key"), "need")).alias("request_id"), key, "need", *(F.col(f"e.{c}").alias(c) for c in calls.LISTS), clock.alias("schedule"))
    found = kept(search.acceptable_ids(resources, made.drop(key, "call_index").unionByName(need.drop(key, "need")), limit), "found")
    results = made.select("request_id", key, "call_index").join(found, "request_id").select(key, "call_index", "ids")
    listed = need.select("request_id", key, "need").join(found, "request_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("need", "ids"))).alias("x"))
    return assemble(said, specs.join(listed.select(key, F.col("x.ids").alias("acceptable")), key, "left"), results, key=key, order=order)


def assemble(said: DataFrame, specs: DataFrame, results: DataFrame, *, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One record for each row of ``specs``, scored.

    ``said``: as ``spoken`` returns it. ``specs``: key, user_spec_id, user_behavior, case_type, constraint_profile,
    ``expected`` (normalised arguments of the expected calls) and ``acceptable`` (a list of ids a need). ``results``: as
    ``executed`` returns it. A case without turns has no calls and an empty answer; NULL case types follow the number of
    expected calls, a NULL profile is ``all_hard``.
    """
    turn = F.struct(F.col(order).alias("turn"), "role", "text", "content", "calls", "final")
    whole = said.groupBy(key).agg(F.array_sort(F.collect_list(turn), lambda a, b: (F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0))).alias("said"))
    ids = results.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("returned"))
    j = specs.join(whole, key, "left").join(ids, key, "left")
    outputs = F.filter("said", lambda m: m["role"] == "assistant")
    read = F.coalesce(F.flatten(F.transform(outputs, lambda m: m["calls"])), F.array().cast(calls.CALLS))
    final = F.coalesce(F.get(F.transform(F.filter("said", lambda m: m["final"]), lambda m: m["content"]), 0), F.lit(""))
    j = j.withColumns({"calls": read, "final_text": final, "returned": F.coalesce("returned", F.array().cast("array<string>")), "acceptable": F.coalesce("acceptable", F.array().cast("array<array<string>>"))})
    j = j.withColumns({"predicted": F.transform("calls", lambda c: c["arguments"]), "modes": F.transform("calls", lambda c: c["parse_mode"]), "chosen": scoring.resolve_prefixes(calls.selected_ids(F.col("final_text")), F.col("returned"))})
    j = j.withColumns({"_tool": scoring.score_calls(F.col("predicted"), F.col("expected")), "_choice": scoring.selection_by_need(F.col("chosen"), F.col("acceptable"))})
    messages = F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    score = F.struct("_tool.*", "_choice.*", scoring.end_to_end(F.col("_tool"), F.col("_choice")).alias("end_to_end_match"))
    return j.select(
        key, "user_spec_id", F.concat_ws("__", "user_spec_id", "user_behavior").alias("user_id"), "user_behavior",
        F.coalesce(F.nullif("case_type", F.lit("")), F.when(F.size("expected") > 1, "composite").otherwise("single")).alias("case_type"), F.coalesce(F.nullif("constraint_profile", F.lit("")), F.lit("all_hard")).alias("constraint_profile"),
        F.col("expected").alias("expected_tool_calls"), F.col("predicted").alias("predicted_tool_calls"), F.col("acceptable").alias("acceptable_resource_ids_by_need"), F.col("chosen").alias("predicted_resource_ids"), "final_text",
        F.coalesce(F.get("modes", 0), F.lit("none")).alias("parse_mode"), F.col("modes").alias("parse_modes"), score.alias("score"),
        F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")).alias("messages"), F.coalesce(F.transform(outputs, lambda m: m["text"]), F.array().cast("array<string>")).alias("raw_agent_outputs"),
    )


def measures(records: DataFrame) -> DataFrame:
    """Records in the flat form that the roll-ups take."""
    kept = ("user_spec_id", "user_behavior", "case_type", "constraint_profile", "parse_mode")
    counts = {"agent_turns": transcript.agent_turn_count(F.col("raw_agent_outputs")), "user_messages": transcript.user_message_count(F.col("messages"))}
    return records.select(F.col("user_id").alias("record_id"), *kept, "score.*", *(c.alias(k) for k, c in counts.items()))
