"""Search calls found in model output: extraction from text and JSON, and the normal form that scores compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schedule import SCORED, scored_schedule
from .text import document_list, let, location_list, string_list, strip, text, where_some

TOOL = "search_resources"
THINK = r"(?s)<think>.*?</think>"
CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
LISTS = ("service_categories", "counties", "cities", "zipcodes", "intake_methods", "available_documents", "eligibility")
ARGS = "struct<" + ",".join(f"{c}:array<string>" for c in LISTS) + ",schedule:struct<day:string,start_time:string,end_time:string,time:string,requires_24_hours:boolean>>"
NORMAL = "struct<" + ",".join(f"{c}:array<string>" for c in LISTS) + f",schedule:{SCORED}>"


def strip_reasoning(c: Column) -> Column:
    """Without closed reasoning blocks; an unclosed one stays."""
    t = text(c)
    return strip(F.when(t.contains("<think>"), F.regexp_replace(t, THINK, "")).otherwise(t))


def clean_tool_call_text(c: Column) -> Column:
    t = text(c)  # a block may begin in front of a reasoning block and end behind it
    return F.when(t.contains("<think>") | t.contains("<tool_call>"), strip(F.regexp_replace(strip_reasoning(t), CALL, ""))).otherwise(strip(t))


def selected_ids(c: Column) -> Column:
    """Distinct resource ids in the order they are named; their case is kept."""
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(?i)\bin211-[a-z0-9-]+\b"), F.lit(0)))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def variant_list(v: Column, path: str, *, bare: bool = True) -> Column:
    """The strings of a JSON list; a bare string is a list of one, unless ``bare`` is off. Anything else is empty."""
    none = F.array().cast("array<string>")
    strings = lambda items: F.transform(F.filter(items, lambda x: _kind(x) == "STRING"), lambda x: _get(x, "$", "string"))
    one = lambda x: F.when(_kind(x) == "STRING", F.array(_get(x, "$", "string")))
    listed = lambda x: F.coalesce(strings(_get(x, "$", "array<variant>")), one(x) if bare else none, none)
    return let(_get(v, path), lambda x: F.when(x.isNull(), none).otherwise(listed(x)))


def _written(v: Column, path: str) -> Column:
    """A scalar as text; false, zero and null are blank."""
    kind, s = _kind(_get(v, path)), _get(v, path, "string")
    return F.when(kind == "STRING", s).when(kind == "BOOLEAN", F.when(_get(v, path, "boolean"), "True").otherwise("")).when(kind == "BIGINT", F.when(_get(v, path, "bigint") != 0, s).otherwise("")).otherwise("")


def truthy(v: Column, path: str) -> Column:
    kind = _kind(_get(v, path))
    return F.coalesce(
        F.when(kind == "BOOLEAN", _get(v, path, "boolean")).when(kind == "STRING", _get(v, path, "string") != "").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), _get(v, path, "double") != 0)
        .when(kind.startswith("ARRAY"), F.size(_get(v, path, "array<variant>")) > 0).when(kind.startswith("OBJECT"), kind != "OBJECT<>"), F.lit(False),
    )


def args_from_variant(v: Column, *, search: bool = False) -> Column:
    """Typed arguments of a JSON object. A search takes lists only and all-day only from a literal true."""
    s = "$.schedule"
    whole = (_kind(_get(v, f"{s}.requires_24_hours")) == "BOOLEAN") & truthy(v, f"{s}.requires_24_hours") if search else truthy(v, f"{s}.requires_24_hours")
    clock = F.struct(*(_written(v, f"{s}.{c}").alias(c) for c in ("day", "start_time", "end_time", "time")), whole.alias("requires_24_hours"))
    schedule = F.when(_kind(_get(v, s)).startswith("OBJECT"), clock)
    return F.struct(*(variant_list(v, f"$.{c}", bare=not search).alias(c) for c in LISTS), schedule.alias("schedule")).cast(ARGS)


def normalize_args(a: Column) -> Column:
    """Typed arguments in the form that scores compare."""
    return let(a, _normal)


def _normal(a: Column) -> Column:
    how = {"counties": location_list, "cities": location_list, "available_documents": document_list}
    return F.struct(*(where_some(a[c], how.get(c, string_list)).alias(c) for c in LISTS), F.when(a["schedule"].isNotNull(), scored_schedule(a["schedule"])).alias("schedule")).cast(NORMAL)


def normalize_calls(calls: Column) -> Column:
    return F.transform(F.filter(F.coalesce(calls, F.array().cast(f"array<{ARGS}>")), lambda x: x.isNotNull()), normalize_args)


def _object(v: Column, path: str) -> Column:
    return F.when(_kind(_get(v, path)).startswith("OBJECT"), _get(v, path))


def _call_arguments(v: Column) -> Column:
    """The argument object of ``{name, arguments}`` or ``{function: {name, arguments}}``; NULL if it is no search call."""
    plain = F.when(_get(v, "$.name", "string") == TOOL, _object(v, "$.arguments"))
    nested = F.when(_get(v, "$.function.name", "string") == TOOL, _object(v, "$.function.arguments"))
    return F.coalesce(plain, nested)


CALLS = f"array<struct<name:string,arguments:{NORMAL},parse_mode:string>>"


def _as_calls(arguments: Column, mode: str) -> Column:
    listed = F.filter(arguments, lambda x: x.isNotNull())
    read = F.transform(listed, lambda v: args_from_variant(v))
    return F.transform(read, lambda a: F.struct(F.lit(TOOL).alias("name"), _normal(a).alias("arguments"), F.lit(mode).alias("parse_mode"))).cast(CALLS)


def tagged_calls(c: Column) -> Column:
    """Calls in ``<tool_call>`` blocks; without any, the whole text as one function call in JSON."""
    return F.when(c.contains("{"), let(strip_reasoning(c), _tagged)).otherwise(F.array().cast(CALLS))  # no call does without a brace


def _blocks(t: Column) -> Column:
    """The argument objects of the blocks; NULL for a block that is no search call."""
    return F.transform(F.regexp_extract_all(t, F.lit(CALL), F.lit(1)), lambda p: _call_arguments(F.try_parse_json(p)))


def _whole(t: Column) -> Column:
    """The argument object of a text that is one function call."""
    return let(F.try_parse_json(t), lambda w: F.when((_get(w, "$.type", "string") == "function") & (_get(w, "$.function.name", "string") == TOOL), _object(w, "$.function.arguments")))


def _tagged(t: Column) -> Column:
    return let(_as_calls(_blocks(t), "qwen_xml"), lambda found: F.when(F.size(found) > 0, found).otherwise(_as_calls(F.array(_whole(t)), "qwen_openai_function_json")))


def tagged_arguments(c: Column) -> Column:
    """What the search itself takes of the same calls, in the same order: nothing is normalised."""
    read = lambda found: F.transform(F.filter(found, lambda x: x.isNotNull()), lambda v: args_from_variant(v, search=True))
    either = lambda t: let(read(_blocks(t)), lambda a: F.when(F.size(a) > 0, a).otherwise(read(F.array(_whole(t)))))
    return F.when(c.contains("{"), let(strip_reasoning(c), either)).otherwise(F.array().cast(f"array<{ARGS}>"))


def response_calls(output: Column) -> Column:
    """Calls among response items; their arguments are a JSON string, blank for none."""
    v = F.try_parse_json(output)
    items = F.coalesce(_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    asked = F.filter(items, lambda x: _get(x, "$.type", "string").isin("function_call", "tool_call") & (_get(x, "$.name", "string") == TOOL))
    parsed = F.transform(asked, lambda x: F.try_parse_json(F.coalesce(F.nullif(_get(x, "$.arguments", "string"), F.lit("")), F.lit("{}"))))
    return _as_calls(F.transform(parsed, lambda p: F.when(_kind(p).startswith("OBJECT"), p)), "responses_function_call")


def expected_call(need: Column) -> Column:
    """The normalised arguments that a need asks for; its locations sit in a struct of their own."""
    lists = ("service_categories", "intake_methods", "available_documents", "eligibility")
    return normalize_args(F.struct(*((need[c] if c in lists else need["location"][c]).alias(c) for c in LISTS), need["schedule"].alias("schedule")).cast(ARGS))


def needs_of(needs: Column, flat: Column) -> Column:
    """The listed needs; without any, the one need that a flat specification states in fields of its own.

    ``flat`` names its category ``service_category``; a blank one is no category.
    """
    category = flat["service_category"]
    listed = F.when(F.coalesce(category, F.lit("")) != "", F.array(category)).otherwise(F.array().cast("array<string>"))
    rest = ("schedule", "location", "intake_methods", "available_documents", "eligibility")
    one = F.struct(F.lit("need-1").alias("need_id"), listed.alias("service_categories"), *(flat[k].alias(k) for k in rest))
    return F.when(F.coalesce(F.size(needs), F.lit(0)) > 0, needs).otherwise(F.array(one))


def expected_calls(needs: Column, flat: Column) -> Column:
    """The normalised arguments of every expected call of a specification, with a list of needs or without."""
    return F.transform(needs_of(needs, flat), expected_call)


def expected_ids(ground_truth: Column, source_id: Column) -> Column:
    """Ids of the ground truth; without any entry, the source id alone."""
    listed = F.filter(F.transform(F.coalesce(ground_truth, F.array().cast("array<struct<resource_id:string>>")), lambda x: x["resource_id"]), lambda x: x.isNotNull() & (x != ""))
    single = F.when(F.coalesce(source_id, F.lit("")) != "", F.array(source_id)).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(F.size(ground_truth), F.lit(0)) > 0, listed).otherwise(single)
