"""Queries on search calls, scores, conversations, roll-ups, case generation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls, dialogue, scoring, text, transcript
from ..operators import rollup, search, specgen
from ..sources import directory as src
from ..sources.storage import scratch
from . import views as v
from .registry import query


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bar(c):
    return F.array_join(c, "|")


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    show = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else v.lit(x)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


#: Tool arguments; what a search takes of them (all day, day, minute, start, end, categories); what a score takes
#: (day, time, start, end, all day, categories, counties, documents). Worked out by hand.
ARGS = [
    ('{"service_categories":["Food Assistance"," ",3,"Food Assistance"],"schedule":{"day":"mon","time":"17:00"}}', (False, "mon", 1020, None, None, "Food Assistance|Food Assistance"), ("mon", "17:00", None, None, None, "Food Assistance", "", "")),
    ('{"service_categories":"Food","schedule":{"day":"Monday","start_time":"09:00","end_time":"17:00"},"counties":["O\'Fallon"," marion ","MARION"]}', (False, "mon", None, 540, 1020, ""), ("mon", None, "09:00", "17:00", None, "Food", "O FALLON|MARION", "")),
    ('{"service_categories":["x"],"schedule":{"day":"sat","start_time":"13:00","end_time":"24:00"}}', (False, "sat", None, None, None, "x"), ("sat", None, "13:00", "24:00", None, "x", "", "")),
    ('{"schedule":{"day":"xyz"},"available_documents":["Photo_ID","none","photo_id"]}', (None, None, None, None, None, ""), ("xyz", None, None, None, None, "", "", "photo_id")),
    ('{"schedule":{"requires_24_hours":"yes"}}', (None, None, None, None, None, ""), (None, None, None, None, True, "", "", "")),
    ('{"schedule":{"requires_24_hours":true,"day":"tue"}}', (True, None, None, None, None, ""), (None, None, None, None, True, "", "", "")),
    ('{"schedule":{"day":"Tues","time":"06:30"}}', (False, "tue", 390, None, None, ""), ("tues", "18:30", None, None, None, "", "", "")),
    ('{"schedule":{"day":"mon","time":"1-3"}}', (False, "mon", None, None, None, ""), ("mon", None, "13:00", "15:00", None, "", "", "")),
    ('{"schedule":{"day":"mon","start_time":"09:00","end_time":"09:00"}}', (False, "mon", 540, None, None, ""), ("mon", "09:00", None, None, None, "", "", "")),
    ('{"schedule":{"day":"mon","time":"2:00pm"}}', (False, "mon", None, None, None, ""), ("mon", None, None, None, None, "", "", "")),
    ('{"schedule":{"time":"10"}}', (None, None, None, None, None, ""), (None, None, None, None, None, "", "", "")),
    ('{"schedule":{"day":"mon","start_time":"9:5","end_time":" 17 : 00 "}}', (False, "mon", None, 545, 1020, ""), ("mon", None, "9:5", "17 : 00", None, "", "", "")),
    ('{"schedule":["mon"],"service_categories":{"a":1}}', (None, None, None, None, None, ""), (None, None, None, None, None, "", "", "")),
    ('{"schedule":{"day":"wed","start_time":"15:00","end_time":"10:00","time":"12:15"}}', (False, "wed", 735, None, None, ""), ("wed", None, "15:00", "10:00", None, "", "", "")),
    ("oops", (None, None, None, None, None, ""), (None, None, None, None, None, "", "", "")),
]


def _args(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.try_parse_json(src.pick(tuple(a for a, _, _ in ARGS), F.col("o_orderkey"))).alias("j"))


@query("WITH " + _values("x", "k, requires_24_hours, day, time_minute, start_minute, end_minute, categories", [(k, *s) for k, (_, s, _) in enumerate(ARGS)]) + f" SELECT o_orderkey, x.* EXCLUDE (k) FROM orders JOIN x ON k = o_orderkey % {len(ARGS)}")
def request_normalize(spark, sf_dir):
    a = _args(spark, sf_dir).select("o_orderkey", calls.args_from_variant(F.col("j"), search=True).alias("a")).select("o_orderkey", "a.*")
    return search.request_from_args(a).select("o_orderkey", *(F.col("schedule")[c].alias(c) for c in ("requires_24_hours", "day", "time_minute", "start_minute", "end_minute")), _bar(F.col("service_categories")).alias("categories"))


@query("WITH " + _values("x", 'k, day, "time", start_time, end_time, requires_24_hours, categories, counties, documents', [(k, *s) for k, (_, _, s) in enumerate(ARGS)]) + f" SELECT o_orderkey, x.* EXCLUDE (k) FROM orders JOIN x ON k = o_orderkey % {len(ARGS)}")
def toolargs_normalize(spark, sf_dir):
    a = _args(spark, sf_dir).select("o_orderkey", calls.normalize_args(calls.args_from_variant(F.col("j"))).alias("a"))
    return a.select("o_orderkey", *(F.col("a.schedule")[c].alias(c) for c in ("day", "time", "start_time", "end_time", "requires_24_hours")), _bar(F.col("a.service_categories")).alias("categories"), _bar(F.col("a.counties")).alias("counties"), _bar(F.col("a.available_documents")).alias("documents"))


#: Suffixes of model output, and the calls in each: (mode, categories, cities, zipcodes).
OUTPUTS = [
    ('<think>plan <tool_call>{"name":"search_resources","arguments":{}}</tool_call></think> hello', []),
    ('<tool_call>{"name":"search_resources","arguments":{"service_categories":["Food"],"cities":["St.Paul"]}}</tool_call> and <tool_call> {"type":"tool_call","name":"search_resources","arguments":{"service_categories":"Housing"}} </tool_call>', [("qwen_xml", "Food", "ST PAUL", ""), ("qwen_xml", "Housing", "", "")]),
    ('<tool_call>{"name":"other","arguments":{}}</tool_call>', []),
    ('<tool_call>{"function":{"name":"search_resources","arguments":{"zipcodes":["46001","46001 "]}}}</tool_call>', [("qwen_xml", "", "", "46001")]),
    ('<tool_call>{"name":"search_resources","arguments":"{}"}</tool_call>', []),
    ('<think>open {"name":1}', []),
    ('{"type":"function","function":{"name":"search_resources","arguments":{"service_categories":["Tax Help"]}}}', [("qwen_openai_function_json", "Tax Help", "", "")]),
]
_WHOLE = 6


def _outputs(spark, sf_dir):
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(OUTPUTS)))
    tail = src.pick(tuple(o for o, _ in OUTPUTS), k)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(k == _WHOLE, tail).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), tail)).alias("text"))


_OUT = f"o AS (SELECT conv_id, turn, (conv_id + turn) % {len(OUTPUTS)} AS k, CASE WHEN (conv_id + turn) % {len(OUTPUTS)} = {_WHOLE} THEN '' ELSE coalesce(text, '') || ' ' END || {v.pick(tuple(o for o, _ in OUTPUTS), 'conv_id + turn')} AS text FROM conversations)"


@query("WITH " + _OUT + ", " + _values("x", "k, pos, mode, categories, cities, zipcodes", [(k, i, *c) for k, (_, cs) in enumerate(OUTPUTS) for i, c in enumerate(cs)]) + " SELECT conv_id, turn, pos, mode, categories, cities, zipcodes FROM o JOIN x USING (k)")
def tool_call_extract(spark, sf_dir):
    c = _outputs(spark, sf_dir).select("conv_id", "turn", F.posexplode(calls.tagged_calls(F.col("text"))).alias("pos", "c"))
    return c.select("conv_id", "turn", "pos", F.col("c.parse_mode").alias("mode"), *(_bar(F.col(f"c.arguments.{x}")).alias(y) for x, y in (("service_categories", "categories"), ("cities", "cities"), ("zipcodes", "zipcodes"))))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'responses_function_call' END AS mode, CASE WHEN event_id % 4 = 0 THEN 'c' || event_id WHEN event_id % 4 = 1 THEN '' END AS categories FROM events""")
def response_call_extract(spark, sf_dir):
    i = F.col("event_id").cast("string")
    item = lambda kind, name, args: F.concat(F.lit(f'[{{"type":"message"}},{{"type":"{kind}","name":"{name}","arguments":'), args, F.lit("}]"))
    out = F.when(F.col("event_id") % 4 == 0, item("function_call", "search_resources", F.concat(F.lit('"{\\"service_categories\\":[\\"c'), i, F.lit('\\"]}"')))).when(
        F.col("event_id") % 4 == 1, item("tool_call", "search_resources", F.lit('""'))
    ).when(F.col("event_id") % 4 == 2, item("function_call", "search_resources", F.lit('"[1]"'))).otherwise(item("function_call", "other", F.lit('"{}"')))
    c = _t(spark, sf_dir, "events").select("event_id", F.get(calls.response_calls(out), 0).alias("c"))
    return c.select("event_id", F.col("c.parse_mode").alias("mode"), _bar(F.col("c.arguments.service_categories")).alias("categories"))


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"WITH {_OUT}, s AS (SELECT conv_id, turn, {_TRIM.format("regexp_replace(text, '(?s)<think>.*?</think>', '', 'g')")} AS answer FROM o) SELECT conv_id, turn, answer, {_TRIM.format("regexp_replace(answer, '(?s)<tool_call>[ \t\n\r]*([{{].*?[}}])[ \t\n\r]*</tool_call>', '', 'g')".replace('{{', '{').replace('}}', '}'))} AS said FROM s")
def strip_reasoning(spark, sf_dir):
    return _outputs(spark, sf_dir).select("conv_id", "turn", calls.strip_reasoning(F.col("text")).alias("answer"), calls.clean_tool_call_text(F.col("text")).alias("said"))


@query(f"""WITH a AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, '') || ' Use in211-' || conv_id || '-2-food- or IN211-3-' || turn || '-x, in211-' || conv_id || '-2-food; xin211-9', '(?i)\\bin211-[a-z0-9-]+\\b') AS l FROM conversations)
SELECT conv_id, turn, array_to_string({v.ordered('l')}, '|') AS ids FROM a""")
def selected_ids_extract(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" Use in211-"), "conv_id", F.lit("-2-food- or IN211-3-"), "turn", F.lit("-x, in211-"), "conv_id", F.lit("-2-food; xin211-9"))
    return c.select("conv_id", "turn", _bar(calls.selected_ids(said)).alias("ids"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'in211-' || p_partkey || '-food|z' WHEN 1 THEN 'in211-' || p_partkey || '|z' ELSE 'in211-' || p_partkey || '|in211-' || p_partkey || '-food|z' END AS ids FROM part""")
def resolve_id_prefix(spark, sf_dir):
    k = F.col("p_partkey")
    a = F.concat(F.lit("in211-"), k)
    more = F.concat(a, F.lit("-food"))
    candidates = F.when(k % 3 == 0, F.array(more, F.lit("q"))).when(k % 3 == 1, F.array(more, F.concat(a, F.lit("-rent")))).otherwise(F.array(a, more, F.concat(a, F.lit("-food"))))
    predicted = F.when(k % 3 == 2, F.array(a, more, F.lit("z"))).otherwise(F.array(a, a, F.lit("z")))
    return _t(spark, sf_dir, "part").select("p_partkey", _bar(scoring.resolve_prefixes(predicted, candidates)).alias("ids"))


def _call(k, cat="a", county="B", day="mon", intake="call", doc="lease", elig="senior"):
    """Arguments whose fields are literals or columns."""
    c = lambda x: F.array(x if not isinstance(x, str) else F.lit(x))
    none = F.array().cast("array<string>")
    clock = F.struct((F.lit(day) if isinstance(day, str) else day).alias("day"), *(F.lit(None).cast("string").alias(x) for x in ("start_time", "end_time", "time")), F.lit(None).cast("boolean").alias("requires_24_hours"))
    return F.struct(c(cat).alias("service_categories"), c(county).alias("counties"), none.alias("cities"), none.alias("zipcodes"), c(intake).alias("intake_methods"), c(doc).alias("available_documents"), c(elig).alias("eligibility"), clock.alias("schedule")).cast(calls.ARGS)


@query("""SELECT o_orderkey, o_orderkey % 2 <> 0 AS service_match, o_orderkey % 3 <> 0 AS location_match, o_orderkey % 5 <> 0 AS schedule_match, o_orderkey % 7 <> 0 AS intake_match, o_orderkey % 11 <> 0 AS documents_match,
  o_orderkey % 13 <> 0 AS eligibility_match, o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS all_match,
  CAST((o_orderkey % 2 <> 0)::INT + (o_orderkey % 3 <> 0)::INT + (o_orderkey % 5 <> 0)::INT + (o_orderkey % 7 <> 0)::INT + (o_orderkey % 11 <> 0)::INT + (o_orderkey % 13 <> 0)::INT AS INT) AS fields FROM orders""")
def field_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    off = lambda n, wrong, right: F.when(k % n == 0, wrong).otherwise(right)
    expected = calls.normalize_args(_call(k, "Food", "St. Mary", "monday", "call", "Lease", "senior"))
    predicted = calls.normalize_args(_call(k, off(2, "food", "Food"), off(3, "ST MARY Z", "st mary"), off(5, "Tue", "Mon"), off(7, "Call", " call "), off(11, "photo_id", "LEASE"), off(13, "Senior", "senior")))
    s = _t(spark, sf_dir, "orders").select("o_orderkey", scoring.arg_scores(predicted, expected).alias("s"))
    return s.select("o_orderkey", *(F.col(f"s.{c}").alias(c) for c in (*scoring.FIELDS, "all_match")), scoring.field_match_count(F.col("s")).alias("fields"))


#: Expected and predicted (counties, cities, zipcodes), and whether they match.
PLACES = [
    (("", "", ""), ("", "", ""), True), (("", "", ""), ("", "X", ""), False), (("A", "", ""), ("A", "", ""), True), (("A", "", ""), ("A", "X", ""), False),
    (("A", "X", "1"), ("", "", "1"), True), (("A", "X", "1"), ("", "X", "2"), False), (("A", "X", "1"), ("", "", ""), False), (("A|B", "X", ""), ("A", "X", ""), True), (("A|B", "X", ""), ("A", "", ""), False),
]


@query("WITH " + _values("x", "k, location_match", [(k, r[2]) for k, r in enumerate(PLACES)]) + f" SELECT o_orderkey, location_match FROM orders JOIN x ON k = o_orderkey % {len(PLACES)}")
def location_score(spark, sf_dir):
    k = F.col("o_orderkey")
    side = lambda i: F.struct(*(text.split_pipe(src.pick(tuple(r[i][j] for r in PLACES), k)).alias(c) for j, c in enumerate(scoring.PLACES)))
    return _t(spark, sf_dir, "orders").select("o_orderkey", side(0).alias("e"), side(1).alias("p")).select("o_orderkey", scoring.location_matches(F.col("p"), F.col("e")).alias("location_match"))


@query("WITH " + _values("x", "k, valid_tool_call, tool_call_count_match, service_match, location_match, all_match, predicted_call_count", [(0, True, True, True, True, True, 2), (1, True, False, False, False, False, 1), (2, True, False, True, True, False, 3), (3, False, False, False, False, False, 0), (4, True, True, False, True, False, 2)]) + " SELECT o_orderkey, x.* EXCLUDE (k) FROM orders JOIN x ON k = o_orderkey % 5")
def greedy_match_score(spark, sf_dir):
    k = F.col("o_orderkey")
    a, b, wrong = _call(k), _call(k, "z", "Y", "sat", "mail", "lease", "youth"), _call(k, "other")
    none = F.array().cast(f"array<{calls.ARGS}>")
    predicted = F.when(k % 5 == 0, F.array(b, a)).when(k % 5 == 1, F.array(a)).when(k % 5 == 2, F.array(a, b, a)).when(k % 5 == 3, none).otherwise(F.array(wrong, b))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", calls.normalize_calls(predicted).alias("p"), calls.normalize_calls(F.array(a, b)).alias("e"))
    s = o.select("o_orderkey", scoring.score_calls(F.col("p"), F.col("e")).alias("s"))
    return s.select("o_orderkey", *(F.col(f"s.{c}").alias(c) for c in ("valid_tool_call", "tool_call_count_match", "service_match", "location_match", "all_match", "predicted_call_count")))


#: Predicted ids, acceptable ids by need (needs apart by ``/``), and precision, recall, exactness, correct needs.
CHOICES = [("a", "a|b", 1.0, 1.0, True, 1), ("a|b", "a|b", 1.0, 1.0, True, 1), ("a|z", "a|b", 0.5, 1.0, False, 1), ("a", "a/a|c", 1.0, 1.0, True, 2), ("a", "a/c", 1.0, 0.5, False, 1), ("a", "/a", 1.0, 1.0, True, 1), ("", "", 0.0, 0.0, False, 0), ("a|a", "b", 0.0, 0.0, False, 0)]


@query("WITH " + _values("x", "k, resource_precision, resource_recall, resource_exact_match, correct_resource_count", [(k, *r[2:]) for k, r in enumerate(CHOICES)]) + f" SELECT o_orderkey, CAST(resource_precision AS DOUBLE) AS resource_precision, CAST(resource_recall AS DOUBLE) AS resource_recall, resource_exact_match, correct_resource_count FROM orders JOIN x ON k = o_orderkey % {len(CHOICES)}")
def selection_score_by_need(spark, sf_dir):
    k = F.col("o_orderkey")
    needs = F.transform(F.split(src.pick(tuple(r[1] for r in CHOICES), k), "/"), text.split_pipe)
    s = _t(spark, sf_dir, "orders").select("o_orderkey", scoring.selection_by_need(text.split_pipe(src.pick(tuple(r[0] for r in CHOICES), k)), needs).alias("s"))
    return s.select("o_orderkey", *(F.col(f"s.{c}").alias(c) for c in ("resource_precision", "resource_recall", "resource_exact_match", "correct_resource_count")))


@query("""WITH p AS (SELECT l_orderkey, list(DISTINCT l_partkey) FILTER (l_linenumber % 2 = 1) AS p, list(DISTINCT l_partkey) FILTER (l_linenumber <= 2) AS e FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, coalesce(p, []) AS p, coalesce(e, []) AS e FROM p)
SELECT l_orderkey, CAST(len(list_intersect(p, e)) AS INT) AS correct, CASE WHEN len(p) > 0 THEN len(list_intersect(p, e)) / len(p) ELSE 0 END AS resource_precision,
  CASE WHEN len(e) > 0 THEN len(list_intersect(p, e)) / len(e) ELSE 0 END AS resource_recall, CASE WHEN len(e) > 0 THEN list_sort(p) = list_sort(e) ELSE len(p) = 0 END AS resource_exact_match FROM s""")
def selection_score(spark, sf_dir):
    line, id_ = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    o = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(line % 2 == 1, id_)).alias("p"), F.collect_list(F.when(line <= 2, id_)).alias("e"))
    s = o.select("l_orderkey", scoring.selection(F.col("p"), F.col("e")).alias("s"))
    return s.select("l_orderkey", F.col("s.correct_resource_count").alias("correct"), *(F.col(f"s.{c}").alias(c) for c in ("resource_precision", "resource_recall", "resource_exact_match")))


def _expected(r):
    need = F.struct("service_categories", "schedule", F.struct("counties", "cities", "zipcodes").alias("location"), "intake_methods", "available_documents", "eligibility")
    e = r.select("request_id", calls.expected_call(need).alias("e"))
    s = F.col("e.schedule")
    return e.select("request_id", _bar(F.col("e.service_categories")).alias("categories"), _bar(F.col("e.counties")).alias("counties"), _bar(F.col("e.cities")).alias("cities"), *(s[c].alias(c) for c in ("day", "time", "start_time", "requires_24_hours")), _bar(F.col("e.available_documents")).alias("documents"))


_EXPECTED = """WITH r AS (SELECT k AS request_id, m, CASE k % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' ELSE 'small' END AS categories, replace(n_name, '_', ' ') AS counties, 'CITY ' || (c % 40) AS cities FROM {0})
SELECT request_id, categories, counties, cities, CASE WHEN m % 8 = 7 THEN NULL WHEN m % 4 = 1 THEN 'mon' WHEN m % 4 = 2 THEN 'sat' WHEN m % 4 = 3 THEN 'tues.' END AS day, CASE WHEN m % 4 = 1 THEN '10:00' END AS "time",
  CASE WHEN m % 4 = 2 THEN '13:00' END AS start_time, CASE WHEN m % 8 = 7 THEN TRUE END AS requires_24_hours, CASE WHEN m % 5 = 0 THEN 'photo_id|proof of address|lease' ELSE '' END AS documents FROM r"""


@query(_EXPECTED.format(v.CUSTOMERS))
def expected_calls(spark, sf_dir):
    return _expected(src.requests(spark, sf_dir))


@query(_EXPECTED.format(v.ORDERS))
def expected_calls_every_request(spark, sf_dir):
    return _expected(src.every_request(spark, sf_dir))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a' || o_orderkey || '|b' WHEN 1 THEN 's' || o_orderkey ELSE '' END AS ids FROM orders")
def expected_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    entry = lambda c: F.struct(c.alias("resource_id"))
    none = F.array().cast("array<struct<resource_id:string>>")
    truth = F.when(k % 3 == 0, F.array(entry(F.concat(F.lit("a"), k)), entry(F.lit("")), entry(F.lit("b")))).otherwise(none)
    return _t(spark, sf_dir, "orders").select("o_orderkey", _bar(calls.expected_ids(truth, F.when(k % 3 == 1, F.concat(F.lit("s"), k)))).alias("ids"))


@query("WITH b(user_behavior, behavior_place) AS (VALUES ('normal', 0), ('rambling', 1), ('impatience', 2), ('self_contradictory', 3), ('unsupported_request', 4)) SELECT o_orderkey, user_behavior, behavior_place FROM orders, b")
def expand_behaviors(spark, sf_dir):
    return specgen.expand_behaviors(_t(spark, sf_dir, "orders").select("o_orderkey"), (*src.BEHAVIORS, "normal")).select("o_orderkey", "user_behavior", "behavior_place")


@query(f"WITH {v.DIR} SELECT category, count(*) AS n, min(resource_id) AS first FROM (SELECT resource_id, unnest(string_split(service_categories, '|')) AS category FROM dir) GROUP BY 1")
def category_index(spark, sf_dir):
    listed = src.directory(spark, sf_dir).select("resource_id", text.split_pipe(F.col("service_categories")).alias("service_categories"))  # nothing else of a resource is read
    return specgen.by_category(listed).groupBy("category").agg(F.count("*").alias("n"), F.min("resource_id").alias("first"))


_RATES = ", ".join(f"avg({k}::INT::DOUBLE) AS {k}_rate" for k in rollup.KEYS)
_METRICS = f"count(*) AS n, {_RATES}, avg(resource_precision) AS resource_precision_avg, avg(resource_recall) AS resource_recall_avg, avg(predicted_call_count::DOUBLE) AS predicted_tool_call_count_avg"


@query(f"WITH {v.REC} SELECT {_METRICS} FROM rec")
def summary_overall(spark, sf_dir):
    return rollup.overall(src.records(spark, sf_dir))


_SUMMARY = f"""WITH {v.REC} SELECT user_behavior, case_type, constraint_profile, parse_mode, {_METRICS},
  CASE GROUPING(user_behavior, case_type, constraint_profile, parse_mode) WHEN 1 THEN 'cell' WHEN 7 THEN 'user_behavior' WHEN 11 THEN 'case_type' WHEN 13 THEN 'constraint_profile' WHEN 14 THEN 'parse_mode' ELSE 'overall' END AS level
FROM rec GROUP BY GROUPING SETS ((user_behavior, case_type, constraint_profile), (user_behavior), (case_type), (constraint_profile), (parse_mode), ())"""


@query(_SUMMARY)
def summary_grouping_sets(spark, sf_dir):
    return rollup.summary(src.records(spark, sf_dir))


@query(_SUMMARY)
def summary_live(spark, sf_dir):
    """The same summary kept by a stream over eight files of events, a batch for each."""
    from ..streaming import summaries
    from ..streaming.records import read_stream

    path = scratch(spark, "live")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(8).write.parquet(f"{path}/in")
    stream = src.records_of(read_stream(spark, f"{path}/in", events.schema, files=1))
    summaries.keep_summary(stream, f"{path}/sums", f"{path}/checkpoint", merge=3).awaitTermination()
    return summaries.summary(spark, f"{path}/sums")


@query(f"""WITH {v.REC}, s AS (SELECT * FROM rec), c AS (SELECT case_type, constraint_profile, user_behavior, {_METRICS} FROM s GROUP BY ALL)
SELECT a.case_type, b.constraint_profile, u.user_behavior, coalesce(n, 0) AS n, c.* EXCLUDE (case_type, constraint_profile, user_behavior, n)
FROM (SELECT DISTINCT case_type FROM s) a CROSS JOIN (SELECT DISTINCT constraint_profile FROM s) b CROSS JOIN (SELECT DISTINCT user_behavior FROM s) u LEFT JOIN c ON a.case_type = c.case_type AND b.constraint_profile = c.constraint_profile AND u.user_behavior = c.user_behavior""")
def summary_dense_cells(spark, sf_dir):
    return rollup.dense_cells(src.records(spark, sf_dir))


@query(f"WITH {v.REC} SELECT parse_mode, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM rec GROUP BY 1")
def parse_mode_counts(spark, sf_dir):
    return rollup.parse_modes(src.records(spark, sf_dir))


@query(f"WITH {v.REC} SELECT coalesce(avg((parse_mode = 'none')::INT::DOUBLE), 0) AS parse_none_rate FROM rec")
def parse_none_rate(spark, sf_dir):
    return rollup.parse_none_rate(src.records(spark, sf_dir))


@query(f"""WITH {v.REC} SELECT avg(agent_turns) AS agent_turns_avg, median(agent_turns) AS agent_turns_median, max(agent_turns) AS agent_turns_max, avg(user_messages) AS user_messages_avg, median(user_messages) AS user_messages_median,
  max(user_messages) AS user_messages_max FROM rec""")
def turn_stats(spark, sf_dir):
    return rollup.turn_stats(src.records(spark, sf_dir))


@query(f"""WITH {v.REC}, t AS (SELECT CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS i, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS o, count(*) AS n FROM rec)
SELECT i AS input_tokens, o AS output_tokens, i + o AS total_tokens, i / n AS avg_input_tokens, o / n AS avg_output_tokens, (i + o) / n AS avg_total_tokens FROM t""")
def token_usage(spark, sf_dir):
    return rollup.token_usage(src.records(spark, sf_dir))


@query("SELECT user_id, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 7) AS BIGINT) AS output_tokens, CAST(sum(event_id % 100 + event_id % 7) AS BIGINT) AS total_tokens FROM events GROUP BY 1")
def usage_by_conversation(spark, sf_dir):
    i = F.col("event_id")
    e = _t(spark, sf_dir, "events").select("user_id", F.when(i % 2 == 0, i % 100).alias("prompt_tokens"), F.when(i % 2 == 1, i % 100).alias("input_tokens"), (i % 7).alias("completion_tokens"), (i % 100 + i % 7).alias("total_tokens"))
    return rollup.usage_by_conversation(e, "user_id")


_MISSED = ", ".join(f"count_if(NOT {k}) AS {name}" for name, k in rollup.FAILURES.items())


@query(f"WITH {v.REC} SELECT {_MISSED}, count(*) AS n FROM rec")
def failure_counts(spark, sf_dir):
    return rollup.failure_counts(src.records(spark, sf_dir))


@query(f"WITH {v.REC} SELECT user_behavior, {_MISSED}, count(*) AS n FROM rec GROUP BY 1")
def failure_counts_by_behavior(spark, sf_dir):
    return rollup.failure_counts(src.records(spark, sf_dir), "user_behavior")


@query(f"WITH {v.REC} SELECT {', '.join(f'count_if(NOT {k}) AS {k}' for k in rollup.KEYS)} FROM rec")
def field_failures(spark, sf_dir):
    return rollup.field_failures(src.records(spark, sf_dir))


@query(f"""WITH {v.REC}, nrm AS (SELECT user_spec_id, arg_max(agent_turns, record_id) AS normal_turns FROM rec WHERE user_behavior = 'normal' GROUP BY 1)
SELECT user_behavior, count(*) AS n, avg(end_to_end_match::INT::DOUBLE) AS end_to_end, avg(all_match::INT::DOUBLE) AS tool_all, avg(resource_exact_match::INT::DOUBLE) AS resource, avg(valid_tool_call::INT::DOUBLE) AS valid,
  avg(agent_turns) AS agent_turns_avg, median(agent_turns) AS agent_turns_median, avg(user_messages) AS user_msgs_avg, median(user_messages) AS user_msgs_median,
  count_if(user_behavior <> 'normal' AND agent_turns < coalesce(normal_turns, 0)) AS shorter_than_normal FROM rec LEFT JOIN nrm USING (user_spec_id) GROUP BY 1""")
def behavior_report_self_join(spark, sf_dir):
    return rollup.behavior_report(src.records(spark, sf_dir))


@query(f"""WITH {v.REC}, f AS ({' UNION ALL '.join(f"SELECT user_behavior, record_id, {i} AS k, '{k.removesuffix('_match')}' AS failure FROM rec WHERE NOT {k}" for i, k in enumerate(rollup.FAILURES.values()))}),
g AS (SELECT user_behavior, failure, count(*) AS "count", min(record_id * 100 + k) AS first FROM f GROUP BY ALL)
SELECT user_behavior, row_number() OVER (PARTITION BY user_behavior ORDER BY "count" DESC, first) AS place, failure, "count" FROM g""")
def failure_most_common(spark, sf_dir):
    return rollup.most_common_failures(src.records(spark, sf_dir))


@query(f"WITH {v.REC}, r AS (SELECT *, row_number() OVER (PARTITION BY user_behavior ORDER BY all_match, agent_turns, record_id) AS place FROM rec) SELECT user_behavior, place, record_id, all_match, agent_turns FROM r WHERE place <= 5")
def examples_per_behavior(spark, sf_dir):
    return rollup.examples(src.records(spark, sf_dir), 5).select("user_behavior", "place", "record_id", "all_match", "agent_turns")


@query("""SELECT conv_id, string_agg(role || ': ' || substr(trim(replace(coalesce(text, ''), chr(10), ' ')), 1, 240), ' / ' ORDER BY turn) AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 6 GROUP BY 1""")
def shown_messages(spark, sf_dir):
    first = transcript.some_turns(_t(spark, sf_dir, "conversations"), 6)
    return _dialogues(spark, sf_dir, first).select("conv_id", F.array_join(rollup.shown_messages(F.col("messages")), " / ").alias("shown"))


@query(f"""WITH {v.REC}, m AS (SELECT 'a' AS method, * FROM rec UNION ALL SELECT 'b' AS method, * REPLACE (service_match AS resource_exact_match, resource_recall AS resource_precision) FROM rec), c AS (SELECT method, user_behavior, {_METRICS} FROM m GROUP BY ALL)
SELECT x.method, u.user_behavior, coalesce(n, 0) AS n, c.* EXCLUDE (method, user_behavior, n) FROM (SELECT DISTINCT method FROM m) x CROSS JOIN (SELECT DISTINCT user_behavior FROM m) u LEFT JOIN c ON c.method = x.method AND c.user_behavior = u.user_behavior""")
def run_comparison(spark, sf_dir):
    r = src.records(spark, sf_dir)
    return rollup.compare_runs(rollup.concat_runs({"a": r, "b": r.withColumns({"resource_exact_match": F.col("service_match"), "resource_precision": F.col("resource_recall")})}))


@query("SELECT p_type AS value, count(*) AS \"count\" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_values(spark, sf_dir):
    return rollup.top_counts(_t(spark, sf_dir, "part"), "p_type", 5)


@query(f"""WITH {v.RES} SELECT 'service_name' AS "column", count(DISTINCT service_name) AS n FROM res UNION ALL SELECT 'city', count(DISTINCT city) FROM res UNION ALL SELECT 'zipcode', count(DISTINCT zipcode) FROM res
UNION ALL SELECT 'counties', count(DISTINCT c) FROM (SELECT unnest(string_split(counties, '|')) AS c FROM res) UNION ALL SELECT 'intake_methods', count(DISTINCT c) FROM (SELECT unnest(tags_intake) AS c FROM res)""")
def unique_counts(spark, sf_dir):
    return rollup.unique_counts(src.resources(spark, sf_dir), ["service_name", "city", "zipcode"], ["counties", "intake_methods"])


@query(f"WITH {v.DIR}, {v.WINDOWS}, w AS (SELECT k, count(*) AS c FROM win GROUP BY 1), x AS (SELECT coalesce(c, 0) AS c FROM dir LEFT JOIN w ON k = p_size % 10) SELECT count_if(c > 0) AS with_windows, CAST(sum(c) AS BIGINT) AS windows, avg(c) AS mean_windows FROM x")
def window_stats(spark, sf_dir):
    return rollup.window_stats(src.resources(spark, sf_dir))


@query(f"WITH {v.DIR} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if({c} = '') AS blanks FROM dir" for c in ("site_schedule", "site_details", "documents_required", "site_eligibility", "site_number", "service_website", "subcategories")))
def blank_profile(spark, sf_dir):
    return rollup.blank_profile(src.directory(spark, sf_dir), ["site_schedule", "site_details", "documents_required", "site_eligibility", "site_number", "service_website", "subcategories"])


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2")
def sites_with_many(spark, sf_dir):
    return rollup.sites_with_many(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


SUFFIXES = (" When and where?", " Please CALL about your paperwork.", " I am looking for", " Monday in the county", " message", "")


def _said(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), src.pick(SUFFIXES, F.col("conv_id") + F.col("turn"))))


def _dialogues(spark, sf_dir, said=None):
    c = _t(spark, sf_dir, "conversations") if said is None else said
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return m.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


_SAID = f"said AS (SELECT conv_id, turn, role, coalesce(text, '') || {v.pick(SUFFIXES, 'conv_id + turn')} AS text FROM conversations)"
_AREAS = v.labels([(k, v.has("lower(text)", w)) for k, w in dialogue.ASKED.items()])


@query(f"WITH {_SAID} SELECT conv_id, turn, CASE WHEN len({_AREAS}) = 0 AND {v.has('lower(text)', dialogue.ASKED_SERVICE)} THEN 'service' ELSE array_to_string({_AREAS}, '|') END AS areas FROM said")
def requested_areas(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", _bar(dialogue.requested_areas(F.col("text"))).alias("areas"))


@query(f"WITH {_SAID}, u AS (SELECT conv_id, lower(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '')) AS t FROM said GROUP BY 1) SELECT conv_id, CASE " + " ".join(f"WHEN NOT {v.has('t', w)} THEN '{k}'" for k, w in dialogue.ANSWERED.items()) + " ELSE 'service' END AS area FROM u")
def next_unanswered(spark, sf_dir):
    d = _dialogues(spark, sf_dir, _said(spark, sf_dir))
    user = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"]), "\n")
    return d.select("conv_id", dialogue.next_unanswered(user).alias("area"))


@query("""WITH r AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(10)) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, coalesce(string_agg(CASE role WHEN 'user' THEN 'assistant' ELSE 'user' END || ':' || t, '#' ORDER BY turn) FILTER (k <= 10 AND t <> '' AND role IN ('user', 'assistant')), '') AS mapped FROM r GROUP BY 1""")
def role_map_last10(spark, sf_dir):
    mapped = F.transform(dialogue.role_mapped(F.col("messages")), lambda m: F.concat_ws(":", m["role"], m["content"]))
    last = transcript.some_turns(_t(spark, sf_dir, "conversations"), 10, last=True)
    return _dialogues(spark, sf_dir, last).select("conv_id", F.array_join(mapped, "#").alias("mapped"))


def _slots() -> str:
    """The states of every conversation in SQL: one row a reply, and one for the opening."""
    listed = lambda g: "[" + ", ".join(map(v.lit, g)) + "]"
    open_ = lambda g: f"list_filter({listed(g)}, lambda x: NOT list_contains(provided, x))"
    hits = ", ".join(f"len({open_(g)}) > 0 AND list_has_any(asked, {listed(g)}) AS h{i}" for i, g in enumerate(dialogue.SLOTS))
    many = " || ".join(f"CASE WHEN h{i} THEN {open_(g)} ELSE [] END" for i, g in enumerate(dialogue.SLOTS))
    one = " ".join(f"WHEN h{i} THEN {listed(g)}" for i, g in enumerate(dialogue.SLOTS))
    count = " + ".join(f"h{i}::INT" for i in range(len(dialogue.SLOTS)))
    return f"""{_SAID}, heard AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {_AREAS} AS l FROM said WHERE role = 'assistant'),
a AS (SELECT conv_id, n, CASE WHEN len(l) = 0 THEN ['service'] ELSE l END AS asked FROM heard),
st(conv_id, n, behavior, provided, used, plan, kind) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {v.pick(("normal", "self_contradictory", "impatience"), "conv_id")}, ['service'], FALSE, ['service'], 'opening' FROM said
  UNION ALL
  SELECT conv_id, n, behavior, provided || list_filter(plan, lambda x: NOT list_contains(provided, x)), used OR now, plan,
    CASE WHEN behavior = 'impatience' THEN 'impatience' WHEN now THEN 'contradiction' WHEN behavior = 'self_contradictory' THEN 'resolved' ELSE 'reply' END
  FROM (SELECT *, behavior = 'self_contradictory' AND NOT used AND list_contains(plan, 'location') AS now
    FROM (SELECT *, CASE WHEN {count} > 1 THEN {many} {one} ELSE asked END AS plan
      FROM (SELECT st.conv_id, a.n, st.behavior, st.provided, st.used, a.asked, {hits} FROM st JOIN a ON a.conv_id = st.conv_id AND a.n = st.n + 1))))"""


@query(f"""WITH RECURSIVE {_slots()}
SELECT conv_id, CAST(n + 1 AS INT) AS turn, array_to_string(provided, '|') AS provided, used AS contradiction_used, array_to_string(plan, '|') AS plan, kind FROM st QUALIFY n = max(n) OVER (PARTITION BY conv_id)""")
def slot_state_fold(spark, sf_dir):
    """The simulated user's state after each conversation."""
    d = _dialogues(spark, sf_dir, _said(spark, sf_dir))
    agent = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: dialogue.requested_areas(m["content"]))
    asked = F.transform(agent, lambda a: F.when(F.size(a) == 0, F.array(F.lit("service"))).otherwise(a))
    behavior = src.pick(("normal", "self_contradictory", "impatience"), F.col("conv_id"))
    s = d.select("conv_id", dialogue.fold_turns(asked, behavior, F.lit("location")).alias("s"))
    return s.select("conv_id", "s.turn", _bar(F.col("s.provided")).alias("provided"), "s.contradiction_used", _bar(F.col("s.plan")).alias("plan"), "s.kind")


_NAMES = tuple(sorted(dialogue.PHRASES)) + ("Odd and Ends",)


@query("WITH x(c, p) AS (VALUES " + ", ".join(f"({v.lit(c)}, {v.lit(dialogue.PHRASES.get(c, 'odd or ends'))})" for c in _NAMES) + f"), y AS (SELECT p_partkey, {v.pick(_NAMES, 'p_partkey')} AS a, {v.pick(_NAMES, 'p_partkey + 7')} AS b FROM part) SELECT p_partkey, i.p || ' and ' || j.p AS phrase FROM y JOIN x i ON i.c = a JOIN x j ON j.c = b")
def plain_language_need(spark, sf_dir):
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select("p_partkey", dialogue.plain_need(F.array(src.pick(_NAMES, k), src.pick(_NAMES, k + 7))).alias("phrase"))


def _facts() -> str:
    """The JSON text of ``hidden_facts_json`` in SQL."""
    words = lambda when, xs: "CASE WHEN " + when + " THEN '[" + ",".join(f'"{x}"' for x in xs) + "]' ELSE '[]' END"
    by_need = lambda key, value: f"""'[' || array_to_string(list_transform(ids, lambda i: '{{"need_id":"' || i || '","service_categories":["' || cat || '"],"{key}":' || {value} || '}}'), ',') || ']'"""
    services = """'[' || array_to_string(list_transform(ids, lambda i: '{"need_id":"' || i || '","plain_language_need":"' || lower(cat) || '","service_categories":["' || cat || '"]}'), ',') || ']'"""
    served = f"""'"service_needs":' || {services} || ',"case_type":"' || CASE WHEN m % 2 = 1 THEN 'composite' ELSE 'single' END || '"'"""
    note = f"""',"note":"{dialogue.NOTE}"'"""
    return f"""WITH r AS (SELECT k, m, CASE k % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' ELSE 'small' END AS cat, CASE WHEN m % 2 = 0 THEN ['need-1'] ELSE ['need-1', 'need-2'] END AS ids,
  '{{"counties":["' || n_name || '"],"cities":["city ' || (c % 40) || '"],"zipcodes":["' || (46000 + c % 97) || '"]}}' AS place, {words("m % 3 = 1", ("call", "walk-in"))} AS intake,
  {words("m % 5 = 0", ("photo_id", "Proof of Address", "lease"))} AS papers, {words("m % 7 < 2", ("low income", "resident", "veteran", "family"))} AS who FROM {v.ORDERS})
SELECT k AS request_id, '{{' || CASE m % 4 WHEN 0 THEN {served} WHEN 1 THEN substr({note}, 2) || ',"schedule":' || {by_need("schedule", """'{"day":"Monday","time":"10:00","requires_24_hours":false}'""")} || ',"location":' || {by_need("location", "place")}
  WHEN 2 THEN '"available_documents":' || papers || ',"eligibility":' || who ELSE {served} || {note} || ',"intake_methods":' || {by_need("intake_methods", "intake")} END || '}}' AS facts,
  'schedule|location' || CASE WHEN m % 3 = 1 THEN '|intake' ELSE '' END || CASE WHEN m % 5 = 0 THEN '|documents' ELSE '' END || CASE WHEN m % 7 < 2 THEN '|eligibility' ELSE '' END AS areas FROM r"""


@query(_facts())
def hidden_facts_json(spark, sf_dir):
    """What a simulated user knows of the asked areas, as JSON, for each request."""
    r = src.every_request(spark, sf_dir)
    m = (F.col("request_id") / 50).cast("long")
    need = lambda i: F.struct(F.lit(f"need-{i}").alias("need_id"), "service_categories", "schedule", F.struct("counties", "cities", "zipcodes").alias("location"), "intake_methods", "available_documents", "eligibility")
    needs = F.when(m % 2 == 0, F.array(need(1))).otherwise(F.array(need(1), need(2)))
    areas = src.pick(("service", "schedule|location", "documents|eligibility", "intake|service"), m)
    return r.select("request_id", dialogue.hidden_facts(needs, F.lit(None).cast("string"), text.split_pipe(areas)).alias("facts"), _bar(dialogue.concrete_areas(needs)).alias("areas"))


@query("SELECT event_id AS record_id, event_id % 23 <> 0 AS valid_tool_call FROM events")
def jsonl_stream_append(spark, sf_dir):
    """Records appended as JSON lines by a stream, then read back."""
    from ..streaming.records import append_jsonl, read_stream

    path = scratch(spark, "jsonl")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = read_stream(spark, f"{sf_dir}/events.parquet", schema).select(F.col("event_id").alias("record_id"), (F.col("event_id") % 23 != 0).alias("valid_tool_call"))
    append_jsonl(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return src.read_jsonl(spark, f"{path}/out", "record_id long, valid_tool_call boolean")


@query(f"WITH {v.RES} SELECT resource_id, array_to_string(tags_intake, '|') AS intake_methods, counties, p_size % 10 NOT IN (5, 8, 9) AS has_windows FROM res")
def tagged_csv_round_trip(spark, sf_dir):
    """The tagged table written as CSV and read back into its searchable form."""

    path = scratch(spark, "tagged-csv")
    r = src.resources(spark, sf_dir).withColumnRenamed("counties", "counties_served")
    src.write_csv(src.tagged_rows(r), path, "gzip")
    back = src.read_tagged(spark, path)
    return back.select("resource_id", _bar(F.col("intake_methods")).alias("intake_methods"), _bar(F.col("counties")).alias("counties"), (F.size("schedule_windows") > 0).alias("has_windows"))


@query(f"WITH RECURSIVE {_slots()} SELECT conv_id, CAST(n + 1 AS INT) AS turn, array_to_string(plan, ',') AS plan, array_to_string(provided, ',') AS provided, kind FROM st WHERE n > 0")
def conversation_state_stream(spark, sf_dir):
    """Slot states kept by a stateful stream over the agents' messages, one row a reply."""
    from ..streaming.conversations import track
    from ..streaming.records import append_jsonl, read_stream

    path = scratch(spark, "states")
    c = read_stream(spark, f"{sf_dir}/conversations.parquet", spark.read.parquet(f"{sf_dir}/conversations.parquet").schema)
    c = c.where("role = 'assistant'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), src.pick(SUFFIXES, F.col("conv_id") + F.col("turn"))))
    behavior = src.pick(("normal", "self_contradictory", "impatience"), F.col("conv_id"))
    stream = track(c.select("conv_id", "turn", "text", behavior.alias("behavior"), F.lit("location").alias("contradiction_area")))
    append_jsonl(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return src.read_jsonl(spark, f"{path}/out", "conv_id long, turn int, plan string, provided string, kind string")


