"""Literal cases for the scalar functions and the operators; expected values are worked out by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import calls, dialogue, schedule, scoring, tagging, text
from lodestar.operators import curate, rollup, search, specgen
from lodestar.sources import directory as src

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    """The column over one row of string values."""
    kinds = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], kinds).select(column.alias("r")).head()["r"]


def windows(spark, t):
    return [tuple(w) for w in one(spark, schedule.schedule_windows(F.col("t")), t=t)]


WEEK = schedule.DAYS


@pytest.mark.parametrize(("t", "want"), [
    ("Mon-Fri 9am-5pm", [(d, 540, 1020) for d in WEEK[:5]]), ("Daily 24 hours", [(d, 0, 1440) for d in WEEK]), ("Mon, Wed 10:30am-noon; Sat 1pm-4pm", [("mon", 630, 720), ("wed", 630, 720), ("sat", 780, 960)]),
    ("Fri-Mon 8am-12pm", [(d, 480, 720) for d in ("mon", "fri", "sat", "sun")]), ("Weekends noon-midnight", [("sat", 720, 1440), ("sun", 720, 1440)]), ("By appointment only", []),
    ("Mon-Fri 9am-12pm, 1pm-5pm", [(d, 540, 720) for d in WEEK[:5]]), ("Tue 9pm-2am", [("tue", 1260, 120)]), (None, []), ("Varies", []), ("Mon and Wed 9am-5pm", [("wed", 540, 1020)]),
    ("Mon-Fri 24 hours", [(d, 0, 1440) for d in WEEK]), ("Mon 1pm-13pm", [("mon", 780, 1500)]), ("Every day 12am – 12:05 AM", [(d, 0, 5) for d in WEEK]), ("Thurs 9am-10am Thursday 9am-10am", [("thu", 540, 600)]), ("Mon 9am to 5pm", []),
])
def test_windows(spark, t, want):
    assert windows(spark, t) == want


@pytest.mark.parametrize(("t", "want"), [("By appoin. call", "appointment_only"), ("", "unknown"), ("Varies", "unsupported"), ("Mon 9am-5pm by appointment", "structured")])
def test_status(spark, t, want):
    assert one(spark, schedule.schedule_status(F.col("t")), t=t) == want


@pytest.mark.parametrize(("t", "want"), [("noon", 720), (" Mid night", 1440), ("12am", 0), ("12:30 PM", 750), ("9", None), ("13pm", 1500), ("9:5am", None)])
def test_clock_times(spark, t, want):
    assert one(spark, schedule.parse_schedule_time(F.col("t")), t=t) == want


@pytest.mark.parametrize(("t", "h24", "hhmm"), [("9:05", 545, 545), ("9:5", None, 545), ("24:00", None, None), ("+9:00", None, 540), (" 9 : 00 ", None, 540), ("1:2:3", None, None), ("", None, None), ("23:59", 1439, 1439), ("-1:00", None, None)])
def test_24_hour_times(spark, t, h24, hhmm):
    assert one(spark, schedule.parse_24_hour_time(F.col("t")), t=t) == h24
    assert one(spark, schedule.parse_hhmm(F.col("t")), t=t) == hhmm


REQUESTS = [
    (("mon", 540, 1020), {"day": "mon", "time": "17:00"}, True), (("mon", 540, 1020), {"day": "Monday", "start_time": "09:00", "end_time": "17:00"}, True), (("mon", 540, 1020), {"day": "mon", "start_time": "08:00", "end_time": "10:00"}, False),
    (("mon", 0, 1440), {"day": "mon", "time": "03:00"}, True), (("mon", 0, 1440), {"day": "tue"}, False), (("sat", 720, 1440), {"day": "sat", "start_time": "13:00", "end_time": "24:00"}, True),
    (("tue", 1260, 120), {"day": "tue", "time": "22:00"}, False), (("tue", 1260, 120), {"day": "Tues."}, True), (("tue", 1, 2), {"day": "xyz"}, True), (("tue", 1, 2), {"day": "xyz", "requires_24_hours": True}, False),
]


def test_requests_against_windows(spark):
    rows = [([w], tuple(r.get(k) for k in ("day", "start_time", "end_time", "time", "requires_24_hours")), want) for w, r, want in REQUESTS]
    df = spark.createDataFrame(rows, f"w {schedule.WINDOWS}, s {src.SCHEDULE_ARGS}, want boolean")
    got = df.select("want", schedule.schedule_matches(F.col("w"), schedule.schedule_request(F.col("s"))).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


@pytest.mark.parametrize(("t", "want"), [("Call for help", "call"), ("Walk-in or call", "call|walk_in"), ("E-mail only", "email"), ("Email or mail a form", "email|mail"), ("", "empty"), ("Visit", "empty"), ("www.x.org; SMS; FAX; schedule", "online|appointment|text|mail")])
def test_intake(spark, t, want):
    assert "|".join(one(spark, tagging.intake_methods(F.col("t")), t=t)) == want


@pytest.mark.parametrize(("t", "tags", "ok"), [
    ("Nothing needed", "none", True), ("Photo ID; proof of address; lease", "photo_id|proof_of_address|lease", True), ("Varies by service", "varies", False), ("", "none", True), ("Please bring a pay stub", "proof_of_income|lease", True),
    ("Nothing needed, may vary", "none|varies", True), ("NONE", "none", True), ("Call for information", "varies", False), ("whatever", "none", False),
])
def test_documents(spark, t, tags, ok):
    assert "|".join(one(spark, tagging.document_requirements(F.col("t")), t=t)) == tags
    assert one(spark, tagging.documents_usable(F.col("t")), t=t) is ok


@pytest.mark.parametrize(("t", "want"), [("Open", "none"), ("Minority business", "youth"), ("Medicaid or uninsured", "uninsured|medicaid"), ("Low income residents 60+", "low_income|resident|senior"), (None, "none")])
def test_eligibility(spark, t, want):
    assert "|".join(one(spark, tagging.eligibility_tags(F.col("t")), t=t)) == want


def test_taxonomy_is_whole(spark):
    rows = tagging.taxonomy(spark).collect()
    assert len(rows) == 53 and len({r["subcategory"] for r in rows}) == 53 and len({r["category"] for r in rows} - {None}) == 21
    df = spark.createDataFrame([(["Food", "Nope"],), (["Consumer Regulation"],)], "subcategories array<string>")
    assert [r[0] for r in tagging.unknown_subcategories(df).collect()] == ["Nope"]
    with pytest.raises(ValueError, match="Nope"):
        tagging.validate_coverage(df)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n  \x1cab.-é", max_size=12), min_size=1, max_size=8))
def test_text_functions_match_plain_strings(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = df.select(text.clean(F.col("t")).alias("c"), text.strip(F.col("t")).alias("s"), text.norm(F.col("t")).alias("n")).collect()
    for v, r in zip(values, got, strict=True):
        assert (r["c"], r["s"]) == (" ".join(v.split()), v.strip())
        assert r["n"] == v.lower().strip().replace(".", "").replace("-", "_").replace(" ", "_")


@pytest.mark.parametrize(("t", "want"), [("a b", "a-b"), ("", "run"), ("--x..y__", "x..y"), ("a///b", "a-b"), ("é!", "é"), ("Qwen 3", "qwen-3")])
def test_run_slug(spark, t, want):
    assert one(spark, text.run_slug(F.col("t")), t=t) == want


def test_fmt(spark):
    assert [one(spark, text.fmt(F.col("t").cast("double")), t=t) for t in (None, "0.0625", "1", "0.3333")] == ["NA", "0.062", "1.000", "0.333"]


def test_locations_normalise_in_two_ways(spark):
    assert one(spark, text.location_list(F.array(F.col("t"))), t="St.John O'Fallon") == ["ST JOHN O FALLON"]
    assert one(spark, text.norm(F.col("t")), t="St.John O'Fallon") == "stjohn_o'fallon"


@pytest.mark.parametrize(("t", "want"), [("<think>a</think> x", "x"), ("<think>open", "<think>open"), (None, ""), ("a<think>1</think>b<think>\n</think>", "ab")])
def test_reasoning(spark, t, want):
    assert one(spark, calls.strip_reasoning(F.col("t")), t=t) == want


def plain_greedy(predicted, expected):
    used, out = set(), []
    for e in expected:
        best = None
        for i, p in enumerate(predicted):
            n = sum(a == b for a, b in zip(p, e, strict=True))
            if i not in used and (best is None or n > best[0]):
                best = (n, i)
        if best:
            used.add(best[1])
        out.append(best[0] if best else 0)
    return out


def test_greedy_matching_equals_a_loop(spark):
    r = random.Random(1)
    cases = [([tuple(r.choice("ab") for _ in range(4)) for _ in range(r.randrange(4))], [tuple(r.choice("ab") for _ in range(4)) for _ in range(1 + r.randrange(3))]) for _ in range(40)]
    kind = "struct<cat:string,intake:string,doc:string,elig:string>"
    df = spark.createDataFrame([(p, e) for p, e in cases], f"p array<{kind}>, e array<{kind}>")
    none = F.array().cast("array<string>")

    def typed(x):
        return F.struct(F.array(x["cat"]).alias("service_categories"), none.alias("counties"), none.alias("cities"), none.alias("zipcodes"), F.array(x["intake"]).alias("intake_methods"), F.array(x["doc"]).alias("available_documents"), F.array(x["elig"]).alias("eligibility"), F.lit(None).cast("struct<day:string,start_time:string,end_time:string,time:string,requires_24_hours:boolean>").alias("schedule")).cast(calls.ARGS)

    d = df.select(calls.normalize_calls(F.transform("p", typed)).alias("p"), calls.normalize_calls(F.transform("e", typed)).alias("e")).select(scoring.score_calls(F.col("p"), F.col("e")).alias("s"))
    for (p, e), row in zip(cases, d.select("s.*").collect(), strict=True):
        fields = [sum(x[k] for k in scoring.FIELDS) for x in row["per_expected"]]
        want = plain_greedy(p, e)
        assert [f if x["valid_tool_call"] else 0 for f, x in zip(fields, row["per_expected"], strict=True)] == [w + 2 if i < len(p) else 0 for i, w in enumerate(want)]
        assert row["tool_call_count_match"] == (len(p) == len(e)) and row["valid_tool_call"] == bool(p)


def test_limits():
    assert [search.bounded_limit(x) for x in (None, "7", 0, 99, "x", 3.9)] == [10, 7, 1, 20, 10, 3]


def brute_search(requests, resources, limit):
    n = lambda x: x.lower().strip().replace(".", "").replace("-", "_").replace(" ", "_")
    out = {}
    for q in requests:
        hits = []
        for r in resources:
            s, ok = 0.0, True
            for field, theirs, w in (("service_categories", r["service_categories"], 3.0), ("intake_methods", r["intake_methods"], 1.0)):
                if q[field]:
                    ok &= bool({n(x) for x in q[field]} & {n(x) for x in theirs})
                    s += w
            if q["counties"] or q["cities"] or q["zipcodes"]:
                place = [(w, bool({n(x) for x in q[f]} & {n(x) for x in theirs})) for f, theirs, w in (("counties", r["counties"], 2.0), ("cities", [r["city"]], 1.0), ("zipcodes", [r["zipcode"]], 1.0))]
                ok &= any(b for _, b in place)
                s += sum(w for w, b in place if b)
            for field, theirs, ignored in (("available_documents", r["document_requirements"], {"empty", "none", "varies"}), ("eligibility", r["eligibility_tags"], {"none", "unknown"})):
                if q[field]:
                    ok &= {n(x) for x in theirs} - ignored <= {n(x) for x in q[field]}
                    s += 1.0
            if ok:
                hits.append((-s, r["service_name"].lower(), r["resource_id"]))
        out[q["request_id"]] = [(h[2], -h[0]) for h in sorted(hits)[:limit]]
    return out


def test_search_equals_a_nested_loop(spark):
    r = random.Random(2)
    some = lambda xs, k: r.sample(xs, r.randrange(k + 1))
    cats, counties, cities, zips, intake, docs, elig = ["Food", "food", "Tax-Help", "Rent"], ["A", "b", "St. C"], ["X", ".", "y z"], ["1", "2", "3"], ["call", "walk_in", "Mail"], ["none", "lease", "Photo ID"], ["none", "senior", "unknown", "youth"]
    resources = [(f"r{i}", r.choice(["P", "p", "Q"]), some(cats, 2), some(counties, 2), r.choice([*cities, ""]), r.choice(zips), some(intake, 2), some(docs, 2), some(elig, 2), []) for i in range(80)]
    kind = "resource_id string, service_name string, service_categories array<string>, counties array<string>, city string, zipcode string, intake_methods array<string>, document_requirements array<string>, eligibility_tags array<string>, schedule_windows " + schedule.WINDOWS
    requests = [(i, some(cats, 2), some(counties, 1), some(cities, 2), some(zips, 1), some(intake, 1), some(docs, 2), some(elig, 2), None) for i in range(120)]
    asked = "request_id long, service_categories array<string>, counties array<string>, cities array<string>, zipcodes array<string>, intake_methods array<string>, available_documents array<string>, eligibility array<string>, schedule " + src.SCHEDULE_ARGS
    res, req = spark.createDataFrame(resources, kind), spark.createDataFrame(requests, asked)
    got = {}
    for x in search.search(search.request_from_args(req), res, 7).orderBy("request_id", "rank").collect():
        got.setdefault(x["request_id"], []).append((x["resource_id"], x["score"]))
    want = brute_search([x.asDict() for x in req.collect()], [x.asDict() for x in res.collect()], 7)
    assert got == {k: v for k, v in want.items() if v}


def test_search_plan_joins_on_keys(spark):
    plan = search.search(search.request_from_args(src.requests(spark, SF)), src.resources(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, ") >= 4 and "_key#" in plan


def test_tool_schema_lists_values(spark):
    s = search.tool_schema(src.resources(spark, SF))
    assert s["parameters"]["required"] == ["service_categories"] and "lease" in s["parameters"]["properties"]["available_documents"]["items"]["enum"]


def test_curation_of_nothing(spark):
    none = src.tagged(src.directory(spark, SF).limit(0).withColumns({c: text.split_semicolon(F.col(c)) for c in ("subcategories", "counties_served")}).drop("service_categories"))
    assert [r["kept"] for r in curate.funnel(none).collect()] == [0] * 5


def test_source_csv_round_trip(spark, tmp_path):
    header = ",".join(src.SOURCE_COLUMNS)
    row = {"agency_id": "1", "site_id": "2", "service_name": "  Food  Pantry!", "site_schedule": "Mon 9am-5pm", "site_details": "Call", "subcategories": "Food; Employment ;", "counties_served": "A;B", "documents_required": 'said ""lease""'}
    (tmp_path / "in.csv").write_text(header + "\n" + ",".join(f'"{row.get(c, "")}"' for c in src.SOURCE_COLUMNS) + "\n", encoding="utf-8")
    df = src.read_source(spark, f"file://{tmp_path}/in.csv")
    r = df.head()
    assert (r["resource_id"], r["service_name"], r["service_categories"], r["counties_served"], r["document_requirements"]) == ("in211-1-2-food-pantry", "Food Pantry!", ["Food Assistance", "Employment and Job Training"], ["A", "B"], ["lease"])
    src.write_csv(src.raw_rows(df), f"file://{tmp_path}/raw")
    back = src.read_csv(spark, f"file://{tmp_path}/raw", src.RAW_COLUMNS).head()
    assert back["subcategories"] == "Food|Employment" and back["documents_required"] == 'said "lease"'
    src.write_csv(src.tagged_rows(df), f"file://{tmp_path}/tagged")
    assert [tuple(w) for w in src.read_tagged(spark, f"file://{tmp_path}/tagged").head()["schedule_windows"]] == [("mon", 540, 1020)]


def test_older_columns_stand_in(spark):
    df = spark.createDataFrame([("r", "A|B", "x|y", "", "Sat 1pm-2pm")], "resource_id string, service_area string, eligibility_tags string, schedule_windows string, site_schedule string")
    r = src.resources_from_rows(df).head()
    assert (r["counties"], r["eligibility_tags"], [tuple(w) for w in r["schedule_windows"]], r["city"]) == (["A", "B"], ["x", "y"], [("sat", 780, 840)], "")


def test_empty_rollups(spark):
    none = src.records(spark, SF).limit(0)
    assert rollup.overall(none).head()["n"] == 0 and tuple(rollup.turn_stats(none).head()) == (0.0, 0.0, 0, 0.0, 0.0, 0)
    assert tuple(rollup.token_usage(none).head()) == (0, 0, 0, 0.0, 0.0, 0.0) and rollup.parse_none_rate(none).head()[0] == 0.0
    assert "| n |" in rollup.markdown(rollup.overall(src.records(spark, SF)), "Overall").replace("| n ", "| n |", 1)


def plain_fold(asked, behavior, area):
    told, used, turn, plan, kind = ["service"], False, 1, ["service"], "opening"
    for req in asked:
        hit = [g for g in dialogue.SLOTS if set(g) - set(told) and set(g) & set(req)]
        plan = [a for g in hit for a in g if a not in told] if len(hit) > 1 else list(hit[0]) if hit else list(dict.fromkeys(req))
        now = behavior == "self_contradictory" and not used and area in plan
        kind = "impatience" if behavior == "impatience" else "contradiction" if now else "resolved" if behavior == "self_contradictory" else "reply"
        used, turn, told = used or now, turn + 1, list(dict.fromkeys([*told, *plan]))
    return turn, told, used, plan, kind


def test_state_fold_equals_a_loop(spark):
    r = random.Random(3)
    cases = [([r.sample(dialogue.AREAS, 1 + r.randrange(3)) if r.random() > 0.2 else ["service"] for _ in range(r.randrange(6))], r.choice(["normal", "impatience", "self_contradictory"]), r.choice([*dialogue.AREAS, None])) for _ in range(60)]
    df = spark.createDataFrame(cases, "a array<array<string>>, b string, c string")
    got = df.select(dialogue.fold_turns(F.col("a"), F.col("b"), F.col("c")).alias("s")).select("s.*").collect()
    assert [(x["turn"], x["provided"], x["contradiction_used"], x["plan"], x["kind"]) for x in got] == [plain_fold(*c) for c in cases]


def test_stream_keeps_the_same_state(spark):
    from lodestar.plans import QUERIES

    fold = {r["conv_id"]: r for r in QUERIES["slot_state_fold"](spark, SF).collect()}
    last = {}
    for r in QUERIES["conversation_state_stream"](spark, SF).collect():
        if r["turn"] > last.get(r["conv_id"], (0,))[0]:
            last[r["conv_id"]] = (r["turn"], r["provided"].replace(",", "|"), r["plan"].replace(",", "|"), r["kind"])
    assert last == {k: (r["turn"], r["provided"], r["plan"], r["kind"]) for k, r in fold.items() if r["turn"] > 1}


def test_generated_cases_hold_their_answers(spark):
    res = src.resources(spark, SF).where(F.size("schedule_windows") > 0).cache()
    rows = specgen.build_specs(res, 24, 7).cache()
    assert rows.join(specgen.visible(rows, res).where("ok"), ["slot", "try"], "left_anti").count() == 0
    specs = specgen.nested_specs(rows).collect()
    assert specs and all(len(s["needs"]) == (1 if s["case_type"] == "single" else 2) for s in specs)
    assert all(len(set(s["source_resource_ids"])) == len(s["needs"]) and s["source_resource_id"] == s["source_resource_ids"][0] for s in specs)
    fewer = {r["user_spec_id"]: r["ground_truth_resource_id"] for r in specgen.build_specs(res, 8, 7).where("need = 1").collect()}
    more = {r["user_spec_id"]: r["ground_truth_resource_id"] for r in rows.where("need = 1").collect()}
    assert fewer == {k: more[k] for k in fewer}


def test_top_k_is_a_prefix(spark):
    req, res = search.request_from_args(src.requests(spark, SF)), src.resources(spark, SF)
    a = {tuple(r) for r in search.search(req, res, 4).select("request_id", "rank", "resource_id").collect()}
    b = {tuple(r) for r in search.search(req, res, 5).where("rank <= 4").select("request_id", "rank", "resource_id").collect()}
    assert a == b
