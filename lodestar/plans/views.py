"""SQL twins of the directory-shaped views, for checking results with another engine."""

from __future__ import annotations

from ..functions import tagging
from ..sources import directory as d


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(values, by: str) -> str:
    return "[" + ", ".join(map(lit, values)) + f"][({by}) % {len(values)} + 1]"


def labels(pairs: list[tuple[str, str]], otherwise: str | None = None) -> str:
    listed = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {lit(n)} END" for n, c in pairs) + "], lambda v: v IS NOT NULL)"
    return f"(CASE WHEN len({listed}) = 0 THEN [{lit(otherwise)}] ELSE {listed} END)" if otherwise else listed


def has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def match(x: str, patterns) -> str:
    portable = [r"(?:^|[^-]|(?:^|[^e])-)\bmail\b" if "(?<!" in p else p for p in patterns]
    return f"regexp_matches({x}, {lit('|'.join(f'(?:{p})' for p in portable))}, 'i')"


def intake(x: str) -> str:
    return labels([(k, match(f"lower({x})", v)) for k, v in tagging.INTAKE.items()], "empty")


def documents(x: str) -> str:
    y = f"lower({x})"
    return labels([("none", f"({y} <> '' AND {match(y, tagging.NO_DOCUMENTS)})"), ("varies", match(y, tagging.UNCLEAR_DOCUMENTS)), *((k, has(y, v)) for k, v in tagging.DOCUMENTS.items())], "none")


def eligibility(x: str) -> str:
    return labels([(k, has(f"lower({x})", v)) for k, v in tagging.ELIGIBILITY.items()], "none")


def norm(x: str) -> str:
    return f"replace(replace(replace(trim(lower({x})), '.', ''), '-', '_'), ' ', '_')"


def norm_list(xs: str, ignored=()) -> str:
    out = f"list_distinct(list_transform({xs}, lambda x: {norm('x')}))"
    return f"list_filter({out}, lambda x: x NOT IN ({', '.join(map(lit, ignored))}))" if ignored else out


def ordered(xs: str) -> str:
    """Distinct items in the order of their first places; ``xs`` must be a plain column."""
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


#: The windows of the ten schedule texts, worked out by hand.
WINDOW_ROWS = [
    *((0, day, 540, 1020) for day in ("mon", "tue", "wed", "thu", "fri")), *((1, day, 0, 1440) for day in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")),
    (2, "mon", 630, 720), (2, "wed", 630, 720), (2, "sat", 780, 960), *((3, day, 480, 720) for day in ("mon", "fri", "sat", "sun")), (4, "sat", 720, 1440), (4, "sun", 720, 1440),
    *((6, day, 540, 720) for day in ("mon", "tue", "wed", "thu", "fri")), (7, "tue", 1260, 120),
]
STATUS = ("structured", "structured", "structured", "structured", "structured", "appointment_only", "structured", "structured", "unknown", "unsupported")

WINDOWS = "win(k, day, s, e) AS (VALUES " + ", ".join(f"({k}, '{a}', {s}, {e})" for k, a, s, e in WINDOW_ROWS) + ")"

DIR = f"""dir AS (
  SELECT s_suppkey, p_partkey, p_size, 'in211-' || s_suppkey || '-' || p_partkey || '-' || replace(lower(p_name), ' ', '-') AS resource_id, p_name AS service_name,
    p_type || CASE WHEN p_size % 3 = 0 THEN '|' || p_brand ELSE '' END AS service_categories, n_name || CASE WHEN p_size % 5 = 0 THEN '|' || r_name ELSE '' END AS counties,
    'City ' || (s_suppkey % 40) AS city, CAST(46000 + s_suppkey % 97 AS VARCHAR) AS zipcode, {pick(d.SCHEDULES, 'p_size')} AS site_schedule, {pick(d.DETAILS, 'p_partkey')} AS site_details,
    {pick(d.PAPERS, 'p_partkey')} AS documents_required, {pick(d.WHO, 's_suppkey')} AS site_eligibility, CASE WHEN s_suppkey % 11 = 0 THEN 'oh' ELSE 'In' END AS state_province,
    CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '317-555-0100' END AS site_number, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'https://example.org' END AS service_website,
    {pick(d.SUBJECTS, 'p_partkey')} AS subcategories, n_name || CASE WHEN s_suppkey % 13 = 0 THEN '; Statewide' ELSE '' END AS counties_served
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

RES = f"""{DIR}, res AS (
  SELECT *, {norm_list("string_split(service_categories, '|')")} AS r_cat, {norm_list("string_split(counties, '|')")} AS r_county, {norm('city')} AS r_city, {norm('zipcode')} AS r_zip,
    {intake('site_details')} AS tags_intake, {documents('documents_required')} AS tags_docs, {eligibility('site_eligibility')} AS tags_elig FROM dir)"""

#: Where requests come from: every customer, or every order.
CUSTOMERS = "(SELECT c_custkey AS k, c_custkey // 3 AS m, c_custkey AS c, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"
ORDERS = "(SELECT o_orderkey AS k, o_orderkey // 50 AS m, o_custkey AS c, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"

REQ = f"""req AS (
  SELECT k AS request_id, m, CASE k % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'promo' ELSE 'small' END AS cat, replace(lower(n_name), ' ', '_') AS county,
    'city_' || (c % 40) AS city, CAST(46000 + c % 97 AS VARCHAR) AS zip FROM {CUSTOMERS})"""

#: Whether the windows of a resource serve request ``m``.
SERVED = """CASE WHEN m % 4 = 0 THEN TRUE
  WHEN m % 8 = 7 THEN EXISTS (SELECT 1 FROM win WHERE k = p_size % 10 AND s = 0 AND e >= 1440)
  WHEN m % 4 = 1 THEN EXISTS (SELECT 1 FROM win WHERE k = p_size % 10 AND day = 'mon' AND ((s = 0 AND e >= 1440) OR 600 BETWEEN s AND e))
  WHEN m % 4 = 2 THEN EXISTS (SELECT 1 FROM win WHERE k = p_size % 10 AND day = 'sat' AND ((s = 0 AND e >= 1440) OR (s <= 780 AND e >= 900)))
  ELSE EXISTS (SELECT 1 FROM win WHERE k = p_size % 10 AND day = 'tue') END"""


def served(k: str = "p_size % 10") -> str:
    """``SERVED`` over the fixed list of windows, without a correlated query."""
    whole = [i for i in range(10) if any(r[0] == i and r[2] == 0 and r[3] >= 1440 for r in WINDOW_ROWS)]
    at = lambda day, ok: [i for i in range(10) if any(r[0] == i and r[1] == day and ((r[2] == 0 and r[3] >= 1440) or ok(r)) for r in WINDOW_ROWS)]
    inside = lambda xs: f"{k} IN ({', '.join(map(str, xs))})"
    return f"CASE WHEN m % 4 = 0 THEN TRUE WHEN m % 8 = 7 THEN {inside(whole)} WHEN m % 4 = 1 THEN {inside(at('mon', lambda r: r[2] <= 600 <= r[3]))} WHEN m % 4 = 2 THEN {inside(at('sat', lambda r: r[2] <= 780 and r[3] >= 900))} ELSE {inside(at('tue', lambda r: True))} END"


def hits(where: str = "TRUE", category: str = "list_contains(r_cat, cat)", weight: int = 3) -> str:
    """All matching (request, resource) pairs with their scores."""
    return f"""{RES}, {REQ}, hit AS (
  SELECT request_id, resource_id, service_name, res.city, res.zipcode, tags_docs,
    CAST({weight} + CASE WHEN m % 4 <> 0 THEN 2 ELSE 0 END + CASE WHEN list_contains(r_county, county) THEN 2 ELSE 0 END + CASE WHEN r_city = req.city THEN 1 ELSE 0 END + CASE WHEN r_zip = req.zip THEN 1 ELSE 0 END
      + CASE WHEN m % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN m % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN m % 7 < 2 THEN 1 ELSE 0 END AS DOUBLE) AS score,
    concat_ws('|', {"'service_categories'" if weight else 'NULL'}, CASE WHEN m % 4 <> 0 THEN 'schedule' END, CASE WHEN list_contains(r_county, county) THEN 'counties' END, CASE WHEN r_city = req.city THEN 'cities' END,
      CASE WHEN r_zip = req.zip THEN 'zipcodes' END, CASE WHEN m % 3 = 1 THEN 'intake_methods' END, CASE WHEN m % 5 = 0 THEN 'available_documents' END, CASE WHEN m % 7 < 2 THEN 'eligibility' END) AS matched_filters
  FROM req JOIN res ON {category}
  WHERE ({where}) AND (list_contains(r_county, county) OR r_city = req.city OR r_zip = req.zip) AND ({served()})
    AND (m % 3 <> 1 OR list_has_any(tags_intake, ['call', 'walk_in'])) AND (m % 5 <> 0 OR list_has_all(['photo_id', 'proof_of_address', 'lease', 'empty', 'none', 'varies'], tags_docs))
    AND (m % 7 >= 2 OR list_has_all(['low_income', 'resident', 'veteran', 'family', 'none', 'unknown'], tags_elig))),
top AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, lower(service_name), resource_id) AS rank FROM hit)"""


REC = f"""rec AS (
  SELECT event_id AS record_id, 'user-spec-' || user_id AS user_spec_id,
    CASE event_type WHEN 'view' THEN 'normal' WHEN 'click' THEN 'rambling' WHEN 'purchase' THEN 'impatience' WHEN 'signup' THEN 'self_contradictory' WHEN 'error' THEN 'unsupported_request' END AS user_behavior,
    CASE WHEN user_id % 2 = 0 THEN 'single' ELSE 'composite' END AS case_type, CASE WHEN user_id % 4 < 2 THEN 'all_hard' ELSE 'acceptable' END AS constraint_profile,
    CASE event_id % 3 WHEN 0 THEN 'qwen_xml' WHEN 1 THEN 'responses_function_call' ELSE 'none' END AS parse_mode,
    {', '.join(f'event_id % {n} <> 0 AS {k}' for k, n in d.FLAGS.items())}, event_id % 4 <> 0 AS resource_exact_match, CAST(event_id % 5 AS DOUBLE) / 4 AS resource_precision,
    CAST(event_id % 3 AS DOUBLE) / 2 AS resource_recall, event_id % 3 AS predicted_call_count, CAST(1 + event_id % 8 AS INT) AS agent_turns, CAST(1 + event_id % 5 AS INT) AS user_messages,
    CAST(floor(value) AS BIGINT) AS input_tokens, event_id % 97 AS output_tokens,
    {' AND '.join(f'event_id % {n} <> 0' for k, n in d.FLAGS.items() if k != 'valid_tool_call')} AS all_match,
    {' AND '.join(f'event_id % {n} <> 0' for k, n in d.FLAGS.items() if k != 'valid_tool_call')} AND event_id % 4 <> 0 AS end_to_end_match FROM events)"""
