"""Queries on transcripts, flat specifications and seeded choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls, dialogue, transcript
from ..operators import specgen
from ..sources import directory as src
from . import views as v
from .registry import query


def _drawn(field: str, seed: int, slot: str, attempt: str, need: str) -> str:
    """``specgen.arithmetic`` in SQL: a whole number below 65536."""
    salt = sum((i + 1) * ord(c) for i, c in enumerate(field)) + seed
    return f"((({slot} * 7919 + {attempt} * 104729 + {need} * 1299709 + {salt}) % 65521) * 25173 + 13849) % 65536"


def _transcripts(spark, sf_dir):
    return transcript.transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant') AS agent_turns, count(*) FILTER (role = 'user') AS user_messages FROM conversations GROUP BY 1")
def transcript_counts(spark, sf_dir):
    counts = {"agent_turns": transcript.agent_turn_count(F.col("raw_agent_outputs")), "user_messages": transcript.user_message_count(F.col("messages"))}
    return _transcripts(spark, sf_dir).select("conv_id", *(c.cast("long").alias(k) for k, c in counts.items()))


@query("SELECT avg(a) AS agent_turns, avg(m) AS messages FROM (SELECT count(*) FILTER (role = 'assistant') AS a, count(*) AS m FROM conversations GROUP BY conv_id)")
def transcript_averages(spark, sf_dir):
    return _transcripts(spark, sf_dir).agg(transcript.average_count(F.col("raw_agent_outputs")).alias("agent_turns"), transcript.average_count(F.col("messages")).alias("messages"))


_KINDS = ("schedule", "location", "intake", "documents", "eligibility")


@query(f"""WITH r AS (SELECT o_orderkey AS k, o_orderkey // 50 AS m, {_drawn('contradiction', 3, 'o_orderkey', '0', '1')} AS u FROM orders),
c AS (SELECT k, u, {v.pick(src.BEHAVIORS, 'k')} AS behavior, list_filter(['schedule', 'location', CASE WHEN m % 3 = 1 THEN 'intake' END, CASE WHEN m % 5 = 0 THEN 'documents' END, CASE WHEN m % 7 < 2 THEN 'eligibility' END], lambda x: x IS NOT NULL) AS areas FROM r)
SELECT k AS request_id, CASE WHEN behavior = 'self_contradictory' THEN areas[1 + u * len(areas) // 65536] END AS area FROM c""")
def contradiction_area(spark, sf_dir):
    """The area in which each request's simulated user contradicts itself: a seeded choice among those with a stated fact."""
    r = src.every_request(spark, sf_dir).withColumns({"slot": F.col("request_id"), "try": F.lit(0), "need": F.lit(1)})
    behavior = src.pick(src.BEHAVIORS, F.col("request_id"))
    need = F.struct("service_categories", "schedule", F.struct("counties", "cities", "zipcodes").alias("location"), "intake_methods", "available_documents", "eligibility")
    return r.select("request_id", dialogue.contradiction_area(F.array(need), behavior, specgen.arithmetic(3)("contradiction")).alias("area"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey // 50 AS m, CASE o_orderkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' ELSE 'small' END AS c, replace(n_name, '_', ' ') AS place
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT k AS request_id, CASE WHEN k % 4 = 3 THEN 2 ELSE 1 END AS calls, CASE WHEN k % 4 = 3 THEN c || '/' || c ELSE c END AS categories, place AS counties, CASE WHEN m % 5 = 0 THEN 'photo_id|proof of address|lease' ELSE '' END AS documents FROM r""")
def expected_calls_flat(spark, sf_dir):
    """Expected calls of specifications with a list of needs, an empty list, or the fields of one need in the specification itself."""
    r, k = src.every_request(spark, sf_dir), F.col("request_id")
    rest = ("schedule", F.struct("counties", "cities", "zipcodes").alias("location"), "intake_methods", "available_documents", "eligibility")
    flat = F.struct(F.get("service_categories", 0).alias("service_category"), *rest)
    need = lambda i: F.struct(F.lit(f"need-{i}").alias("need_id"), "service_categories", *rest)
    needs = F.when(k % 4 == 1, F.array(need(1))).when(k % 4 == 3, F.array(need(1), need(2))).when(k % 4 == 2, F.slice(F.array(need(1)), 1, 0))
    e = r.select("request_id", calls.expected_calls(needs, flat).alias("e"))
    one = F.get("e", 0)
    bar = lambda c: F.array_join(c, "|")
    return e.select("request_id", F.size("e").alias("calls"), F.array_join(F.transform("e", lambda x: bar(x["service_categories"])), "/").alias("categories"), bar(one["counties"]).alias("counties"), bar(one["available_documents"]).alias("documents"))


_METHODS = ("call|email|empty|walk_in|online", "empty", "walk_in", "call|walk_in|referral", "")
_LISTED = v.pick(_METHODS, "p_partkey")


@query(f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'all_hard' ELSE 'acceptable' END AS profile, list_filter(string_split({_LISTED}, '|'), lambda x: x NOT IN ('empty', '')) AS real,
  {_drawn('methods', 5, 'p_partkey', 'p_size', '1')} AS n, ({_drawn('method', 5, 'p_partkey', 'p_size', '1')}) * 32768 AS t FROM part),
s AS (SELECT p_partkey, profile, real, n, list_sort(list_transform(real, lambda x, i: {{'k': (t * (2654435 * (i - 1) + 97) + 40503 * (i - 1)) % 2147483647, 'i': i, 'm': x}})) AS o FROM p)
SELECT p_partkey, array_to_string(list_transform(list_slice(o, 1, CASE WHEN profile = 'acceptable' THEN 2 + n * 2 // 65536 ELSE 1 END), lambda x: x.m), '|') AS methods FROM s""")
def sampled_intake(spark, sf_dir):
    """Intake methods drawn without replacement, by two profiles."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumns({"slot": F.col("p_partkey"), "try": F.col("p_size"), "need": F.lit(1)})
    methods = F.filter(F.split(src.pick(_METHODS, F.col("p_partkey")), r"\|"), lambda x: x != "")
    profile = F.when(F.col("p_partkey") % 2 == 0, "all_hard").otherwise("acceptable")
    return p.select("p_partkey", F.array_join(specgen.sample_intake(methods, profile, specgen.arithmetic(5)), "|").alias("methods"))
