"""Search cases with known answers, drawn from a directory by counters instead of one random stream.

Slot ``i`` and try ``t`` draw every choice from a hash of (seed, i, t, field), so slots are independent, a longer run has a
shorter one as its prefix, and the first try whose sources are among their own top results wins; slots are tried until each has a case. The case type and the
constraint profile follow the slot, the category follows slot and try. ``specs_in_order`` instead gives the cases of a generator
that makes one attempt after the other, in which type and profile follow the number of accepted cases.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import kept
from . import search

CASE_TYPES = ("single", "composite")
PROFILES = ("all_hard", "acceptable")
#: How often each field is part of a need.
SHARE = {"schedule": 0.70, "location": 1.00, "intake_methods": 0.55, "available_documents": 0.45, "eligibility": 0.45}
IGNORED = ("empty", "none", "varies", "unknown")
ROWS_FOR_AN_ATTEMPT = 1024  # as many resources are read in the time that an attempt takes, roughly

Draw = Callable[[str], Column]


def hashed(seed: int) -> Draw:
    """Uniform numbers in [0, 1) from slot, try, need and field."""
    return lambda field: F.pmod(F.xxhash64(F.lit(seed), "slot", "try", "need", F.lit(field)), F.lit(1 << 31)) / float(1 << 31)


def arithmetic(seed: int) -> Draw:
    """The same interface by plain integer arithmetic that any engine repeats."""

    def draw(field: str) -> Column:
        salt = sum((i + 1) * ord(c) for i, c in enumerate(field)) + seed
        x = F.pmod(F.col("slot") * 7919 + F.col("try") * 104729 + F.col("need") * 1299709 + salt, F.lit(65521))
        return F.pmod(x * 25173 + 13849, F.lit(65536)) / 65536.0

    return draw


def by_category(resources: DataFrame) -> DataFrame:
    """The inverted list of resources: one row for each category of each resource."""
    return resources.withColumn("category", F.explode("service_categories"))


def _bucket() -> Column:
    return F.substring(F.md5(F.coalesce("resource_id", F.lit("")).cast("binary")), 1, 2)


def buckets_of(resources: DataFrame) -> DataFrame:
    """(category, bucket, first, n, size): where the resources of a category in each hash bucket stand among all of it.

    Places run over hash buckets, and over ids inside a bucket, so that a category with most rows is no single sort.
    """
    counts = by_category(resources.select("resource_id", "service_categories")).groupBy("category", _bucket().alias("bucket")).agg(F.count("*").alias("n"))  # at most 256 rows a category
    before = Window.partitionBy("category").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("category", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n", F.sum("n").over(Window.partitionBy("category")).alias("size"))


def _at(values: Column, u: Column) -> Column:
    return F.get(values, F.floor(u * F.size(values)).cast("int"))


def sample_schedule(windows: Column, u: Draw) -> Column:
    """struct<day,start_time,end_time,time,requires_24_hours>: a point, a range or a day inside one of the windows."""
    from ..functions.schedule import is_24_hour_window
    from ..functions.text import format_minutes

    kind = "struct<day:string,start_time:string,end_time:string,time:string,requires_24_hours:boolean>"
    null = F.lit(None).cast("string")
    whole = F.struct(null.alias("day"), null.alias("start_time"), null.alias("end_time"), null.alias("time"), F.lit(True).alias("requires_24_hours")).cast(kind)
    part = F.filter(windows, lambda w: ~is_24_hour_window(w))
    w = _at(F.when(F.size(part) > 0, part).otherwise(windows), u("window"))
    s, e = w["start_minute"], w["end_minute"]
    long = e - s > 120
    start = F.when(long, s + 30 * F.floor(u("start") * (F.floor((e - 60 - s) / 30) + 1)).cast("int")).otherwise(s)
    end = F.when(long, F.least(e, start + _at(F.array(F.lit(60), F.lit(90), F.lit(120)), u("length")))).otherwise(e)
    steps = F.ceil((F.greatest(start + 1, end) - start) / 30)
    time = start + 30 * F.floor(u("time") * steps).cast("int")
    style = F.floor(u("style") * 3)
    made = F.struct(w["day"].alias("day"), F.when(style == 0, format_minutes(start)).alias("start_time"), F.when(style == 0, format_minutes(end)).alias("end_time"), F.when(style == 1, format_minutes(time)).alias("time"), F.lit(False).alias("requires_24_hours")).cast(kind)
    any_whole = F.exists(windows, is_24_hour_window)
    return F.when(F.size(windows) == 0, F.lit(None).cast(kind)).when((any_whole & (u("whole") < 0.15)) | is_24_hour_window(w), whole).otherwise(made)


LOCATION = "struct<counties:array<string>,cities:array<string>,zipcodes:array<string>>"


def sample_location(counties: Column, city: Column, zipcode: Column, profile: Column, u: Draw) -> Column:
    none = F.array().cast("array<string>")
    one = lambda x: F.when(x != "", F.array(x)).otherwise(none)
    county = F.when(F.size(counties) > 0, F.array(_at(counties, u("county")))).otherwise(none)
    every = F.struct(county.alias("counties"), one(city).alias("cities"), one(zipcode).alias("zipcodes")).cast(LOCATION)
    names = F.array_compact(F.array(F.when(F.size(counties) > 0, "counties"), F.when(city != "", "cities"), F.when(zipcode != "", "zipcodes")))
    name = _at(names, u("place"))
    single = F.struct(F.when(name == "counties", county).otherwise(none).alias("counties"), F.when(name == "cities", one(city)).otherwise(none).alias("cities"), F.when(name == "zipcodes", one(zipcode)).otherwise(none).alias("zipcodes")).cast(LOCATION)
    return F.when(profile == "acceptable", every).otherwise(single)


def sample_intake(methods: Column, profile: Column, u: Draw) -> Column:
    """One method, or two or three different ones for the acceptable profile, each order of them as likely."""
    real = F.filter(methods, lambda m: m != "empty")
    n = F.when((profile == "acceptable") & (F.size(real) > 1), F.least(F.size(real), F.lit(2) + F.floor(u("methods") * 2).cast("int"))).otherwise(1)
    t = F.floor(u("method") * float(1 << 31)).cast("long")
    place = lambda i: F.pmod(t * (2654435 * i + 97) + 40503 * i, F.lit((1 << 31) - 1))
    shuffled = F.array_sort(F.transform(real, lambda m, i: F.struct(place(i.cast("long")).alias("k"), i.alias("i"), m.alias("m"))))
    return F.transform(F.slice(shuffled, F.lit(1), n), lambda x: x["m"])


def concrete(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: (x != "") & ~x.isin(*IGNORED)))


def needs(drawn: DataFrame, u: Draw) -> DataFrame:
    """Adds the fields of a need to rows that hold a drawn resource, its category and the profile."""
    none, keep = F.array().cast("array<string>"), lambda f: u(f"has_{f}") < SHARE[f]
    schedule = sample_schedule(F.col("schedule_windows"), u)
    return drawn.select(
        "slot", "try", "need", "case_type", "constraint_profile", F.col("resource_id").alias("ground_truth_resource_id"), F.col("service_name").alias("ground_truth_resource_name"), F.array("category").alias("service_categories"),
        F.when(keep("schedule"), schedule).alias("schedule"), sample_location(F.col("counties"), F.col("city"), F.col("zipcode"), F.col("constraint_profile"), u).alias("location"),
        F.when(keep("intake_methods"), sample_intake(F.col("intake_methods"), F.col("constraint_profile"), u)).otherwise(none).alias("intake_methods"),
        F.when(keep("available_documents"), concrete(F.col("document_requirements"))).otherwise(none).alias("available_documents"),
        F.when(keep("eligibility"), concrete(F.col("eligibility_tags"))).otherwise(none).alias("eligibility"),
    )


@dataclass
class Directory:
    """What every round of drawing reads, saved once: resources with their bucket and number, how many of each category are in which bucket, and categories."""

    resources: DataFrame
    buckets: DataFrame
    categories: DataFrame
    size: int

    @classmethod
    def of(cls, resources: DataFrame) -> Directory:
        read = ("resource_id", "service_name", "service_categories", "counties", "city", "zipcode", "schedule_windows", "intake_methods", "document_requirements", "eligibility_tags")
        rows = kept(resources.select(*read, _bucket().alias("bucket"), F.monotonically_increasing_id().alias("_row")), "resources")
        buckets = kept(buckets_of(rows), "buckets")
        names = buckets.select("category", "size").distinct()  # a taxonomy: a few rows
        numbered = names.withColumn("k", F.row_number().over(Window.orderBy("category")) - 1).join(names.agg(F.count("*").alias("total")))
        return cls(rows, buckets, kept(numbered, "categories"), rows.count())

    def round_of(self, attempts: int) -> int:
        """How many attempts a round makes: ``attempts``, or more if they cost little beside one more reading of the resources."""
        return max(attempts, self.size // ROWS_FOR_AN_ATTEMPT)

    def at_places(self, asked: DataFrame) -> DataFrame:
        """``asked`` with the resource at the ``place`` (from 0) of its ``category``. Only buckets that hold such a place are put in order, and of their rows only ids."""
        found = asked.join(self.buckets.drop("size"), "category").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n")))
        found = kept(found.withColumn("_rank", F.col("place") - F.col("first")).drop("first", "n"), "places")
        dealt = by_category(self.resources.select("_row", "resource_id", "service_categories", "bucket")).join(found.select("category", "bucket").distinct(), ["category", "bucket"], "left_semi")
        ranked = dealt.select("category", "bucket", "_row", (F.row_number().over(Window.partitionBy("category", "bucket").orderBy("resource_id", "_row")).cast("long") - 1).alias("_rank"))
        at = kept(found.join(ranked, ["category", "bucket", "_rank"]).drop("bucket", "_rank"), "at")
        return at.join(self.resources.drop("bucket"), "_row").drop("_row")


def _of(resources: DataFrame | Directory) -> Directory:
    return resources if isinstance(resources, Directory) else Directory.of(resources)


def by_slot(slots: DataFrame) -> DataFrame:
    """Case type and constraint profile in turn, by the slot."""
    return slots.withColumns({"case_type": _at(F.array(*map(F.lit, CASE_TYPES)), (F.col("slot") % 2) / 2.0), "constraint_profile": _at(F.array(*map(F.lit, PROFILES)), (F.floor(F.col("slot") / 2) % 2) / 2.0)})


def draw_needs(resources: DataFrame | Directory, count: int, tries: int, u: Draw) -> DataFrame:
    """The needs of the first tries of every slot."""
    d = _of(resources)
    return needs_of(d, by_slot(d.resources.sparkSession.range(count).select(F.col("id").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))), u)


def needs_of(d: Directory, slots: DataFrame, u: Draw) -> DataFrame:
    """The needs of each (slot, try, case_type, constraint_profile): one of a single case, two of a composite one, from different categories and resources."""
    slots = slots.join(F.broadcast(d.categories.select("total").limit(1)))
    k1 = F.pmod(F.col("slot") + F.col("try"), F.col("total"))
    first = slots.withColumn("need", F.lit(1)).withColumn("k", k1)
    second = slots.where("case_type = 'composite' AND total > 1").withColumn("need", F.lit(2))
    second = second.withColumn("k", F.pmod(k1 + 1 + F.floor(u("category") * (F.col("total") - 1)), F.col("total")))
    asked = first.unionByName(second).drop("total").join(d.categories, "k").withColumn("place", F.floor(u("resource") * F.col("size")).cast("long")).drop("size", "total", "k")
    return needs(d.at_places(asked), u)


REQUEST_ID = ("slot", "try", "constraint_profile", "need")


def expected_args(rows: DataFrame) -> DataFrame:
    """Search arguments of each need, as stated: nothing is normalised."""
    key = F.concat_ws("-", *REQUEST_ID)
    return rows.select(key.alias("request_id"), "service_categories", "schedule", "location.counties", "location.cities", "location.zipcodes", "intake_methods", "available_documents", "eligibility")


def seen(rows: DataFrame, resources: DataFrame | Directory, limit: int = 10) -> DataFrame:
    """``rows`` (saved) with ``seen``: whether the need finds its own source among its first results."""
    asked = rows.withColumn("request_id", F.concat_ws("-", *REQUEST_ID))
    known = asked.select("request_id", F.col("ground_truth_resource_id").alias("resource_id"))
    found = search.standing(search.request_from_args(expected_args(rows)), known, _of(resources).resources, limit).where(F.col("before") < limit)
    return asked.join(found.select("request_id", F.lit(True).alias("seen")), "request_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False))).drop("request_id")


def visible(rows: DataFrame, resources: DataFrame | Directory, limit: int = 10) -> DataFrame:
    """(slot, try, ok): whether every need of the case finds its own source among its first results."""
    complete = F.count_if("seen") == F.first(F.when(F.col("case_type") == "composite", 2).otherwise(1))
    different = F.count_distinct("ground_truth_resource_id") == F.count("*")
    return seen(rows, resources, limit).groupBy("slot", "try").agg((complete & different).alias("ok"))


def build_specs(resources: DataFrame, count: int, seed: int, *, tries: int = 8, draw: Callable[[int], Draw] = hashed, partial: bool = False) -> DataFrame:
    """One row for each need of every one of ``count`` cases; raises if they aren't found in max(50 * count, 1000) attempts.

    A slot's case is its first try that passes. Slots without one are tried again in rounds, the first of ``tries`` tries and
    each other of four times as many as the one before, or of more if the directory is large; which slots are open is a table, so any number of cases can be asked for.
    The larger a directory, the fewer of its resources are among any first results: with ``partial`` the attempts are dealt evenly, and the
    slots whose share of them finds no case are left out, instead of an error.
    """
    u, spark = draw(seed), resources.sparkSession
    d, slots = Directory.of(resources), spark.range(count).select(F.col("id").alias("slot"))
    if count and d.resources.isEmpty():
        raise RuntimeError("No resources to draw cases from.")
    won, unfilled, cases = spark.createDataFrame([], "slot long, try int"), count, None
    left, first, size = max(50 * count, 1000), 0, max(tries, d.round_of(0) // max(count, 1))
    most = left // max(count, 1)
    while unfilled and left > 0 and not (partial and first >= most):
        asked = slots.join(won.select("slot"), "slot", "left_anti")
        if left < unfilled:
            asked = asked.orderBy("slot").limit(left)
        n = min(size, most - first) if partial else max(1, min(size, left // unfilled))
        rows = kept(needs_of(d, by_slot(asked.withColumn("try", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))), u), "needs")
        found = kept(visible(rows, d).where("ok").groupBy("slot").agg(F.min("try").alias("try")), "won")
        filled, used = found.agg(F.count("*"), F.coalesce(F.sum(F.col("try") - first + 1), F.lit(0))).head()
        left -= used + n * (min(left, unfilled) - filled)
        chosen = rows.join(found, ["slot", "try"])
        won, unfilled, first, size, cases = won.unionByName(found), unfilled - filled, first + n, 4 * size, chosen if cases is None else cases.unionByName(chosen)
    if unfilled and not partial:
        raise RuntimeError(f"Only {count - unfilled} of {count} cases found in {max(50 * count, 1000) - left} attempts.")
    return _named(needs_of(d, by_slot(won), u) if cases is None else cases, F.col("slot"))


def _named(rows: DataFrame, number: Column) -> DataFrame:
    name = F.format_string("user-spec-%03d", number + 1)
    return rows.withColumns({"user_spec_id": name, "case_id": name, "need_id": F.concat(F.lit("need-"), "need")})


STATES = len(CASE_TYPES) * len(PROFILES)
WIDTH = 256  # steps that are folded in one row


def counts_before(steps: DataFrame, first: int, n: int, start: int, width: int = WIDTH) -> DataFrame:
    """(index, before, got) of a count that step after step grows by ``gain[count % STATES]``, without running the steps in order.

    ``steps``: (index, gain array<long>), ``n`` of them with indexes from ``first`` on; ``start`` is the count before them. What a run of steps adds depends on where it
    begins only by the count modulo ``STATES``, so a run is itself such a step. Blocks of ``width`` steps are folded side by
    side into one step each, and so on until one block is left; then the counts go down again, each block from its own start.
    """
    blocks = steps.withColumn("block", F.call_function("div", F.col("index") - first, F.lit(width))).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("index", "gain"))).alias("steps"))
    if n <= width:
        started = blocks.withColumn("start", F.lit(start).cast("long"))
    else:
        none = F.array(*[F.lit(0).cast("long")] * STATES)
        from_each = lambda t, s: F.transform(t, lambda so_far, k: so_far + F.get(s["gain"], ((k + so_far) % STATES).cast("int")))
        folded = blocks.select(F.col("block").alias("index"), F.aggregate("steps", none, from_each).alias("gain"))
        above = counts_before(folded, 0, -(-n // width), start, width)
        started = blocks.join(above.select(F.col("index").alias("block"), F.col("before").alias("start")), "block")
    row = "struct<index:bigint,before:bigint,got:bigint>"
    begin = F.struct(F.col("start").alias("now"), F.array().cast(f"array<{row}>").alias("out"))

    def walk(a: Column, s: Column) -> Column:
        got = F.get(s["gain"], (a["now"] % STATES).cast("int")).cast("long")
        return F.struct((a["now"] + got).alias("now"), F.concat(a["out"], F.array(F.struct(s["index"].alias("index"), a["now"].alias("before"), got.alias("got")).cast(row))).alias("out"))

    return started.select(F.explode(F.aggregate("steps", begin, walk, lambda a: a["out"])).alias("x")).select("x.*")


def _state(k: Column) -> dict[str, Column]:
    """Case type and profile of a case by the number of cases before it."""
    return {"case_type": F.element_at(F.array(*map(F.lit, CASE_TYPES)), (k % 2 + 1).cast("int")), "constraint_profile": F.element_at(F.array(*map(F.lit, PROFILES)), (F.floor(k / 2) % 2 + 1).cast("int"))}


def attempted(d: Directory, attempts: DataFrame, u: Draw) -> DataFrame:
    """Both needs of each attempt in each profile, saved."""
    asked = attempts.select(F.col("id").alias("slot"), F.lit(0).alias("try"), F.lit("composite").alias("case_type"), F.explode(F.array(*map(F.lit, PROFILES))).alias("constraint_profile"))
    return kept(needs_of(d, asked, u), "needs")


def outcomes(d: Directory, attempts: DataFrame, u: Draw, rows: DataFrame | None = None) -> DataFrame:
    """(index, gain): for each attempt, 1 or 0 for each state in which it may be made: whether its case would be accepted. ``rows``: its needs, if they are known."""
    rows = seen(attempted(d, attempts, u) if rows is None else rows, d)
    of = lambda profile, need: F.bool_or(F.col("seen") & (F.col("constraint_profile") == profile) & (F.col("need") == need))
    several = F.count_distinct("ground_truth_resource_id") == 2
    single, both = lambda p: of(p, 1), lambda p: of(p, 1) & of(p, 2) & several
    states = [f(p) for p in PROFILES for f in (single, both)]
    return rows.groupBy(F.col("slot").alias("index")).agg(F.array(*(F.coalesce(x, F.lit(False)).cast("long") for x in states)).alias("gain"))


def specs_in_order(resources: DataFrame, count: int, seed: int, *, draw: Callable[[int], Draw] = hashed, partial: bool = False) -> DataFrame:
    """The cases of a generator that makes one attempt after the other: one row for each need; if max(50 * count, 1000) attempts don't do, raises or, with ``partial``, gives the cases that they found.

    Case type and profile follow the number of cases accepted so far, the category follows the number of attempts. An
    attempt's draws hang on its number alone, so attempts are judged side by side, each in all ``STATES`` states that it may
    be made in, and ``counts_before`` says which of them it is made in. Rounds of attempts grow fourfold until there are enough; the first has more of them if the directory is large.
    """
    u, spark = draw(seed), resources.sparkSession
    d, limit = Directory.of(resources), max(50 * count, 1000)
    if count and d.resources.isEmpty():
        raise RuntimeError("No resources to draw cases from.")
    taken, first, size, cases = 0, 0, d.round_of(max(2 * count, 64)), None
    while taken < count and first < limit:
        size = min(size, limit - first)
        attempts = spark.range(first, first + size)
        rows = attempted(d, attempts, u)
        steps = kept(outcomes(d, attempts, u, rows), "outcomes")
        run = kept(counts_before(steps, first, size, taken).where("got > 0").select("index", "before"), "accepted")
        made = _made(rows, run.where(F.col("before") < count))
        taken, first, size, cases = taken + run.count(), first + size, 4 * size, made if cases is None else cases.unionByName(made)
    if taken < count and not partial:
        raise RuntimeError(f"Only {taken} of {count} cases found in {limit} attempts.")
    if cases is None:
        cases = _made(attempted(d, spark.range(0), u), spark.createDataFrame([], "index long, before long"))
    return _named(cases, F.col("before")).drop("before")


def _made(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """The needs of the ``accepted`` attempts, each in the state in which it was made."""
    states = accepted.select(F.col("index").alias("slot"), "before").withColumns(_state(F.col("before")))
    return rows.drop("case_type").join(states, ["slot", "constraint_profile"]).where("need = 1 OR case_type = 'composite'")


def nested_specs(rows: DataFrame) -> DataFrame:
    """One row a case, its needs and ground truth as arrays."""
    fields = ("need_id", "ground_truth_resource_id", "ground_truth_resource_name", "service_categories", "schedule", "location", "intake_methods", "available_documents", "eligibility")
    out = rows.groupBy("user_spec_id", "case_type", "constraint_profile").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("needs"))
    truth = F.transform("needs", lambda n: F.struct(n["need_id"].alias("need_id"), n["ground_truth_resource_id"].alias("resource_id"), n["ground_truth_resource_name"].alias("resource_name"), n["service_categories"].alias("service_categories")))
    ids = F.transform("needs", lambda n: n["ground_truth_resource_id"])
    return out.select("user_spec_id", F.col("user_spec_id").alias("case_id"), "case_type", "constraint_profile", F.get(ids, 0).alias("source_resource_id"), ids.alias("source_resource_ids"), "needs", truth.alias("ground_truth_resources"))


def expand_behaviors(specs: DataFrame, behaviors: tuple[str, ...]) -> DataFrame:
    """Every spec with every distinct behaviour, in the given order."""
    listed = list(dict.fromkeys(behaviors))
    return specs.select("*", F.posexplode(F.array(*map(F.lit, listed))).alias("behavior_place", "user_behavior"))
