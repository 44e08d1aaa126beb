"""Readers and writers of directory tables, and directory-shaped views over a star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schedule, tagging
from ..functions.text import clean, pipe_join, slugify, split_pipe, split_semicolon
from .storage import kept

#: The columns of the source table and of the two tables written from it.
SOURCE_COLUMNS = (
    "agency_id site_id site_name service_name site_eligibility agency_desc address_1 address_2 city zipcode state_province site_number site_schedule site_details "
    "fee_structure documents_required service_website service_email agency_name latitude longitude taxonomy_categories subcategories counties_served county_count source_row_count"
).split()
RAW_COLUMNS = (
    "resource_id agency_name site_name service_name site_eligibility agency_desc address_1 city zipcode state_province site_number site_schedule site_details "
    "fee_structure documents_required service_website taxonomy_categories subcategories counties_served"
).split()
TAGGED_COLUMNS = "resource_id service_name service_categories counties city zipcode schedule_windows intake_methods document_requirements eligibility".split()


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header; columns are found by name, absent ones are blank, and every value is text."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    return df.select(*((F.col(f"`{c}`") if c in df.columns else F.lit("")).cast("string").alias(c) for c in columns))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return derive(read_csv(spark, path, SOURCE_COLUMNS))


def derive(source: DataFrame) -> DataFrame:
    """Cleaned columns and everything read from their texts. Agency and site ids are required columns."""
    get = lambda c: F.col(c) if c in source.columns else F.lit("")
    name = clean(get("service_name"))
    out = source.select(
        F.concat(F.lit("in211-"), F.col("agency_id"), F.lit("-"), F.col("site_id"), F.lit("-"), slugify(name)).alias("resource_id"), name.alias("service_name"),
        *(clean(get(c)).alias(c) for c in ("agency_name", "site_name", "site_eligibility", "address_1", "city", "zipcode", "state_province", "site_number", "site_schedule", "site_details", "fee_structure", "documents_required", "service_website")),
        *(split_semicolon(get(c)).alias(c) for c in ("taxonomy_categories", "subcategories", "counties_served")),
    )
    return tagged(out)


def tagged(df: DataFrame) -> DataFrame:
    """Adds the columns that are read from schedule, details, documents, eligibility and subcategories."""
    return read_once(df, READERS | {"schedule_status": ("site_schedule", schedule.schedule_status)}).withColumn("service_categories", tagging.service_categories(F.col("subcategories")))


#: What is read from which text of a directory.
READERS = {
    "schedule_windows": ("site_schedule", schedule.schedule_windows), "intake_methods": ("site_details", tagging.intake_methods),
    "document_requirements": ("documents_required", tagging.document_requirements), "eligibility_tags": ("site_eligibility", tagging.eligibility_tags),
}
FEW_TEXTS = 4096


def texts_of(df: DataFrame, made: dict[str, tuple[str, Callable[[Column], Column]]] = READERS) -> DataFrame:
    """(column, text), saved: up to ``FEW_TEXTS`` different texts of the columns that are read."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in dict.fromkeys(c for c, _ in made.values())))
    return kept(df.select(F.explode(each).alias("x")).select("x.*").distinct().limit(FEW_TEXTS), "texts")


def frequent_texts(df: DataFrame, column: str) -> DataFrame:
    """(column, text), saved: up to ``FEW_TEXTS`` texts of one column, by a sketch of the frequent ones, so that only sketches are moved."""
    top = df.where(F.col(column).isNotNull()).agg(F.call_function("approx_top_k", F.col(column), F.lit(FEW_TEXTS), F.lit(4 * FEW_TEXTS)).alias("top"))
    return kept(top.select(F.lit(column).alias("column"), F.explode("top.item").alias("text")), "texts")


def read_once(df: DataFrame, made: dict[str, tuple[str, Callable[[Column], Column]]], texts: DataFrame | None = None) -> DataFrame:
    """Adds columns that are read from a text each, given as (text column, reader).

    Texts of a directory repeat, and reading one costs far more than looking it up. So up to ``FEW_TEXTS`` different ones are read
    once and joined by broadcast; a text that isn't among them is read on its own row, with the same result. If there are no others, the
    readers aren't planned on rows at all: only being there, they make the code of a stage too long to be compiled. ``texts``: as
    ``texts_of`` returns them, if they are known.
    """
    columns, every = list(dict.fromkeys(c for c, _ in made.values())), False
    if texts is None:
        texts = texts_of(df, made)
        every = texts.count() < FEW_TEXTS
    out = df
    for c in columns:
        own = {k: reader for k, (column, reader) in made.items() if column == c}
        known = texts.where(F.col("column") == c).select(F.lit(True).alias("_known"), F.col("text").alias("_text"), *(reader(F.col("text")).alias(f"_{k}") for k, reader in own.items()))
        found = {k: F.when(F.col("_known"), F.col(f"_{k}")).otherwise(F.raise_error("a text came while texts were read") if every else reader(F.col(c))) for k, reader in own.items()}
        out = out.join(F.broadcast(known), F.col(c).eqNullSafe(F.col("_text")), "left").withColumns(found).drop("_known", "_text", *(f"_{k}" for k in own))
    return out


def windows_json(windows: Column) -> Column:
    """A JSON list of windows with clock times beside the minutes."""
    from ..functions.text import format_minutes

    made = lambda w: F.struct(w["day"].alias("day"), format_minutes(w["start_minute"]).alias("start"), format_minutes(w["end_minute"]).alias("end"), w["start_minute"].alias("start_minute"), w["end_minute"].alias("end_minute"))
    return F.to_json(F.transform(windows, made))


def raw_rows(df: DataFrame) -> DataFrame:
    listed = {c: pipe_join(F.col(c)).alias(c) for c in ("taxonomy_categories", "subcategories", "counties_served")}
    return df.select(*(listed.get(c, F.lit("").alias(c) if c == "agency_desc" else F.col(c)) for c in RAW_COLUMNS))


def tagged_rows(df: DataFrame) -> DataFrame:
    return read_once(df, {"_windows": ("schedule_windows", windows_json)}).select(
        "resource_id", "service_name", pipe_join(F.col("service_categories")).alias("service_categories"), pipe_join(F.col("counties_served")).alias("counties"), "city", "zipcode",
        F.col("_windows").alias("schedule_windows"), pipe_join(F.col("intake_methods")).alias("intake_methods"),
        pipe_join(F.col("document_requirements")).alias("document_requirements"), pipe_join(F.col("eligibility_tags")).alias("eligibility"),
    )


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of CSV files, compressed if asked for; each is read by one task, as values may hold line ends, so none has more than ``TASK_ROWS`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", TASK_ROWS).csv(path, header=True, quote='"', escape='"', emptyValue="", compression=compression)


def resources_from_rows(rows: DataFrame) -> DataFrame:
    """The searchable form of a tagged table; older column names stand in where a column is missing, not where it is blank."""
    cols = set(rows.columns)
    get = lambda *names: next((F.col(n) for n in names if n in cols), F.lit(""))
    hours = F.struct(get("schedule_windows").cast("string").alias("raw"), get("site_schedule").alias("text"))
    read = read_once(rows.withColumn("_hours", hours), {"_windows": ("_hours", lambda h: schedule.windows_from_json(h["raw"], h["text"]))})
    return read.select(
        *(clean(get(c)).alias(c) for c in ("resource_id", "service_name")), split_pipe(get("service_categories")).alias("service_categories"), split_pipe(get("counties", "service_area")).alias("counties"),
        *(clean(get(c)).alias(c) for c in ("city", "zipcode")), F.col("_windows").alias("schedule_windows"),
        split_pipe(get("intake_methods")).alias("intake_methods"), split_pipe(get("document_requirements")).alias("document_requirements"), split_pipe(get("eligibility", "eligibility_tags")).alias("eligibility_tags"),
    )


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    return resources_from_rows(df)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=False)


# Views of directory shape over the star schema, for tests and benchmarks.

SCHEDULES = ("Mon-Fri 9am-5pm", "Daily 24 hours", "Mon, Wed 10:30am-noon; Sat 1pm-4pm", "Fri-Mon 8am-12pm", "Weekends noon-midnight", "By appointment only", "Mon-Fri 9am-12pm, 1pm-5pm", "Tue 9pm-2am", "", "Varies")
DETAILS = ("Call for help", "Walk-in or call", "Apply online", "Email or mail a form", "E-mail only", "Text message", "", "Visit the office")
PAPERS = ("Nothing needed", "Photo ID", "Photo ID; proof of address; lease", "Varies by service", "", "Please bring a pay stub", "Insurance card")
WHO = ("Open", "Veterans and family", "Low income residents", "Seniors 60+", "Minority business", "Homeless youth", "Pregnant", "Medicaid or uninsured", "")
SUBJECTS = ("Food", "Housing/Shelter; Utilities", "Employment;Educational Programs", "Consumer Regulation", "Courts; Legal Services", "Public Health;Food ; Transportation;Utilities", "Mutual Support", "Unmapped Thing; Food", "")


def pick(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


TASK_ROWS = 1 << 19


def tasks_for(spark: SparkSession, rows: DataFrame) -> int:
    """A number of tasks that grows with the rows, so that none has many more than ``TASK_ROWS``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resource for each supplier and part that a line item pairs."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem").select("l_suppkey", "l_partkey")
    pairs = lines.repartition(tasks_for(spark, lines), "l_suppkey", "l_partkey").distinct()
    part = t("part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    supplier = t("supplier").select("s_suppkey", "s_nationkey")
    nation, region = t("nation").select("n_nationkey", "n_name", "n_regionkey"), t("region").select("r_regionkey", "r_name")
    df = pairs.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    s, p, size = F.col("s_suppkey"), F.col("p_partkey"), F.col("p_size")
    return df.select(
        s, p, size, F.concat(F.lit("in211-"), s, F.lit("-"), p, F.lit("-"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))).alias("resource_id"), F.col("p_name").alias("service_name"),
        F.concat("p_type", F.when(size % 3 == 0, F.concat(F.lit("|"), "p_brand")).otherwise("")).alias("service_categories"),
        F.concat("n_name", F.when(size % 5 == 0, F.concat(F.lit("|"), "r_name")).otherwise("")).alias("counties"),
        F.concat(F.lit("City "), s % 40).alias("city"), (46000 + s % 97).cast("string").alias("zipcode"),
        pick(SCHEDULES, size).alias("site_schedule"), pick(DETAILS, p).alias("site_details"), pick(PAPERS, p).alias("documents_required"), pick(WHO, s).alias("site_eligibility"),
        F.when(s % 11 == 0, "oh").otherwise("In").alias("state_province"), F.when(p % 6 == 0, "").otherwise("317-555-0100").alias("site_number"), F.when(p % 4 == 0, "").otherwise("https://example.org").alias("service_website"),
        pick(SUBJECTS, p).alias("subcategories"), F.concat("n_name", F.when(s % 13 == 0, "; Statewide").otherwise("")).alias("counties_served"),
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory in its searchable form."""
    return searchable(directory(spark, sf_dir))


def searchable(d: DataFrame, *keep: str, texts: DataFrame | None = None) -> DataFrame:
    """Rows of ``directory`` parsed into resources, with the columns named in ``keep``."""
    return read_once(d, READERS, texts).select("resource_id", "service_name", split_pipe(F.col("service_categories")).alias("service_categories"), split_pipe(F.col("counties")).alias("counties"), "city", "zipcode", *READERS, *keep)


SCHEDULE_ARGS = "struct<day:string,start_time:string,end_time:string,time:string,requires_24_hours:boolean>"


def every_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search arguments, one row for every order."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    o = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return _arguments(o.join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_orderkey"), (F.col("o_orderkey") / 50).cast("long"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search arguments, one row for every customer."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    c = t("customer").select("c_custkey", "c_nationkey").join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _arguments(c, F.col("c_custkey"), (F.col("c_custkey") / 3).cast("long"))


def _arguments(df: DataFrame, k: Column, m: Column) -> DataFrame:
    """Arguments from a key, a number that decides which facets are asked for, and the customer's nation and key."""
    c = F.col("c_custkey")
    none = F.array().cast("array<string>")
    text = lambda when, v: F.when(when, F.lit(v))
    sched = F.struct(
        F.when(m % 4 == 1, "Monday").when(m % 4 == 2, "sat").when((m % 4 == 3) & (m % 8 != 7), "Tues.").alias("day"), text(m % 4 == 2, "13:00").alias("start_time"), text(m % 4 == 2, "15:00").alias("end_time"),
        text(m % 4 == 1, "10:00").alias("time"), (m % 8 == 7).alias("requires_24_hours"),
    )
    return df.select(
        k.alias("request_id"), F.array(F.when(k % 3 == 0, "ECONOMY").when(k % 3 == 1, "PROMO").otherwise("small")).alias("service_categories"), sched.cast(SCHEDULE_ARGS).alias("schedule"),
        F.array("n_name").alias("counties"), F.array(F.concat(F.lit("city "), c % 40)).alias("cities"), F.array((46000 + c % 97).cast("string")).alias("zipcodes"),
        F.when(m % 3 == 1, F.array(F.lit("call"), F.lit("walk-in"))).otherwise(none).alias("intake_methods"),
        F.when(m % 5 == 0, F.array(F.lit("photo_id"), F.lit("Proof of Address"), F.lit("lease"))).otherwise(none).alias("available_documents"),
        F.when(m % 7 < 2, F.array(F.lit("low income"), F.lit("resident"), F.lit("veteran"), F.lit("family"))).otherwise(none).alias("eligibility"),
    )


BEHAVIORS = ("normal", "rambling", "impatience", "self_contradictory", "unsupported_request")
#: Score flags and the divisor that makes each false now and then in the derived records.
FLAGS = {"valid_tool_call": 23, "tool_call_count_match": 3, "service_match": 5, "location_match": 7, "schedule_match": 11, "intake_match": 13, "documents_match": 17, "eligibility_match": 19}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records, one an event."""
    return records_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def records_of(e: DataFrame) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    kind = {"view": "normal", "click": "rambling", "purchase": "impatience", "signup": "self_contradictory", "error": "unsupported_request"}
    behavior = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kind.items()))
    df = e.select(
        i.alias("record_id"), F.concat(F.lit("user-spec-"), u).alias("user_spec_id"), behavior.alias("user_behavior"), F.when(u % 2 == 0, "single").otherwise("composite").alias("case_type"),
        F.when(u % 4 < 2, "all_hard").otherwise("acceptable").alias("constraint_profile"), F.when(i % 3 == 0, "qwen_xml").when(i % 3 == 1, "responses_function_call").otherwise("none").alias("parse_mode"),
        *((i % n != 0).alias(k) for k, n in FLAGS.items()), (i % 4 != 0).alias("resource_exact_match"), (i % 5 / 4.0).cast("double").alias("resource_precision"), (i % 3 / 2.0).cast("double").alias("resource_recall"),
        (i % 3).alias("predicted_call_count"), (1 + i % 8).cast("int").alias("agent_turns"), (1 + i % 5).cast("int").alias("user_messages"), F.floor("value").cast("long").alias("input_tokens"), (i % 97).alias("output_tokens"),
    )
    every = F.lit(True)
    for k in ("tool_call_count_match", "service_match", "location_match", "schedule_match", "intake_match", "documents_match", "eligibility_match"):
        every = every & F.col(k)
    return df.withColumn("all_match", every).withColumn("end_to_end_match", F.col("all_match") & F.col("resource_exact_match"))
