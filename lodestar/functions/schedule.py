"""Opening hours: text to windows, clock times, and whether a window serves a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, let, norm, strip, text

#: Days, their spellings, and the texts that schedules are read by.
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
DAY_NAMES = {
    "mon": 0, "monday": 0, "tue": 1, "tues": 1, "tuesday": 1, "wed": 2, "wednesday": 2, "thu": 3, "thur": 3, "thurs": 3, "thursday": 3,
    "fri": 4, "friday": 4, "sat": 5, "saturday": 5, "sun": 6, "sunday": 6,
}
DAY = r"mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs|r|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
TIME = r"(?:\d{1,2}(?::\d{2})?\s*(?:am|pm)|noon|midnight)"
HOURS = rf"((?:{DAY}|daily|every day|weekdays|weekends|[\s,;&-])+?)\s+({TIME})\s*-\s*({TIME})"
DAY_RANGE = rf"\b({DAY})\s*-\s*({DAY})\b"
ALL_DAY = r"\bdaily\s+24\s*hours?\b|\b24/7\b|\b24 hours\b"

WINDOW = "struct<day:string,start_minute:int,end_minute:int>"
WINDOWS = f"array<{WINDOW}>"


def _digits(t: Column, form: str, group: int) -> Column:
    """A group of at most two digits as a number, NULL if it is empty; a cast that fails would cost an exception a row."""
    return let(F.regexp_extract(t, form, group), lambda x: F.when(x != "", x.cast("int")))


def _day_index(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in DAY_NAMES.items() for x in kv)), norm(c))


def parse_days(c: Column) -> Column:
    """The sorted day numbers that a list of days names; a wrapped range goes over Sunday."""
    return let(F.replace(F.lower(c), F.lit(" and "), F.lit(",")), _days)


def _days(t: Column) -> Column:
    ends = F.arrays_zip(F.regexp_extract_all(t, F.lit(DAY_RANGE), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(DAY_RANGE), F.lit(2)).alias("b"))

    def span(z: Column) -> Column:
        a, b = z["a"], z["b"]
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.concat(F.sequence(a, F.lit(6)), F.sequence(F.lit(0), b)))

    ends = F.transform(ends, lambda z: F.struct(_day_index(z["a"]).alias("a"), _day_index(z["b"]).alias("b")))

    named = F.filter(F.transform(F.split(t, r"[,\s;&-]+"), _day_index), lambda x: x.isNotNull())
    listed = F.array_sort(F.array_union(F.flatten(F.transform(ends, span)), named))
    week = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    return F.when(t.contains("daily") | t.contains("every day"), week(0, 6)).when(t.contains("weekdays"), week(0, 4)).when(t.contains("weekends"), week(5, 6)).otherwise(listed)


def parse_schedule_time(c: Column) -> Column:
    """Minutes of ``9am``, ``10:30 pm``, noon and midnight (1440); hours are not range-checked."""
    return let(F.replace(F.lower(clean(c)), F.lit(" "), F.lit("")), _clock)


def _clock(t: Column) -> Column:
    form = r"^(\d{1,2})(?::(\d{2}))?(am|pm)$"
    hour, minute = _digits(t, form, 1), F.coalesce(_digits(t, form, 2), F.lit(0))
    half = F.regexp_extract(t, form, 3)
    hour = F.when((half == "am") & (hour == 12), 0).when((half == "pm") & (hour != 12), hour + 12).otherwise(hour)
    return F.when(t == "noon", 720).when(t == "midnight", 1440).otherwise(F.when(t.rlike(form), hour * 60 + minute))


def _day_windows(days: Column, start: Column, end: Column) -> Column:
    names = F.array(*map(F.lit, DAYS))
    return F.transform(days, lambda d: F.named_struct(F.lit("day"), F.element_at(names, d + 1), F.lit("start_minute"), start.cast("int"), F.lit("end_minute"), end.cast("int")))


def schedule_windows(c: Column) -> Column:
    """Distinct (day, start_minute, end_minute) windows in the order they are named."""
    return let(F.translate(F.lower(clean(c)), "–—", "--"), _windows)


def _windows(t: Column) -> Column:
    none = F.array().cast(WINDOWS)
    whole = F.when(t.rlike(ALL_DAY), _day_windows(F.sequence(F.lit(0), F.lit(6)), F.lit(0), F.lit(1440))).otherwise(none)
    part = [F.regexp_extract_all(t, F.lit(HOURS), F.lit(k)).alias(n) for k, n in ((1, "d"), (2, "s"), (3, "e"))]
    read = F.transform(F.arrays_zip(*part), lambda z: F.struct(parse_days(z["d"]).alias("d"), parse_schedule_time(z["s"]).alias("s"), parse_schedule_time(z["e"]).alias("e")))
    found = F.transform(read, lambda z: _day_windows(z["d"], z["s"], z["e"]))
    return F.array_distinct(F.concat(whole, F.flatten(found)))


def schedule_status(c: Column, windows: Column | None = None) -> Column:
    t = F.lower(clean(c))
    windows = schedule_windows(c) if windows is None else windows
    by_appointment = t.contains("by appointment") | t.contains("appointment only") | t.contains("by appoin")
    return F.when(F.size(windows) > 0, "structured").when(by_appointment, "appointment_only").when(t != "", "unsupported").otherwise("unknown")


def parse_24_hour_time(c: Column) -> Column:
    t, form = clean(c), r"^(\d{1,2}):(\d{2})$"
    hour, minute = _digits(t, form, 1), _digits(t, form, 2)
    return F.when((hour <= 23) & (minute <= 59), hour * 60 + minute)


def parse_hhmm(c: Column) -> Column:
    """``h:m`` with signs and blanks allowed around the numbers; ``24:00`` is no time."""
    return let(F.split(strip(c), ":"), _hhmm)


def _hhmm(parts: Column) -> Column:
    number = lambda x: F.when(strip(x).rlike(r"^[+-]?\d+(?:_\d+)*$"), F.replace(strip(x), F.lit("_"), F.lit("")).try_cast("int"))
    hour, minute = number(F.get(parts, 0)), number(F.get(parts, 1))
    return F.when((F.size(parts) == 2) & hour.between(0, 23) & minute.between(0, 59), hour * 60 + minute)


def _item_minute(item: Column, key: str) -> Column:
    """Minutes of one end of a JSON window: the number if its key is there, else the clock time."""
    number = F.try_variant_get(item, f"$.{key}_minute", "variant")
    kind = F.schema_of_variant(number)
    as_text = F.try_variant_get(item, f"$.{key}_minute", "string")
    whole = F.when(kind == "STRING", F.when(strip(as_text).rlike(r"^[+-]?\d+$"), strip(as_text).try_cast("int"))).when(
        kind == "BOOLEAN", F.try_variant_get(item, f"$.{key}_minute", "boolean").cast("int")
    ).otherwise(F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(item, f"$.{key}_minute", "double").cast("int")))
    clock = text(F.try_variant_get(item, f"$.{key}", "string"))
    clock = F.when(clock == "24:00", 1440).otherwise(parse_24_hour_time(clock)) if key == "end" else parse_24_hour_time(clock)
    return F.when(number.isNotNull(), whole).otherwise(clock)


def windows_from_json(raw: Column, fallback: Column) -> Column:
    """Windows of a JSON list, invalid items left out; anything but a list falls back to the schedule text."""
    v = F.try_parse_json(raw)
    listed = F.try_variant_get(v, "$", "array<variant>")

    def made(x: Column) -> Column:
        return F.named_struct(F.lit("day"), F.lower(text(F.try_variant_get(x, "$.day", "string"))), F.lit("start_minute"), _item_minute(x, "start"), F.lit("end_minute"), _item_minute(x, "end"))

    good = F.filter(F.transform(listed, made), lambda w: w["day"].isin(*DAYS) & w["start_minute"].isNotNull() & w["end_minute"].isNotNull())
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), good).otherwise(schedule_windows(fallback))


def is_24_hour_window(w: Column) -> Column:
    return (w["start_minute"] == 0) & (w["end_minute"] >= 1440)


REQUEST = "struct<requires_24_hours:boolean,day:string,time_minute:int,start_minute:int,end_minute:int>"


def schedule_request(s: Column) -> Column:
    """A search's schedule constraint from struct<day,start_time,end_time,time,requires_24_hours>; NULL if there is none."""
    read = let(s, lambda s: F.struct(F.substring(norm(s["day"]), 1, 3).alias("day"), *(parse_hhmm(s[c]).alias(c) for c in ("start_time", "end_time", "time")), F.coalesce(s["requires_24_hours"], F.lit(False)).alias("whole")))
    return let(read, _request)


def _request(s: Column) -> Column:
    day, start, end, time = s["day"], s["start_time"], s["end_time"], s["time"]
    point = F.when(start == end, start).when(start < end, None).otherwise(time)
    ranged = start < end
    some = F.struct(F.lit(False).alias("requires_24_hours"), day.alias("day"), point.alias("time_minute"), F.when(ranged, start).alias("start_minute"), F.when(ranged, end).alias("end_minute"))
    whole = F.struct(F.lit(True).alias("requires_24_hours"), F.lit(None).cast("string").alias("day"), *(F.lit(None).cast("int").alias(x) for x in ("time_minute", "start_minute", "end_minute")))
    return F.when(s["whole"], whole.cast(REQUEST)).when(day.isin(*DAYS), some.cast(REQUEST))


def window_serves(w: Column, r: Column) -> Column:
    """Same day, and open all day, at the point, or over the whole range; a day alone is served by any window."""
    inside = F.when(r["time_minute"].isNotNull(), (w["start_minute"] <= r["time_minute"]) & (r["time_minute"] <= w["end_minute"])).when(
        r["start_minute"].isNotNull(), (w["start_minute"] <= r["start_minute"]) & (w["end_minute"] >= r["end_minute"])
    ).otherwise(True)
    return (w["day"] == r["day"]) & (is_24_hour_window(w) | inside)


def schedule_matches(windows: Column, r: Column) -> Column:
    """True without a constraint."""
    whole = F.exists(windows, is_24_hour_window)
    return F.when(r.isNull(), True).when(r["requires_24_hours"], whole).otherwise(F.exists(windows, lambda w: window_serves(w, r)))


STEP = 30  # minutes of a slot of the index of opening hours
LAST = 1439


def asked_hours(r: Column) -> Column:
    """The one key under which an index of opening hours is asked for a constraint: all day, the slot of its first minute, or its day; none without a constraint."""
    first = F.coalesce(r["time_minute"], r["start_minute"])
    slot = F.call_function("div", first, F.lit(STEP)).cast("string")
    key = F.when(r["requires_24_hours"], F.lit("24")).otherwise(F.concat_ws(":", r["day"], slot))
    return F.when(r.isNull(), F.array().cast("array<string>")).otherwise(F.array(key))


def served_hours(windows: Column) -> Column:
    """Every key of ``asked_hours`` that one of the windows may serve: days, the slots that windows reach into, and all day.

    A window that ends before it begins serves its day only. Keys narrow down; ``schedule_matches`` decides.
    """

    def keys(w: Column) -> Column:
        slots = F.sequence(F.call_function("div", w["start_minute"], F.lit(STEP)), F.call_function("div", F.least(w["end_minute"], F.lit(LAST)), F.lit(STEP)))
        inside = F.when((w["start_minute"] <= w["end_minute"]) & (w["start_minute"] <= LAST), F.transform(slots, lambda s: F.concat_ws(":", w["day"], s.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(w["day"]), inside, F.when(is_24_hour_window(w), F.array(F.lit("24"))).otherwise(F.array().cast("array<string>")))

    return F.array_distinct(F.flatten(F.transform(windows, keys)))


#: The scorer's day names.
FULL_DAYS = {"monday": "mon", "tuesday": "tue", "wednesday": "wed", "thursday": "thu", "friday": "fri", "saturday": "sat", "sunday": "sun"}
SCORED = "struct<day:string,time:string,start_time:string,end_time:string,requires_24_hours:boolean>"


def _two(n: Column) -> Column:
    return F.format_string("%02d", n)


def time_range(c: Column) -> Column:
    """(start, end) of ``1-3`` or ``9:30 to 11``; early hours with an end by noon are taken as afternoon. NULL if no range."""
    return let(F.lower(strip(c)), _range)


def _range(t: Column) -> Column:
    form = r"^(\d{1,2})(?::(\d{2}))?\s*(?:-|to)\s*(\d{1,2})(?::(\d{2}))?$"
    part = lambda k: F.coalesce(_digits(t, form, k), F.lit(0))
    shift = F.when((part(1) < 7) & (part(3) <= 12), 12).otherwise(0)
    return F.when(t.rlike(form), F.struct(F.concat_ws(":", _two(part(1) + shift), _two(part(2))).alias("start"), F.concat_ws(":", _two(part(3) + shift), _two(part(4))).alias("end")))


def single_time(c: Column) -> Column:
    """``HH:MM`` of ``h`` or ``h:mm``; hours before seven are taken as afternoon. NULL if no time."""
    return let(F.lower(strip(c)), _time)


def _time(t: Column) -> Column:
    form = r"^(\d{1,2})(?::(\d{2}))?$"
    hour, minute = _digits(t, form, 1), F.coalesce(_digits(t, form, 2), F.lit(0))
    hour = F.when(hour < 7, hour + 12).otherwise(hour)
    return F.when((hour <= 23) & (minute <= 59), F.concat_ws(":", _two(hour), _two(minute)))


def scored_schedule(s: Column) -> Column:
    """The form in which scores compare schedules; NULL is the empty one. Explicit start and end stay as written."""
    read = let(s, lambda s: F.struct(F.lower(strip(s["day"])).alias("day"), *(strip(s[c]).alias(c) for c in ("start_time", "end_time", "time")), time_range(s["time"]).alias("range"), single_time(s["time"]).alias("point"), F.coalesce(s["requires_24_hours"], F.lit(False)).alias("whole")))
    return let(read, _scored)


def _scored(s: Column) -> Column:
    raw = s["day"]
    day = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FULL_DAYS.items() for x in kv)), raw), raw)
    start, end, time = s["start_time"], s["end_time"], s["time"]
    explicit = (start != "") & (end != "")
    ranged = s["range"]
    a, b = F.when(explicit, start).otherwise(ranged["start"]), F.when(explicit, end).otherwise(ranged["end"])
    both = a.isNotNull() & b.isNotNull()
    point = F.when(both & (a == b), a).when(~both & (time != ""), s["point"])
    made = F.struct(day.alias("day"), point.alias("time"), F.when(both & (a != b), a).alias("start_time"), F.when(both & (a != b), b).alias("end_time"), F.lit(None).cast("boolean").alias("requires_24_hours"))
    whole = F.struct(*(F.lit(None).cast("string").alias(x) for x in ("day", "time", "start_time", "end_time")), F.lit(True).alias("requires_24_hours"))
    return F.when(s["whole"], whole.cast(SCORED)).when(day != "", made.cast(SCORED))
