"""Scalar text functions as ``Column -> Column``. Blank means the empty string; NULL means "could not be read"."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that counts as white space at the ends of a text.
ENDS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\s\x1c-\x1f]"  # under (?U): every code point that counts as white space, separators included


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """NULL to blank, white-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text(c), f"(?U){SPACE}+", " "))


def strip(c: Column) -> Column:
    """Ends trimmed, inner white space kept."""
    return F.trim(text(c), F.lit(ENDS))


def norm(c: Column) -> Column:
    """The form that searches compare: lower case, no dots, ``_`` for blanks and hyphens."""
    return F.translate(strip(F.lower(c)), "- .", "__")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def run_slug(c: Column) -> Column:
    """A name for an output folder: lower case, letters, digits and ``-_.`` stay; blank becomes ``run``."""
    kept = F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_.-]", "-")
    short = F.regexp_replace(F.regexp_replace(kept, "^[-._]+|[-._]+$", ""), "-{2,}", "-")
    return F.when(short == "", "run").otherwise(short)


def _split(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text(c), pattern), strip), lambda x: x != "")


def split_semicolon(c: Column) -> Column:
    return _split(c, ";")


def split_pipe(c: Column) -> Column:
    return _split(c, r"[|]")


def pipe_join(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda x: x != ""), "|")


def format_minutes(minute: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), F.pmod(minute, F.lit(60)).cast("int"))


def fmt(value: Column) -> Column:
    """Three decimals, ties of the shortest decimal form to even; ``NA`` for NULL. From 10**15 on a double has no fourth decimal to round.

    A value that is written as a tie but is not quite one in binary, such as 0.0005, or one of over 10**12, may differ in the last place
    from its binary value rounded.
    """
    return F.when(value.isNull(), "NA").when(F.abs(value) >= 1e15, F.format_string("%.3f", value.cast("double"))).otherwise(F.format_string("%.3f", F.bround(value.cast("decimal(30,12)"), 3).cast("double")))


def any_of(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether any of the words is a substring; no word boundaries."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def any_match(c: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    return c.rlike("(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def labels(pairs: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The labels whose conditions hold, in the given order; ``[otherwise]`` if none does."""
    found = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in pairs)))
    return found if otherwise is None else let(found, lambda found: _or(found, otherwise))


def _or(found: Column, otherwise: str) -> Column:
    return F.when(F.size(found) == 0, F.array(F.lit(otherwise))).otherwise(found)


def non_blank(values: Column) -> Column:
    """Items trimmed, blanks and NULLs dropped, order and repeats kept; NULL is the empty list."""
    listed = F.coalesce(values, F.array().cast("array<string>"))
    return F.filter(F.transform(F.filter(listed, lambda x: x.isNotNull()), strip), lambda x: x != "")


def string_list(values: Column) -> Column:
    """``non_blank`` without repeats; case is kept."""
    return F.array_distinct(non_blank(values))


def where_some(values: Column, body: Callable[[Column], Column]) -> Column:
    """``body(values)`` of a list with items; any other is the empty list, and ``body`` is not worked out for it."""
    return F.when(F.size(values) > 0, body(values)).otherwise(F.array().cast("array<string>"))


def location_list(values: Column) -> Column:
    """Upper case, everything else than letters A-Z and digits to one space, no repeats."""
    upper = F.transform(string_list(values), lambda x: F.trim(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", " ")))
    return F.array_distinct(F.filter(upper, lambda x: x != ""))


def document_list(values: Column) -> Column:
    """Lower case without the values that stand for no document."""
    lower = F.transform(string_list(values), F.lower)
    return F.array_distinct(F.filter(lower, lambda x: ~x.isin("empty", "none", "varies")))


def norm_set(values: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Distinct normalised items, the ignored ones left out; NULL items and lists vanish."""
    listed = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull())
    out = F.array_distinct(F.transform(listed, norm))
    return F.filter(out, lambda x: ~x.isin(*ignored)) if ignored else out


def same_set(a: Column, b: Column) -> Column:
    """Lists that are equal as they stand are not sorted."""
    return F.when(a == b, True).otherwise(F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))
