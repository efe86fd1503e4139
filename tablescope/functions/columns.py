"""Scalar helpers as Column expressions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescope.functions.constants import SEVERITIES

MICROS_PER_DAY = 86_400_000_000.0
MICROS_PER_HOUR = 3_600_000_000.0


def safe_div(n: Column, d: Column) -> Column:
    """n / d as double, 0 where d is zero or null (ANSI mode would raise)."""
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        n.cast("double") / d.cast("double")
    )


def safe_pct(n: Column, d: Column) -> Column:
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.lit(100.0) * n.cast("double") / d.cast("double")
    )


def contains_ci(haystack: Column, needle: Column | str) -> Column:
    """Literal, case-insensitive substring test; null never matches."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.coalesce(F.contains(F.lower(haystack), F.lower(needle)), F.lit(False))


def starts_with_ci(text: Column, prefix: Column | str) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.coalesce(F.startswith(F.lower(text), F.lower(prefix)), F.lit(False))


def equals_ci(left: Column, right: Column | str) -> Column:
    right = F.lit(right) if isinstance(right, str) else right
    return F.coalesce(F.lower(left) == F.lower(right), F.lit(False))


def is_blank(text: Column) -> Column:
    return F.coalesce(collapse(text) == "", F.lit(True))


def collapse(text: Column) -> Column:
    """Runs of whitespace become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\u0085\p{Z}]+", " "))


def squeeze(text: Column, max_length: int) -> Column:
    """Collapse whitespace, cut at max_length characters and mark the cut."""
    flat = collapse(F.coalesce(text, F.lit("")))
    return F.when(
        F.char_length(flat) > max_length, F.concat(F.left(flat, F.lit(max_length)), F.lit("..."))
    ).otherwise(flat)


def csv_clean(text: Column) -> Column:
    """Null becomes empty; every CR and every LF becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\r\n]", " ")


def csv_field(text: Column) -> Column:
    """One CSV field: cleaned, and quoted only where a comma or quote needs it."""
    clean = csv_clean(text)
    quoted = F.concat(F.lit('"'), F.replace(clean, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(clean.rlike('[,"]'), quoted).otherwise(clean)


def cap_list(values: Column, cap: int, total: Column | None = None) -> Column:
    """First `cap` entries joined by ', ', then how many more there are."""
    total = F.size(values) if total is None else total
    shown = F.array_join(F.slice(values, 1, cap), ", ")
    more = F.concat(F.lit(", +"), (total - cap).cast("string"), F.lit(" more"))
    return F.when(total > cap, F.concat(shown, more)).otherwise(shown)


def split_cols(text: Column) -> Column:
    """'a, b,,c' -> ['a', 'b', 'c']."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def hash_bucket(key: Column, buckets: int = 1_000_000) -> Column:
    """Engine-independent bucket of a key: the first 32 bits of its MD5."""
    digest = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") % buckets


def int_datetime(yyyymmdd: Column, hhmmss: Column) -> Column:
    """Null for what is no moment, such as the 0 and 0 of a job that never ran."""
    return F.try_to_timestamp(F.format_string("%08d%06d", yyyymmdd, hhmmss), F.lit("yyyyMMddHHmmss"))


def megabytes_from_pages(pages: Column) -> Column:
    """8 KB pages to MB, one decimal."""
    return (pages.cast("double") * 8 / 1024.0).cast("decimal(18,1)")


def moment(as_of) -> Column:
    """The explicit 'now' of a run, given as a Column, datetime or text."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def age_days(ts: Column, as_of) -> Column:
    return _micros_between(ts, as_of) / F.lit(MICROS_PER_DAY)


def age_hours(ts: Column, as_of) -> Column:
    return _micros_between(ts, as_of) / F.lit(MICROS_PER_HOUR)


def _micros_between(ts: Column, as_of) -> Column:
    return F.unix_micros(moment(as_of)) - F.unix_micros(ts.cast("timestamp"))


def severity_rank(name: Column) -> Column:
    rank = F.lit(None).cast("int")
    for i, level in enumerate(SEVERITIES):
        rank = F.when(name == level, F.lit(i)).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def severity_from_priority(priority: Column) -> Column:
    """Urgency number (text or integer) to severity; unreadable means Info."""
    p = priority.cast("string").try_cast("int")
    return (
        F.when(p <= 50, "Critical")
        .when(p <= 100, "High")
        .when(p <= 150, "Medium")
        .when(p <= 200, "Low")
        .otherwise("Info")
    )


def thousands(value: Column) -> Column:
    return F.format_string("%,.0f", value.cast("double"))


def number0(value: Column) -> Column:
    return F.format_string("%.0f", value.cast("double"))


def number01(value: Column) -> Column:
    """At most one decimal; a trailing .0 is dropped."""
    return F.regexp_replace(F.format_string("%.1f", value.cast("double")), r"\.0$", "")
