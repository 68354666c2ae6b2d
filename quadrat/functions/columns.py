"""Strings, keys, lookups and dates as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing value, compared after trimming and lower-casing: fixed values.
MISSING = ("", "nan", "none", "null", "<na>")


def present(c: Column) -> Column:
    """Trimmed text, or null where it spells a missing value."""
    t = F.trim(c.cast("string"))
    return F.when(F.lower(t).isin(*MISSING), None).otherwise(t)


def number(c: Column) -> Column:
    """Lenient double: null where the text is no number, NaN becomes null."""
    d = c.cast("string").try_cast("double")
    return F.when(F.isnan(d), None).otherwise(d)


def lookup(c: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Value of ``table`` for the column, by a literal map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c) if pairs else F.lit(None).cast("string")
    return found if default is None else F.coalesce(found, default)


def last_rule_wins(rules: Iterable[tuple[Column, object]]) -> Column:
    """CASE in which a later rule overrides an earlier one."""
    out = F.lit(None)
    for test, value in rules:
        out = F.when(test, value).otherwise(out)
    return out


def borough_of(text: Column, digit: Column) -> Column:
    """Borough name from a text column and a one-digit code; per borough first text, then code, later boroughs override."""
    names = (("1", "MANHATTAN"), ("2", "BRONX"), ("3", "BROOKLYN"), ("4", "QUEENS"), ("5", "STATEN ISLAND"))
    rules: list[tuple[Column, object]] = []
    for code, name in names:
        rules += [(F.upper(F.trim(text)) == name, F.lit(name)), (digit == code, F.lit(name))]
    return last_rule_wins(rules)


def name_contains(c: Column, names: Iterable[str]) -> Column:
    """The first of ``names`` that the lower-cased text contains."""
    out = F.lit(None).cast("string")
    for n in reversed(list(names)):
        out = F.when(F.lower(c).contains(n.lower()), n).otherwise(out)
    return out


def address(house: Column, street: Column) -> Column:
    """House and street joined by a space; one alone if the other is missing; null if both are."""
    h, s = present(house), present(street)
    return F.when(h.isNull() & s.isNull(), None).otherwise(F.concat_ws(" ", h, s))


def coordinate_key(prefix: str, lat: Column, lon: Column) -> Column:
    """Key with seven fixed decimals a coordinate."""
    return F.concat(F.lit(prefix), F.format_string("%.7f", lat), F.lit("_"), F.format_string("%.7f", lon))


def slug(c: Column, most: int | None = None) -> Column:
    """Lower-case words joined by underscores; beyond ``most`` characters cut and closed by a hash of the whole."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    if most is None:
        return s
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit("_"), F.substring(F.sha1(c.cast("binary")), 1, 8)))


def building_number(c: Column, placeholders: Iterable[str] = ()) -> Column:
    """Seven-digit building numbers that begin with 1 to 5; a decimal tail is removed, others and placeholders are null."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "")
    bad = list(placeholders)
    ok = t.rlike(r"^[1-5]\d{6}$")
    return F.when(ok & ~t.isin(*bad) if bad else ok, t)


def percent(c: Column, scale_max: Column) -> Column:
    """"84.7%", "Above 95%" or a bare fraction; ``scale_max``, the column's largest number, tells fractions from percents."""
    t = F.regexp_extract(c.cast("string"), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(c.contains("%") | (scale_max > 1.0), t / 100).otherwise(t)


def path_part(c: Column, from_end: int) -> Column:
    return F.try_element_at(F.split(c, "/"), F.lit(-from_end))


def hash_bucket(key: Column, seed: object, n: int) -> Column:
    """Number below ``n`` from the first eight hexadecimal digits of SHA-256 of ``key|seed``."""
    digest = F.sha2(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int")


def hash_unit(seed: object, *keys: Column) -> Column:
    """Uniform number in [0, 1), fixed by seed and keys whatever the partitioning."""
    return (F.pmod(F.xxhash64(F.lit(str(seed)), *keys), F.lit(1 << 53)) / float(1 << 53)).cast("double")


def parse_dates(c: Column, formats: Iterable[str] = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd[ HH:mm:ss]", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss")) -> Column:
    """First format that fits, as a timestamp without zone; null if none does."""
    t = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def not_placeholder_date(ts: Column, sentinel: str = "1900-01-01") -> tuple[Column, Column]:
    """(date or null where it is the sentinel or before, whether it was)."""
    is_placeholder = F.coalesce(ts <= F.lit(sentinel).cast("timestamp_ntz"), F.lit(False))
    return F.when(~is_placeholder, ts), is_placeholder


def year_bin(year: Column, bins: Iterable[tuple[int, int, str]]) -> Column:
    """Label of the first bin whose inclusive bounds hold the year."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(bins)):
        out = F.when(year.between(lo, hi), name).otherwise(out)
    return out


def local_time(ts: Column, zone: str = "America/New_York") -> Column:
    return F.from_utc_timestamp(ts, zone)


def day_bounds(ts: Column, first: str | None, last: str | None) -> Column:
    """Inclusive range; a bare end date stands for its midnight, so the rest of that day is outside."""
    test = F.lit(True)
    if first:
        test = test & (ts >= F.lit(first).cast("timestamp_ntz"))
    if last:
        test = test & (ts <= F.lit(last).cast("timestamp_ntz"))
    return test
