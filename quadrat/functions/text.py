"""Tokens, n-grams, sentences, quotes and answers as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content: fixed values.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with", "its", "their", "this", "that", "both")


def tokens(c: Column, least: int = 3, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Lower-case words of letters, without markup, short words and stop words."""
    plain = F.regexp_replace(F.lower(c), r"<[^>]*>|[*_`#]+", " ")
    found = F.regexp_extract_all(plain, F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop))


def bound(items: Column, make) -> Column:
    """``make(items)`` with the array bound by a lambda, so it is computed once and not again for each item."""
    return F.get(F.transform(F.array(items), make), 0)


def ngrams(words: Column, n: int) -> Column:
    def grams(w: Column) -> Column:
        last = F.size(w) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    return bound(words, grams)


def sentences(c: Column, least: int = 1, most: int | None = 256) -> Column:
    """Sentences by closing punctuation or line feeds, trimmed, of a least length, at most ``most`` of them."""
    parts = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return parts if most is None else F.slice(parts, 1, most)


def windows(items: Column, size: int, stride: int) -> Column:
    """Sliding windows over an array; a trailing partial window is kept."""
    def slide(x: Column) -> Column:
        n = F.size(x)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda i: F.slice(x, i + 1, size))).otherwise(F.array())

    return bound(items, slide)


def locate_quote(text: Column, quote: Column) -> Column:
    """struct(start, end, method): exact place from 0, else one that ignores white space differences, else method none."""
    q = F.trim(quote)
    exact = F.instr(text, q)
    words = F.split(q, r"\s+")
    pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"\s+")
    at = F.regexp_instr(text, pattern)
    hit = F.regexp_substr(text, pattern)
    usable = (F.length(q) > 0) & text.isNotNull()
    make = lambda s, e, m: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(m).alias("method"))
    none = make(F.lit(None), F.lit(None), "none")
    return F.when(usable & (exact > 0), make(exact - 1, exact - 1 + F.length(q), "exact")).when(usable & (at > 0), make(at - 1, at - 1 + F.length(hit), "whitespace")).otherwise(none)


def word_set_key(c: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Sorted distinct words of letters, longer than two, without stop words: one key for spellings of one idea."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z ]+", " ")), " +")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)))), " ")


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def span_key(c: Column) -> Column:
    """Lower-case span text with single spaces and without closing punctuation; null if nothing is left."""
    k = F.regexp_replace(one_space(F.lower(c)), r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")
    return F.when(F.length(k) > 0, k)


def residual_ratio(c: Column, phrases: Iterable[str]) -> Column:
    """Share of a text's characters left after removing stock phrases, the longest first."""
    t = one_space(F.lower(c))
    rest = t
    for p in sorted(phrases, key=len, reverse=True):
        rest = F.replace(rest, F.lit(p.lower()), F.lit(""))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(rest, r"[\s\p{Punct}]", "")), F.length(F.regexp_replace(t, r"[\s\p{Punct}]", ""))).cast("double"), F.lit(0.0))


def yes_no(c: Column) -> Column:
    """First yes or no (true or false) of an answer as boolean; null if neither occurs."""
    w = F.lower(F.regexp_extract(c, r"(?i)\b(yes|no|true|false)\b", 1))
    return F.when(w.isin("yes", "true"), True).when(w.isin("no", "false"), False)


def split_reasoning(c: Column, close: str = "</think>") -> tuple[Column, Column]:
    """(reasoning, answer): what stands before the first and after the last closing mark; no mark gives no reasoning."""
    has = c.contains(close)
    return F.when(has, F.trim(F.regexp_replace(F.substring_index(c, close, 1), r"^\s*<think>", ""))), F.trim(F.when(has, F.substring_index(c, close, -1)).otherwise(c))


def vocabulary(c: Column, words: Mapping[str, str] | Iterable[str], other: str = "other") -> Column:
    """Member of a vocabulary, matched without case, or ``other``."""
    pairs = words if isinstance(words, Mapping) else {w.lower(): w for w in words}
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*flat), F.lower(F.trim(c))), F.lit(other))


def host_list(c: Column) -> Column:
    """Names of a compressed host list: ``n[01-03,07],m5`` gives n01, n02, n03, n07, m5."""
    parts = F.regexp_extract_all(c, F.lit(r"([^,\[\]]+(?:\[[^\]]*\])?)"), F.lit(1))

    def grow(p):
        head, inner = F.regexp_extract(p, r"^([^\[]+)", 1), F.regexp_extract(p, r"\[([^\]]*)\]", 1)
        item = lambda r: F.when(r.contains("-"), F.transform(F.sequence(F.substring_index(r, "-", 1).cast("int"), F.substring_index(r, "-", -1).cast("int")), lambda k: F.concat(head, F.lpad(k.cast("string"), F.length(F.substring_index(r, "-", 1)), "0")))).otherwise(F.array(F.concat(head, r)))
        return F.when(inner == "", F.array(head)).otherwise(F.flatten(F.transform(F.split(inner, ","), item)))

    return F.flatten(F.transform(parts, grow))


def resource_counts(c: Column, name: str = "gpu") -> Column:
    """map<type, count> of ``gpu:a100:4,gpu:2``; entries without type count as untyped; entries of one type add up."""
    found = F.regexp_extract_all(c, F.lit(rf"{name}(?::[a-zA-Z][\w.-]*)?[:=]\d+"), F.lit(0))
    kind = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, rf"{name}:([a-zA-Z][\w.-]*)", 1), F.lit("")), F.lit("untyped"))
    size = lambda x: F.regexp_extract(x, r"(\d+)$", 1).cast("int")
    total = lambda k: F.aggregate(found, F.lit(0), lambda s, x: F.when(kind(x) == k, s + size(x)).otherwise(s))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(found, kind)), lambda k: F.struct(k, total(k))))
