"""JSON, arrays and maps as column expressions, and the few parsers that need Python."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attributes(df: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """Fields of a JSON object as columns; columns that exist win."""
    m = F.from_json(F.col(source), "map<string,string>")
    return df.withColumns({f: F.try_element_at(m, F.lit(f)) for f in fields if f not in df.columns})


SPANS = "array<struct<text:string,char_start:int,char_end:int,method:string>>"


def located(spans: Column) -> Column:
    """How many spans were found in their text."""
    return F.coalesce(F.size(F.filter(spans, lambda s: s["method"].isNotNull() & (s["method"] != "none"))), F.lit(0))


def string_list(c: Column) -> Column:
    """A JSON list or a single value as an array without blanks and none or null."""
    parsed = F.from_json(c, "array<string>")
    items = F.when(c.isNull(), F.array().cast("array<string>")).when(F.trim(c).startswith("["), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(F.array(c))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & ~F.lower(x).isin("", "none", "null"))


def joined(items: Column, by: str = "|") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(items)), by)


def collapse_repeats(items: Column) -> Column:
    """Items without those equal to the one kept before."""
    last = lambda s: F.try_element_at(s, F.lit(-1))
    return F.aggregate(items, F.slice(items, 1, 0), lambda s, x: F.when(last(s).eqNullSafe(x) & (F.size(s) > 0), s).otherwise(F.concat(s, F.array(x))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def last_object(c: Column) -> Column:
    """Text from the first brace to the last closing one."""
    m = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(m != "", m)


def close_json(text: str) -> tuple[str | None, bool]:
    """The first JSON value of a text that may be cut, and whether it was repaired.

    A cut value ends behind the last object or list that was closed inside it, and what is open there is closed; a text in
    which none was closed gives nothing. One pass.
    """
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None, False
    text = text[start:]
    try:
        _, end = json.JSONDecoder().raw_decode(text)
        return text[:end], False
    except ValueError:
        pass
    stack, quoted, escaped, last = [], False, False, None
    for i, ch in enumerate(text):
        if quoted:
            quoted, escaped = escaped or ch != '"', not escaped and ch == "\\"
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
            last = i + 1, "".join(reversed(stack))
    if last:
        whole = text[: last[0]] + last[1]
        try:
            json.loads(whole)
            return whole, True
        except ValueError:
            pass
    return None, False


def repaired_json(df: DataFrame, source: str, out: str = "json") -> DataFrame:
    """Adds ``out`` (valid JSON text or null) and ``out``_repaired. Whole texts pass without Python's scanner."""

    @F.pandas_udf("struct<json:string,repaired:boolean>")
    def fix(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            got = [close_json(x) if isinstance(x, str) else (None, False) for x in s]
            yield pd.DataFrame({"json": [g[0] for g in got], "repaired": [g[1] for g in got]})

    fixed = df.withColumn("_fixed", fix(F.col(source)))
    return fixed.withColumn(out, F.col("_fixed.json")).withColumn(out + "_repaired", F.col("_fixed.repaired")).drop("_fixed")


def ingredient_rows(df: DataFrame, source: str, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """One row for each object in the arrays of a JSON answer, and one with null type where there is none.

    ``kinds`` maps the JSON field to the type's name. Rows: keys, ingredient_type, ingredient_index, attrs_json.
    """
    parsed = F.from_json(F.col(source), "map<string,string>")
    one = lambda field, kind: F.transform(F.coalesce(F.from_json(F.try_element_at(parsed, F.lit(field)), "array<string>"), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(kind).alias("t"), i.cast("int").alias("i"), x.alias("a")))
    rows = F.concat(*[one(f, k) for f, k in kinds.items()])
    return df.select(*keys, F.explode_outer(rows).alias("_r")).select(*keys, F.col("_r.t").alias("ingredient_type"), F.col("_r.i").alias("ingredient_index"), F.col("_r.a").alias("attrs_json"))
