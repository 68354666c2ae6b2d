"""Source normalizers: dirty text tables to canonical, typed ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import address, coordinate_key, lookup, not_placeholder_date, number, parse_dates, present
from quadrat.operators.rows import first_per, occurrence_suffix, typed, union_relaxed

PERMITS = (
    "source string, permit_id string, job_id string, bin string, borough string, issue_date timestamp_ntz, expiration_date timestamp_ntz, signoff_date timestamp_ntz, "
    "scaffold_type string, permit_status string, permit_subtype string, address string, block string, lot string, job_type string, initial_cost double, raw_latitude double, raw_longitude double"
)


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def scaffold_type(scaffold: Column, shed: Column) -> Column:
    a, b = F.coalesce(F.trim(scaffold) == "1", F.lit(False)), F.coalesce(F.trim(shed) == "1", F.lit(False))
    return F.when(a & b, "both").when(a, "scaffold").when(b, "shed")


def permits_by_flags(df: DataFrame) -> DataFrame:
    """Filings whose scaffold and shed are flags; dates are ISO text."""
    c = lambda n: _col(df, n)
    return typed(df.select(
        F.lit("dob_now").alias("source"), present(c("job_filing_number")).alias("permit_id"), present(c("job_filing_number")).alias("job_id"), present(c("bin")).alias("bin"), F.upper(present(c("borough"))).alias("borough"),
        parse_dates(c("first_permit_date")).alias("issue_date"), parse_dates(c("signoff_date")).alias("signoff_date"), scaffold_type(c("scaffold"), c("shed")).alias("scaffold_type"), present(c("filing_status")).alias("permit_status"),
        address(c("house_no"), c("street_name")).alias("address"), present(c("block")).alias("block"), present(c("lot")).alias("lot"), present(c("job_type")).alias("job_type"), number(c("initial_cost")).alias("initial_cost"),
        number(c("latitude")).alias("raw_latitude"), number(c("longitude")).alias("raw_longitude")), PERMITS)


def permits_by_subtype(df: DataFrame) -> DataFrame:
    """Permits whose subtype names the kind; dates are MM/DD/YYYY text."""
    c = lambda n: _col(df, n)
    sub = F.upper(present(c("permit_subtype")))
    return typed(df.select(
        F.lit("bis").alias("source"), F.concat_ws("-", present(c("job__")), present(c("permit_sequence__"))).alias("permit_id"), present(c("job__")).alias("job_id"), present(c("bin__")).alias("bin"), F.upper(present(c("borough"))).alias("borough"),
        parse_dates(c("issuance_date")).alias("issue_date"), parse_dates(c("expiration_date")).alias("expiration_date"), lookup(sub, {"SH": "shed", "SD": "shed", "SF": "scaffold"}).alias("scaffold_type"), present(c("permit_status")).alias("permit_status"),
        sub.alias("permit_subtype"), address(c("house__"), c("street_name")).alias("address"), present(c("block")).alias("block"), present(c("lot")).alias("lot"), present(c("job_type")).alias("job_type"),
        number(c("gis_latitude")).alias("raw_latitude"), number(c("gis_longitude")).alias("raw_longitude")), PERMITS)


def all_permits(flags: DataFrame, subtypes: DataFrame) -> DataFrame:
    return union_relaxed(permits_by_flags(flags), permits_by_subtype(subtypes))


def inspections(df: DataFrame, boroughs: Mapping[str, str]) -> DataFrame:
    """Inspection rows: typed, placeholder dates nulled and flagged, one row an inspection (critical first, then code)."""
    c = lambda n: _col(df, n)
    when, placeholder = not_placeholder_date(parse_dates(c("inspection_date")))
    rows = df.select(
        present(c("camis")).alias("camis"), present(c("dba")).alias("name"), F.coalesce(lookup(present(c("boro")), boroughs), F.upper(present(c("boro")))).alias("borough"), address(c("building"), c("street")).alias("address"),
        when.alias("inspection_date"), F.coalesce(placeholder, F.lit(False)).alias("is_placeholder_inspection"), present(c("inspection_type")).alias("inspection_type"), present(c("action")).alias("action"), F.upper(present(c("grade"))).alias("grade"),
        number(c("score")).alias("score"), present(c("critical_flag")).alias("critical_flag"), present(c("violation_code")).alias("violation_code"), number(c("latitude")).alias("raw_latitude"), number(c("longitude")).alias("raw_longitude")).where("camis is not null")
    rank = F.when(F.upper("critical_flag") == "CRITICAL", 0).otherwise(1)
    return first_per(rows, ["camis", "inspection_date", "inspection_type"], rank, F.col("violation_code").asc_nulls_last())


def facilities(df: DataFrame) -> DataFrame:
    c = lambda n: _col(df, n)
    return df.select(present(c("uid")).alias("uid"), F.initcap(present(c("facname"))).alias("name"), present(c("address")).alias("address"), F.upper(present(c("boro"))).alias("borough"), present(c("bin")).alias("bin"), present(c("bbl")).alias("bbl"), number(c("latitude")).alias("latitude"), number(c("longitude")).alias("longitude"), present(c("facdomain")).alias("domain"), present(c("facgroup")).alias("group"), present(c("facsubgrp")).alias("subgroup"), present(c("factype")).alias("type"))


def licences(df: DataFrame) -> DataFrame:
    """Licences with a key of lot, type and place; rows that share it are numbered."""
    c = lambda n: _col(df, n)
    rows = df.select(F.coalesce(present(c("assumed_name_s")), present(c("business_legal_name"))).alias("name"), present(c("bbl")).alias("bbl"), present(c("license_type")).alias("license_type"), present(c("license_status")).alias("status"), parse_dates(c("license_issue_date")).alias("issue_date"), parse_dates(c("license_expiration_date")).alias("expiration_date"), address(F.lit(None), c("street")).alias("address"), number(c("latitude")).alias("latitude"), number(c("longitude")).alias("longitude"))
    base = F.concat_ws("_", F.coalesce("bbl", F.lit("na")), F.regexp_replace(F.lower(F.coalesce("license_type", F.lit("na"))), "[^a-z0-9]+", "_"), F.coalesce(coordinate_key("", F.round("latitude", 7), F.round("longitude", 7)), F.lit("na")))
    keyed = rows.withColumn("_base", base)
    return occurrence_suffix(keyed, "_base", [F.col("name"), F.col("issue_date"), F.col("status")]).drop("_base")


def entrances(df: DataFrame, routes: list[str] | None = None) -> DataFrame:
    """Station entrances; YES and NO become booleans; routes are whole tokens of a list."""
    c = lambda n: _col(df, n)
    yes = lambda x: F.when(F.upper(F.trim(x)) == "YES", True).when(F.upper(F.trim(x)) == "NO", False)
    rows = df.select(present(c("station_id")).alias("station_id"), F.initcap(present(c("stop_name"))).alias("name"), present(c("entrance_type")).alias("entrance_type"), yes(c("entry_allowed")).alias("entry_allowed"), yes(c("exit_allowed")).alias("exit_allowed"), F.split(F.upper(F.trim(c("daytime_routes"))), " +").alias("routes"), number(c("entrance_latitude")).alias("latitude"), number(c("entrance_longitude")).alias("longitude"))
    rows = rows.withColumn("uid", coordinate_key("subway_", F.col("latitude"), F.col("longitude")))
    return rows if routes is None else rows.where(F.arrays_overlap("routes", F.array(*[F.lit(r.upper()) for r in routes])))


def vocabulary_or_raise(values: list[str], allowed: list[str]) -> list[str]:
    """Canonical spellings of filter values; an unknown one raises with the nearest known."""
    import difflib

    table = {a.casefold(): a for a in allowed}
    out = []
    for v in values:
        if v.strip().casefold() not in table:
            near = difflib.get_close_matches(v.strip().casefold(), list(table), 1)
            raise ValueError(f"unknown value {v!r}" + (f"; did you mean {table[near[0]]!r}?" if near else ""))
        out.append(table[v.strip().casefold()])
    return out
