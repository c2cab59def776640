"""Scalar functions with the meaning the analytics rely on, as Column expressions."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def below_sentinel(value: Column, sentinel: float) -> Column:
    """The value, null from the sentinel up: 'not available' must not count as a measurement."""
    return F.when(value < sentinel, value)


def is_utc_iso(text: Column) -> Column:
    """True for an ISO time with a zone: a trailing Z or an offset."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")


def parse_utc(text: Column) -> Column:
    """A timestamp, null for text without a zone or that is no time."""
    return F.when(is_utc_iso(text), F.try_to_timestamp(text))


def iso_utc(ts: Column) -> Column:
    """ISO time to the second with a trailing Z, in a UTC session."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minutes_between(a: Column, b: Column) -> Column:
    """Minutes from a to b, from microseconds."""
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(60e6)


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounding of ties to the even neighbour."""
    return F.bround(value, digits)


def ship_class(code: Column) -> Column:
    """Vessel class of a numeric AIS type."""
    return F.when(code.between(80, 89), "tanker").when(code.between(70, 79), "cargo").when(code == 30, "fishing").when(code.between(60, 69), "passenger").otherwise("other")


def identity_problem(mmsi: Column) -> Column:
    """Why a nine-digit station identity is no vessel's, or null for a vessel."""
    country = F.substring(mmsi, 1, 3).cast("int")
    return (
        F.when(mmsi.isNull() | ~mmsi.rlike("^[0-9]{9}$"), "not nine digits")
        .when(mmsi.startswith("99"), "aid to navigation")
        .when(mmsi.startswith("98"), "craft of a parent ship")
        .when(mmsi.startswith("97"), "distress transmitter")
        .when(mmsi.startswith("111"), "search and rescue aircraft")
        .when(mmsi.startswith("00"), "coast station")
        .when(mmsi.startswith("0"), "group of ships")
        .when(~country.between(201, 775), "no country code")
    )


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Inverse of the standard normal distribution; Spark has no such function. Null outside (0, 1)."""
    normal = NormalDist()
    return p.map(lambda x: normal.inv_cdf(x) if x is not None and 0 < x < 1 else None).astype("float64")
