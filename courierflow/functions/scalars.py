"""Column expressions: time of day, weather class, risk, contact and text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courierflow import domain as D

# WMO present-weather codes by class; every other code is Clear.
WMO_FOGGY = [45, 48]
WMO_RAINY = [51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 80, 81, 82, 95, 96, 99]
WMO_SNOWY = [71, 73, 75, 77, 85, 86]
WINDY_FROM_KMH = 28.0


def blank_to_null(text: Column) -> Column:
    """Trimmed text, with empty strings turned into null."""
    return F.nullif(F.trim(text), F.lit(""))


def or_default(value: Column, default) -> Column:
    """``value`` unless it is null or zero, as ``value or default`` does."""
    return F.coalesce(F.nullif(value, F.lit(0).cast("double")), F.lit(default))


def time_of_day(ts: Column) -> Column:
    """Morning 5-11, Afternoon 12-16, Evening 17-21, otherwise Night."""
    hour = F.hour(ts)
    return (
        F.when(hour.between(5, 11), "Morning")
        .when(hour.between(12, 16), "Afternoon")
        .when(hour.between(17, 21), "Evening")
        .when(hour.isNotNull(), "Night")
    )


def weather_class(code: Column, windspeed: Column) -> Column:
    """Weather label of an observation; strong wind wins, unknown codes are Clear."""
    return (
        F.when(windspeed >= WINDY_FROM_KMH, "Windy")
        .when(code.isin(WMO_FOGGY), "Foggy")
        .when(code.isin(WMO_RAINY), "Rainy")
        .when(code.isin(WMO_SNOWY), "Snowy")
        .otherwise("Clear")
    )


def delay_risk(minutes: Column) -> Column:
    """Risk label of a predicted duration."""
    return (
        F.when(minutes <= 35, D.RISK_FAST)
        .when(minutes <= 50, D.RISK_STANDARD)
        .otherwise(D.RISK_HIGH)
    )


def contact_email(email: Column, name: Column, host: str = "example.com") -> Column:
    """The given address, or ``first.last@host`` made from the name."""
    made = F.concat(F.replace(F.lower(name), F.lit(" "), F.lit(".")), F.lit(f"@{host}"))
    return F.coalesce(blank_to_null(email), F.when(blank_to_null(name).isNotNull(), made))


def first_given(*columns: str | Column) -> Column:
    """First non-null of several synonymous columns."""
    return F.coalesce(*columns)


def display_timestamp(text: Column) -> Column:
    """ISO text as ``yyyy-MM-dd HH:mm:ss``; unparsable text keeps its first 19 characters."""
    parsed = F.try_to_timestamp(text)
    plain = F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" "))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"), plain)


def parse_id_list(text: Column) -> Column:
    """Ids from a JSON array, or else from comma-separated digits; never null."""
    as_json = F.from_json(text, "array<bigint>")
    pieces = F.transform(F.split(text, ","), lambda p: F.trim(p))
    digits = F.filter(pieces, lambda p: p.rlike("^[0-9]+$"))
    listed = F.transform(digits, lambda p: p.cast("bigint"))
    is_json = F.trim(text).startswith("[")
    empty = F.array().cast("array<bigint>")
    return F.coalesce(F.when(is_json, F.coalesce(as_json, empty)), listed, empty)


def capitalize(text: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def tracking_id(key: Column, seed: str = "42", digits: int = 32) -> Column:
    """``TRK-`` and upper-case hex digits of the key's hash.

    Six digits, as on printed tickets, collide beyond some thousand orders, and 16
    beyond some billions. With the default of 32 (128 bits) a trillion orders hold
    an equal pair with a chance below 10^-14.
    """
    hashed = F.sha2(F.concat_ws("|", key.cast("string"), F.lit(seed)), 256)
    return F.concat(F.lit("TRK-"), F.upper(F.left(hashed, F.lit(digits))))


def hash_bucket(key: Column, buckets: int, seed: str = "42") -> Column:
    """Stable bucket in ``[0, buckets)`` from md5, the same on every engine."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed)))
    return F.pmod(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint"), F.lit(buckets))


def hash_position(key: Column, seed: str = "42") -> Column:
    """First 60 bits of md5 as a number: a stable random order of rows."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed)))
    return F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint")
