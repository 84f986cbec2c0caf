"""Column expressions with the null and ordering rules the tables rely on.

Everything here is a built-in expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
MICROS_PER_DAY = 86_400_000_000.0
MICROS_PER_HOUR = 3_600_000_000.0


def parse_timestamp(value: Column) -> Column:
    """Zone-free timestamp; text that does not parse becomes null."""
    return value.try_cast("timestamp_ntz")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null when any coordinate is null.

    ``greatest`` and ``least`` skip nulls, so clamping an unknown argument would
    yield 0 km; the guard keeps the distance unknown.
    """
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((phi2 - phi1) / 2)
    half_lng = F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    chord = half_lat * half_lat + F.cos(phi1) * F.cos(phi2) * half_lng * half_lng
    clamped = F.least(F.greatest(chord, F.lit(0.0)), F.lit(1.0))
    return F.when(chord.isNotNull(), F.asin(F.sqrt(clamped)) * (2 * EARTH_RADIUS_KM))


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", start, end) / MICROS_PER_DAY


def hours_between(start: Column, end: Column) -> Column:
    """Fractional hours from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", start, end) / MICROS_PER_HOUR


def late_flag(delivered: Column, lateness_days: Column) -> Column:
    """Null until delivered; a delivered order without an estimate is not late."""
    return F.when(delivered.isNotNull(), F.coalesce(lateness_days > 0, F.lit(False)))


def late_flag_two_valued(lateness_days: Column) -> Column:
    """Exploration variant: an undelivered order counts as not late."""
    return F.coalesce(lateness_days > 0, F.lit(False))


def tri_state(value: Column) -> Column:
    """True / false / null from booleans, 0 and 1, or the words for them."""
    word = F.lower(F.trim(value.cast("string")))
    return (
        F.when(word.isin("true", "1", "1.0"), True)
        .when(word.isin("false", "0", "0.0"), False)
    )


def freight_ratio(price: Column, freight: Column) -> Column:
    """Freight as a share of price plus freight; null on a zero total."""
    total = F.coalesce(price, F.lit(0.0)) + F.coalesce(freight, F.lit(0.0))
    return freight / F.nullif(total, F.lit(0.0))


def cross_state(customer_state: Column, seller_state: Column) -> Column:
    """1 when the states differ; an unknown state differs from everything."""
    return F.coalesce(customer_state != seller_state, F.lit(True)).cast("int")


def cross_state_if_known(customer_state: Column, seller_state: Column) -> Column:
    """Scoring-time variant: null unless both states are given."""
    known = (F.length(customer_state) > 0) & (F.length(seller_state) > 0)
    return F.when(known, (customer_state != seller_state).cast("double"))


def weekend_flag(moment: Column) -> Column:
    """1 on Saturday and Sunday, 0 otherwise and for an unknown moment."""
    return F.coalesce((F.weekday(moment) >= 5).cast("int"), F.lit(0))


def safe_double(value: Column) -> Column:
    """Number from anything; text, NaN and blanks become null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def blank_to_null(value: Column) -> Column:
    """Empty text becomes null."""
    return F.nullif(value.cast("string"), F.lit(""))


def risk_level(probability: Column, threshold: float) -> Column:
    """high / medium / low against a decision threshold."""
    return (
        F.when(probability >= max(2 * threshold, 0.5), "high")
        .when(probability >= threshold, "medium")
        .otherwise("low")
    )


def iso_timestamp(moment: Column) -> Column:
    """Timestamp as ISO text, for CSV and JSON outputs only."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 for an empty whole; full precision."""
    return F.coalesce(part * 100.0 / F.nullif(whole, F.lit(0)), F.lit(0.0))
