"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def filled(column: Column | str) -> Column:
    """The text, or null when it is empty: the rows for which this is not null have a value."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(column, F.lit(""))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance between two points given in degrees."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2.0)
    # Rounding can lift the chord of two opposite points just above one.
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.greatest(F.lit(0.0), 1 - chord)))


def ratio(numerator: Column, denominator: Column | float) -> Column:
    """`numerator / denominator`, null instead of an error when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), F.lit(denominator) if isinstance(denominator, (int, float)) else denominator)


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(0.0))


def micros(column: Column) -> Column:
    return F.unix_micros(column)


def seconds_interval(seconds: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)).cast("decimal(18,6)"))


def mod_hash(columns: Sequence[Column | str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


# Doubles below this have hundredths that are told apart, and fit a bigint.
MOST_ROUNDED = 1e13
# Splits a double into two halves whose products are exact.
SPLITTER = 134217729.0


def two_places(column: Column) -> Column:
    """`%.2f` as C prints it: the double's exact value is rounded, and a half of a hundredth to the even one.

    The product with 100 and what it was rounded by are taken apart, as Java rounds halves of the shortest text up.
    """
    x = F.abs(column)
    product = x * 100.0
    high = x * SPLITTER - (x * SPLITTER - x)
    error = (high * 100.0 - product) + (x - high) * 100.0
    below = F.floor(product).cast("double")
    half = (product - below == 0.5) & (error != 0)
    hundredths = F.when(half, below + (error > 0).cast("double")).otherwise(F.rint(product)).cast("bigint")
    sign = F.when(column.cast("string").startswith("-"), "-").otherwise("")
    text = F.format_string("%s%d.%02d", sign, F.floor(hundredths / 100), hundredths % 100)
    return F.when(x < MOST_ROUNDED, text).otherwise(F.format_string("%.2f", column))


def exact_mean(name: str) -> Column:
    """The mean of a column of doubles, the same in any order of the rows: added up as decimals of 18 places.

    Means that are equal to a limit are then not above or below it by the rounding of the sum. If some values have no
    such decimal, it is the plain mean.
    """
    exact = F.col(name).try_cast("decimal(28,18)")
    return F.when(F.count(exact) == F.count(name), F.avg(exact).cast("double")).otherwise(F.avg(name))


def title_case(column: Column) -> Column:
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))
