"""Scalar expressions: physics, cyclic time, ids and formats. All are built from JVM-side functions."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Magnus formula's constants.
MAGNUS_A, MAGNUS_B = 17.625, 243.04


def dewpoint(temperature: Column, humidity: Column) -> Column:
    """Dew point in degrees Celsius; humidity below 1 % counts as 1 %, null stays null."""
    wet = F.when(humidity < 1, 1.0).otherwise(humidity)
    gamma = F.ln(wet / 100) + MAGNUS_A * temperature / (MAGNUS_B + temperature)
    return MAGNUS_B * gamma / (MAGNUS_A - gamma)


def wind_uv(speed: Column, direction: Column) -> tuple[Column, Column]:
    """The vector the wind blows along; direction is where it comes from, clockwise from north."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def cyclic(ts: str) -> dict[str, Column]:
    """Hour of day and (fractional) day of year on circles."""
    hour, day = F.hour(ts), F.dayofyear(ts) - 1 + F.hour(ts) / 24
    turn = 2 * math.pi
    return {"hour_sin": F.sin(turn * hour / 24), "hour_cos": F.cos(turn * hour / 24), "doy_sin": F.sin(turn * day / 365.25), "doy_cos": F.cos(turn * day / 365.25)}


def corrected_skew(column: str) -> Column:
    """Skewness with the small-sample correction; null below three values."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def correlation(a: str, b: str) -> Column:
    """Pearson's r over the rows where both exist: NaN if either is the same in all of them, null without any. F.corr fails there under ANSI rules."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.when(spread == 0, float("nan")).otherwise(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5 id of a name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def days_in_month(ts: Column) -> Column:
    return F.day(F.last_day(ts))


def six_digits(x: Column) -> Column:
    """Six significant digits, as text."""
    return F.format_string("%.6g", x)
