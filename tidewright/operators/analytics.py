"""Aggregations and exploratory queries: descriptions, calendars, climatology, correlation, distributions, wind."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import correlation, corrected_skew, days_in_month
from .axis import PIECE, by_time, floor_to, hour_number, join_on
from .quality import circular_difference, unpivot
from .ranks import exact_quantiles, group_quantiles

#: The months of each season.
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}


def describe(df: DataFrame, columns: list[str], quantiles: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """(variable, count, mean, std, min, p.., max): moments in one pass, exact quantiles by ranges of the values."""
    aggs = [F.struct(F.lit(c).alias("variable"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")) for c in columns]
    moments = df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    names = [f"p{100 * p:g}".replace(".", "_") for p in quantiles]
    both = join_on(moments, exact_quantiles(df, columns, quantiles), ["variable"], "left")
    return both.select("variable", "count", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(names)], "max")


def resample(df: DataFrame, unit: str, aggs: dict[str, Column], keys: list[str], ts: str = "ts") -> DataFrame:
    """Calendar bins with empty ones in between; a bin without rows has null aggregates and rows = 0."""
    binned = df.withColumn("bin", floor_to(unit, F.col(ts)))
    found = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in aggs.items()])
    span = found.groupBy(*keys).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    bins = span.select(*keys, F.explode(F.expr(f"sequence(_a, _b, interval 1 {unit})")).alias("bin"))
    return join_on(bins, found, [*keys, "bin"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def month_coverage(df: DataFrame, column: str, observed: Column, keys: list[str], per_day: int = 24, ts: str = "ts") -> DataFrame:
    """(keys, month, total, observed, expected, coverage_pct, is_complete): total is null in a month without values."""
    rows = df.withColumn("month", floor_to("MONTH", F.col(ts)))
    kept = F.when(observed, F.col(column))
    out = rows.groupBy(*keys, "month").agg(F.sum(kept).alias("total"), F.count(kept).alias("observed"))
    expected = days_in_month(F.col("month")) * per_day
    return out.withColumns({"expected": expected, "coverage_pct": F.col("observed") * 100 / expected, "is_complete": F.col("observed") == expected})


def complete_months(df: DataFrame, column: str, observed: Column, keys: list[str], per_day: int = 24, ts: str = "ts") -> DataFrame:
    """The months of month_coverage() in which nothing is missing."""
    return month_coverage(df, column, observed, keys, per_day, ts).where("is_complete")


def climatology(monthly: DataFrame, value: str, keys: list[str], month: str = "month") -> DataFrame:
    """Per calendar month 1 to 12 of monthly values: mean, median, min, max and years; months without any are null."""
    by = monthly.groupBy(*keys, F.month(month).alias("m")).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_years"))
    every = monthly.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"))
    return join_on(every, by, [*keys, "m"], "left").withColumn("n_years", F.coalesce("n_years", F.lit(0)))


def pivot_months(monthly: DataFrame, value: str, month: str = "month", keys: list[str] | None = None) -> DataFrame:
    """Years of each of the keys down, months 1 to 12 across."""
    keys = keys or []
    rows = monthly.select(*keys, F.year(month).alias("year"), F.month(month).alias("m"), value)
    out = rows.groupBy(*keys, "year").pivot("m", list(range(1, 13))).agg(F.first(value))
    return out.select(*keys, "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def hour_matrix(df: DataFrame, column: str, row: Column, ts: str = "ts") -> DataFrame:
    """Means by a row key and hour, hours across."""
    out = df.select(row.alias("row"), F.hour(ts).alias("h"), column).groupBy("row").pivot("h", list(range(24))).agg(F.avg(column))
    return out.select("row", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


def season_of(ts: str = "ts") -> Column:
    """The season of a local time, by SEASONS."""
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(F.month(ts).isin(*months), name).otherwise(out)
    return out


def diurnal_curves(df: DataFrame, column: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """(keys, season, hour, mean, n): the daily course of a variable in each season."""
    return df.groupBy(*keys, season_of(ts).alias("season"), F.hour(ts).alias("hour")).agg(F.avg(column).alias("mean"), F.count(column).alias("n"))


def group_thresholds(df: DataFrame, keys: list[str], variables: list[str], season: dict[str, Column], ts: str = "ts") -> DataFrame:
    """(keys, variable, season, n, q1, median, q3, mad)."""
    long = unpivot(df, keys, variables, ts).withColumns(season)
    group = [*keys, "variable", *season]
    q = group_quantiles(long, group, F.col("value"), (0.25, 0.5, 0.75))
    mad = group_quantiles(join_on(long, q, group), group, F.abs(F.col("value") - F.col("q")[1]), (0.5,), "_mad").select(*group, F.col("_mad")[0].alias("mad"))
    return join_on(q, mad, group).select(*group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mad")


def autocorrelation(df: DataFrame, column: str, lags: list[int], keys: list[str], ts: str = "ts", hours: int = PIECE) -> DataFrame:
    """(keys, lag, acf): correlation of a dense series with itself shifted, over pairs that exist; lag 0 is 1.

    Pieces of a series, with the rows that the longest lag reaches back to, give sums of products for all lags at once, by
    position; so no row is copied for a lag, and what is summed up afterwards is one row for each piece and lag. Values are taken
    from the series' mean, which keeps the sums exact enough where the mean is large.
    """
    most = max(lags)
    slim = df.select(*keys, ts, F.col(column).cast("double").alias("x"))
    centred_on = slim.groupBy(*keys).agg(F.avg("x").alias("_mean"))
    slim = join_on(slim, centred_on, keys) if keys else slim.crossJoin(F.broadcast(centred_on))
    series = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("_none"))
    at = hour_number(F.col(ts))
    spots = F.array_distinct(F.array(F.floor(at / hours), F.floor((at + most) / hours))) if most <= hours else F.sequence(F.floor(at / hours), F.floor((at + most) / hours))
    spread = slim.select(series.alias("_series"), at.alias("at"), (F.col("x") - F.col("_mean")).alias("x"), F.explode(spots).alias("_piece"))

    def sums(key, table):
        first = key[1].as_py() * hours
        # The piece's own hours behind the ones before it, NaN where there is no value.
        x = np.full(most + hours, np.nan)
        x[table.column("at").to_numpy() - first + most] = table.column("x").to_numpy(zero_copy_only=False)
        rows = []
        for k in lags:
            a, b = x[most:], x[most - k : most - k + hours]
            both = ~np.isnan(a) & ~np.isnan(b)
            a, b = a[both], b[both]
            rows.append((k, len(a), a.sum(), b.sum(), a @ b, a @ a, b @ b))
        return pa.table([pa.array([key[0].as_py()] * len(rows), table.schema.field("_series").type), *map(pa.array, zip(*rows, strict=True))], names=["_series", "lag", "n", "a", "b", "ab", "aa", "bb"])

    figures = T._parse_datatype_string("lag long, n long, a double, b double, ab double, aa double, bb double")
    parts = spread.groupBy("_series", "_piece").applyInArrow(sums, T.StructType([spread.schema["_series"], *figures.fields]))
    whole = parts.groupBy("_series", "lag").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "ab", "aa", "bb")])
    n = F.nullif(F.col("n"), F.lit(0))
    spread_of = lambda c: F.greatest(F.col(c + c) - F.col(c) * F.col(c) / n, F.lit(0.0))
    r = (F.col("ab") - F.col("a") * F.col("b") / n) / F.nullif(F.sqrt(spread_of("a") * spread_of("b")), F.lit(0.0))
    return whole.select("_series.*", F.col("lag").cast("int").alias("lag"), F.when(F.col("lag") == 0, 1.0).otherwise(r).alias("acf")).drop("_none")


def correlations(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(feature, target, r) of every pair, each over the rows where both exist; r is NaN where one of them never changes."""
    aggs = [F.struct(F.lit(a).alias("feature"), F.lit(b).alias("target"), correlation(a, b).alias("r")) for a in left for b in right]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def histogram(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(variable, bin, n): equal bins from each minimum to its maximum, the last one closed; where these are the same, all values are in that one. Empty bins are left out."""
    bounds = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    rows = df.select(*columns).crossJoin(F.broadcast(bounds))
    cells = []
    for c in columns:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        at = F.when(hi == lo, bins - 1).otherwise(F.floor((F.col(c) - lo) * bins / F.when(hi != lo, hi - lo)))
        cells.append(F.struct(F.lit(c).alias("variable"), F.when(F.col(c).isNotNull(), F.least(at, F.lit(bins - 1))).cast("int").alias("bin")))
    return rows.select(F.inline(F.array(*cells))).where("bin is not null").groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"))


def skews(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, skew, skew_log1p), corrected for the number of values."""
    logs = df.select(*columns, *[F.log1p(c).alias(f"_log_{c}") for c in columns])
    aggs = [F.struct(F.lit(c).alias("variable"), corrected_skew(c).alias("skew"), corrected_skew(f"_log_{c}").alias("skew_log1p")) for c in columns]
    return logs.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def cut(x: Column, edges: list[float]) -> Column:
    """Index of the right-closed bin of x, the first one closed on both sides; null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        low = x >= a if i == 0 else x > a
        out = F.when(low & (x <= b), i).otherwise(out)
    return out


def speed_bins(df: DataFrame, speed: str, direction: str, edges: list[float], keys: list[str], ts: str = "ts") -> DataFrame:
    """(bin, n, mean_turn): mean absolute turn of the direction from hour to hour, by speed."""
    turn = F.abs(circular_difference(F.col(direction), F.lag(direction).over(by_time(keys, ts))))
    rows = df.withColumns({"_turn": turn, "bin": cut(F.col(speed), edges)}).where("bin is not null and _turn is not null")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_turn").alias("mean_turn"))


def wind_rose(df: DataFrame, speed: str, direction: str, group: dict[str, Column], calm: float = 0.5, sectors: int = 16) -> DataFrame:
    """(group, sector, n, share_pct, is_peak) of winds of at least `calm`; sector 0 is centred on north."""
    width = 360.0 / sectors
    sector = F.floor(F.pmod(F.col(direction) + width / 2, F.lit(360.0)) / width).cast("int")
    rows = df.where(F.col(speed) >= calm).withColumns({**group, "sector": sector}).where("sector is not null")
    counts = rows.groupBy(*group, "sector").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*group)
    first = F.row_number().over(w.orderBy(F.desc("n"), "sector"))
    return counts.withColumns({"share_pct": F.col("n") * 100 / F.sum("n").over(w), "is_peak": first == 1})


def density(df: DataFrame, x: str, y: str, width: float, height: float) -> DataFrame:
    cell = lambda c, s: F.floor(F.col(c) / s).cast("int")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(cell(x, width).alias("cell_x"), cell(y, height).alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, column: str, group: dict[str, Column], reach: float = 1.5) -> DataFrame:
    """(group, q1, median, q3, whisker_low, whisker_high, fliers)."""
    rows = df.withColumns(group)
    q = group_quantiles(rows, [*group], F.col(column), (0.25, 0.5, 0.75)).drop("n")
    joined = join_on(rows, q, [*group])
    span = F.col("q")[2] - F.col("q")[0]
    inside = F.col(column).between(F.col("q")[0] - reach * span, F.col("q")[2] + reach * span)
    out = joined.groupBy(*group).agg(F.first("q").alias("q"), F.min(F.when(inside, F.col(column))).alias("whisker_low"), F.max(F.when(inside, F.col(column))).alias("whisker_high"), F.count_if(~inside).alias("fliers"))
    return out.select(*group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "whisker_low", "whisker_high", "fliers")


def global_outliers(df: DataFrame, columns: list[str], cold: Column, reach: float = 1.5) -> DataFrame:
    """(variable, outside, cold_share_pct): values beyond the whole table's fences, and how many of them fall in the cold season."""
    fences = exact_quantiles(df, columns, (0.25, 0.75))
    long = df.select(cold.alias("_cold"), F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])))
    low, high = F.col("q")[0], F.col("q")[1]
    out = ~F.col("value").between(low - reach * (high - low), high + reach * (high - low))
    # One row of fences for each variable.
    judged = long.join(F.broadcast(fences), "variable").select("variable", "_cold", out.alias("_out"))
    share = F.count_if(F.col("_out") & F.col("_cold")) * 100 / F.nullif(F.count_if("_out"), F.lit(0))
    return judged.groupBy("variable").agg(F.count_if("_out").alias("outside"), share.alias("cold_share_pct"))


def compare_versions(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(variable, changed, missing_a, missing_b) over the keys both versions have."""
    both = join_on(a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns]), b.select(*keys, *columns), keys)
    aggs = []
    for c in columns:
        x, y = F.col(f"_a_{c}"), F.col(c)
        same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        aggs.append(F.struct(F.lit(c).alias("variable"), F.count_if(~same).alias("changed"), F.count_if(x.isNull()).alias("missing_a"), F.count_if(y.isNull()).alias("missing_b")))
    return both.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def horizon_difficulty(df: DataFrame, column: str, horizons: tuple, keys: list[str], ts: str = "ts") -> DataFrame:
    """(horizon, r, mean_abs_change): how much harder each horizon is than the one before."""
    w = by_time(keys, ts)
    ahead = df.select(F.col(column).alias("x"), *[F.lead(column, h).over(w).alias(f"y{h}") for h in horizons])
    aggs = [F.struct(F.lit(h).alias("horizon"), correlation("x", f"y{h}").alias("r"), F.avg(F.abs(F.col(f"y{h}") - F.col("x"))).alias("mean_abs_change")) for h in horizons]
    return ahead.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def daily_mode(df: DataFrame, column: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """The most frequent value of each day, the smallest of equals."""
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.mode(column, True).alias("mode"))


def cold_share(flags: DataFrame, prefix: str, cold: Column) -> DataFrame:
    """(variable, flags, cold_share_pct): the flags of rules whose name starts so, and how many of them fall in the cold season."""
    some = flags.where(F.col("rule").startswith(prefix))
    return some.groupBy("variable").agg(F.count(F.lit(1)).alias("flags"), (F.count_if(cold) * 100 / F.count(F.lit(1))).alias("cold_share_pct"))
