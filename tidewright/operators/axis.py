"""The time axis: calendars, densifying, gaps and runs, continuity, and windows over one very long series.

Every operator takes the columns that name a series (`keys`) and its time column; windows are partitioned by them. Times
are TIMESTAMP_NTZ in local time at hour grain.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = "interval 1 hour"
#: Hours of a series that one task's window holds.
PIECE = 4096


def minute_number(ts: Column) -> Column:
    """Minutes of a local time since 1970, whatever the session's zone."""
    return hour_number(ts) * 60 + F.minute(ts)


def by_time(keys: list[str], ts: str = "ts"):
    return W.partitionBy(*keys).orderBy(ts)


def hour_number(ts: Column) -> Column:
    """Hours of a local time since 1970. Spark's own differences of local times go through the session's zone, which may skip or repeat hours."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(ts)


def hour_of(ts: Column) -> Column:
    """The hour a time lies in, as TIMESTAMP_NTZ."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def floor_to(unit: str, ts: Column) -> Column:
    """The start of the hour, day, week, month, quarter or year a time lies in, as TIMESTAMP_NTZ, whatever the session's zone."""
    if unit.upper() == "HOUR":
        return hour_of(ts)
    return (F.to_date(ts) if unit.upper() == "DAY" else F.trunc(F.to_date(ts), unit)).cast("timestamp_ntz")


def hours_between(later: Column, earlier: Column) -> Column:
    """Whole hours from one hour-aligned time to another."""
    return hour_number(later) - hour_number(earlier)


def join_on(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns that both have, null agreeing with null; those columns come once. A series without a key is a series too."""
    other = right.select(*[F.col(f"`{c}`").alias(f"_on_{c}") if c in on else F.col(f"`{c}`") for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_on_{c}`")) for c in on])
    out = left.join(other, same, how)
    if how == "full":
        out = out.withColumns({c: F.coalesce(f"`{c}`", f"`_on_{c}`") for c in on})
    return out.drop(*[f"_on_{c}" for c in on])


def calendar(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Every hour from the first to the last of each series."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return span.select(*keys, F.explode(F.expr(f"sequence(_a, _b, {HOUR})")).alias(ts))


def declared_axis(df: DataFrame, keys: list[str], start: str, end: str, ts: str = "ts") -> DataFrame:
    """Every hour of a declared range for each series of df."""
    span = F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', {HOUR})")
    return df.select(*keys).distinct().select(*keys, F.explode(span).alias(ts))


def densify(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """One row for each hour of the calendar; hours without a row are inserted with nulls and is_inserted_hour = 1."""
    marked = df.withColumn("_seen", F.lit(1))
    out = join_on(calendar(df, keys, ts), marked, [*keys, ts], "left")
    return out.withColumn("is_inserted_hour", F.when(F.col("_seen").isNull(), 1).otherwise(0)).drop("_seen")


def axis_difference(left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The hours of left that right lacks."""
    return join_on(left.select(*keys, ts), right.select(*keys, ts), [*keys, ts], "left_anti")


def scanned(df: DataFrame, state: Column, same: Callable[[Column, Column], Column], keys: list[str], ts: str = "ts", name: str = "run_id", size: str | None = None, hours: int = PIECE) -> DataFrame:
    """Numbers the runs of rows of a series, from 1 in order of time: a row goes on with the run of the row before if same(state before, state) holds.

    A segmented scan. Pieces of `hours` hours number their own runs, tell their first and last run, and those few rows
    of all pieces are scanned in order: a piece's first run may go on with the last one before it. What comes of that, one row a piece,
    is joined back. So no task holds a series, and pieces of any length give the same. size: a column for the rows of the whole run.
    """
    series = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0))
    piece = W.partitionBy("_series", "_piece")
    rows = df.withColumns({"_series": series, "_piece": F.floor(hour_number(F.col(ts)) / hours), "_state": state})
    goes_on = F.coalesce(same(F.lag("_state").over(piece.orderBy(ts)), F.col("_state")), F.lit(False)) & (F.row_number().over(piece.orderBy(ts)) > 1)
    rows = rows.withColumn("_k", F.sum(F.when(goes_on, 0).otherwise(1)).over(piece.orderBy(ts).rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_last", F.max("_k").over(piece))
    edges = rows.where("_k = 1 or _k = _last").groupBy("_series", "_piece", "_k", "_last").agg(F.count(F.lit(1)).alias("n"), F.min_by("_state", ts).alias("a"), F.max_by("_state", ts).alias("b"))
    w = W.partitionBy("_series").orderBy("_piece", "_k")
    joins = (F.col("_k") == 1) & F.coalesce(same(F.lag("b").over(w), F.col("a")), F.lit(False)) & (F.row_number().over(w) > 1)
    edges = edges.withColumn("_joins", joins.cast("int")).withColumn("_run", F.sum(1 - F.col("_joins")).over(w))
    edges = edges.withColumns({"_whole": F.sum("n").over(W.partitionBy("_series", "_run")), "_before": F.sum(F.when(F.col("_k") == 1, F.col("_last") - F.col("_joins")).otherwise(0)).over(w) - F.col("_last")})
    carried = edges.groupBy("_series", "_piece").agg(F.max("_before").alias("_before"), F.max(F.when(F.col("_k") == 1, F.col("_whole"))).alias("_first_n"), F.max(F.when(F.col("_k") == F.col("_last"), F.col("_whole"))).alias("_last_n"))
    if size:
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("_series", "_piece", "_k")))
    rows = rows.join(carried, ["_series", "_piece"]).withColumn(name, F.col("_before") + F.col("_k"))
    if size:
        rows = rows.withColumn(size, F.when(F.col("_k") == 1, F.col("_first_n")).when(F.col("_k") == F.col("_last"), F.col("_last_n")).otherwise(F.col("_n"))).drop("_n")
    return rows.drop("_series", "_piece", "_state", "_k", "_last", "_before", "_first_n", "_last_n")


def _equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def with_run(df: DataFrame, flag: Column, keys: list[str], ts: str = "ts", name: str = "run_id", hours: int = PIECE) -> DataFrame:
    """Numbers the stretches of rows over which flag (never null) stays the same."""
    return scanned(df, flag, _equal, keys, ts, name, hours=hours)


def gap_lengths(df: DataFrame, column: str, keys: list[str], ts: str = "ts", name: str = "gap_length", hours: int = PIECE) -> DataFrame:
    """Length of the stretch of nulls each row of a dense axis is in, 0 where there is a value."""
    found = scanned(df, F.col(column).isNull(), _equal, keys, ts, "_run", "_rows", hours)
    return found.withColumn(name, F.when(F.col(column).isNull(), F.col("_rows")).otherwise(0)).drop("_run", "_rows")


def runs(df: DataFrame, flag: Column, keys: list[str], ts: str = "ts", least: int = 1, hours: int = PIECE) -> DataFrame:
    """(keys, start, end, hours) of the stretches of a dense axis over which flag is true, of at least `least` rows."""
    found = with_run(df.withColumn("_is", F.coalesce(flag, F.lit(False))), F.col("_is"), keys, ts, hours=hours).where("_is")
    out = found.groupBy(*keys, "run_id").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("hours"))
    return out.where(F.col("hours") >= least).drop("run_id")


def islands(df: DataFrame, keys: list[str], ts: str = "ts", name: str = "island", hours: int = PIECE) -> DataFrame:
    """Numbers groups of rows that follow each other by exactly one hour, on an axis that need not be dense."""
    return scanned(df, F.col(ts), lambda a, b: hours_between(b, a) == 1, keys, ts, name, hours=hours)


def continuity(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """(keys, rows, breaks, longest_step): how often a step isn't exactly one hour."""
    step = hours_between(F.col(ts), F.lag(ts).over(by_time(keys, ts)))
    stepped = df.select(*keys, step.alias("_step"))
    return stepped.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_step") != 1).alias("breaks"), F.max("_step").alias("longest_step"))


def audit_axis(df: DataFrame, expected: DataFrame, keys: list[str], order: str, ts: str = "ts") -> DataFrame:
    """(keys, rows, hours, duplicates, missing, unexpected, in_order, start, end) of source rows against an expected axis.

    `order` is the source's row number, as a table has no order of its own; in_order says that times never go back.
    """
    back = F.col(ts) < F.lag(ts).over(W.partitionBy(*keys).orderBy(order))
    rows = df.select(*keys, ts, back.alias("_back")).groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_back").alias("_back"))
    both = join_on(rows, expected.select(*keys, ts).withColumn("_want", F.lit(1)), [*keys, ts], "full")
    seen, n = F.when(F.col("_n").isNotNull(), F.col(ts)), F.coalesce(F.sum("_n"), F.lit(0))
    return both.groupBy(*keys).agg(
        n.alias("rows"), F.count("_n").alias("hours"), (n - F.count("_n")).alias("duplicates"), F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_want").isNull()).alias("unexpected"), (F.coalesce(F.sum("_back"), F.lit(0)) == 0).alias("in_order"), F.min(seen).alias("start"), F.max(seen).alias("end"))


def export_invariants(df: DataFrame, expected: DataFrame, keys: list[str], order: str, ts: str = "ts") -> DataFrame:
    """(keys, unique, in_order, equals_axis): what must hold for rows about to be exported."""
    found = audit_axis(df, expected, keys, order, ts)
    return found.select(*keys, (F.col("duplicates") == 0).alias("unique"), "in_order", ((F.col("missing") == 0) & (F.col("unexpected") == 0)).alias("equals_axis"))


def chunked(df: DataFrame, fn: Callable[[DataFrame, list[str]], DataFrame], keys: list[str], back: int, ahead: int, hours: int = PIECE, ts: str = "ts") -> DataFrame:
    """Applies fn, whose row frames reach at most `back` rows back and `ahead` rows ahead, to pieces of a dense series.

    One long series would otherwise be sorted by a single task. Each piece of `hours` rows carries copies of its
    neighbours' edges; fn gets the keys with the piece's number added, and rows that are copies go afterwards.
    """
    at = hour_number(F.col(ts))
    own = F.floor(at / hours)
    spots = F.sequence(F.floor((at - ahead) / hours), F.floor((at + back) / hours))
    spread = df.withColumn("_own", own).withColumn("_piece", F.explode(spots))
    return fn(spread, [*keys, "_piece"]).where("_own = _piece").drop("_own", "_piece")


def within(points: DataFrame, spans: DataFrame, keys: list[str], ts: str = "ts", start: str = "start", end: str = "end", minutes: int = 1440) -> DataFrame:
    """The columns of both tables for each point and each span of the same keys that holds it, bounds included, null keys agreeing with null.

    A band join by buckets of `minutes`: a span is listed once in each bucket it touches, so a long one is several rows of
    several tasks, a point lies in one bucket, and exact bounds are tested on what an equi-join brings together. Spans may overlap;
    one that ends before it starts, or lacks a bound, holds nothing. Of columns that both have besides the keys, the points' stay.
    """
    bucket = lambda c: F.floor(minute_number(F.col(c)) / minutes)
    named = spans.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"), *[f"`{c}`" for c in spans.columns if c not in {*keys, *points.columns}])
    listed = named.where("_start <= _end").withColumn("_bucket", F.explode(F.sequence(bucket("_start"), bucket("_end"))))
    met = join_on(points.withColumn("_bucket", bucket(ts)), listed, [*keys, "_bucket"])
    return met.where(F.col(ts).between(F.col("_start"), F.col("_end"))).drop("_bucket", "_start", "_end")
