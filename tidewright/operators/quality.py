"""Quality flags over long (keys, ts, variable, value) rows, and the events they form. Flags mark values; nothing is deleted.

Each rule returns (keys, ts, variable, value, score, severity, rule). Rules that differ by variable run on unpivoted rows,
so all variables share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .axis import by_time, islands, join_on, scanned, within
from .ranks import cumulated, group_quantiles, largest_group

#: Fixed value: scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


def unpivot(df: DataFrame, keys: list[str], variables: list[str], ts: str = "ts") -> DataFrame:
    """Wide to long: (keys, ts, variable, value)."""
    return df.unpivot([*keys, ts], variables, "variable", "value")


def season_keys(ts: str = "ts") -> dict[str, Column]:
    """The usual season: local month and hour."""
    return {"season_a": F.month(ts), "season_b": F.hour(ts)}


def _flags(df: DataFrame, keys: list[str], ts: str, score: Column, severity: int, rule: Column | str) -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return df.select(*keys, ts, "variable", "value", score.alias("score"), F.lit(severity).alias("severity"), rule.alias("rule"))


def seasonal(long: DataFrame, keys: list[str], season: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    long = long.withColumns(season)
    return long, [*keys, "variable", *season]


def _quantile(df: DataFrame, group: list[str], value: Column, q: float, name: str, most: int | None = None) -> DataFrame:
    """(group, name): one exact quantile of each group."""
    return group_quantiles(df, group, value, (q,), most=most).select(*group, F.col("q")[0].alias(name))


def robust_z(long: DataFrame, keys: list[str], season: dict[str, Column]) -> DataFrame:
    """Adds median, mad and robust_z = |x - median| / (1.4826 mad) within each season; null where mad is 0.

    Statistics are a grouped table joined back, so a season's rows are never held together.
    """
    long, group = seasonal(long, keys, season)
    most = largest_group(long, group)
    with_median = join_on(long, _quantile(long, group, F.col("value"), 0.5, "median", most), group)
    out = join_on(with_median, _quantile(with_median, group, F.abs(F.col("value") - F.col("median")), 0.5, "mad", most), group)
    return out.withColumn("robust_z", F.abs(F.col("value") - F.col("median")) / F.when(F.col("mad") != 0, F.col("mad") * MAD_SCALE))


def flag_robust_z(long: DataFrame, keys: list[str], season: dict[str, Column], limit: float = 5.0, ts: str = "ts") -> DataFrame:
    hit = robust_z(long, keys, season).where(F.col("robust_z") > limit)
    return _flags(hit, keys, ts, F.col("robust_z"), 1, f"seasonal_robust_z>{limit:g}")


def flag_iqr(long: DataFrame, keys: list[str], season: dict[str, Column], ts: str = "ts") -> DataFrame:
    """Outside 1.5 interquartile ranges of its season; the score is the distance beyond in ranges."""
    long, group = seasonal(long, keys, season)
    q = group_quantiles(long, group, F.col("value"), (0.25, 0.75), most=largest_group(long, group)).drop("n")
    rows = join_on(long, q, group).withColumn("iqr", F.col("q")[1] - F.col("q")[0]).where("iqr > 0")
    beyond = F.greatest(F.col("q")[0] - F.col("value"), F.col("value") - F.col("q")[1])
    return _flags(rows.where(beyond > 1.5 * F.col("iqr")), keys, ts, beyond / F.col("iqr"), 1, "seasonal_hour_IQR")


def flag_mad(long: DataFrame, keys: list[str], season: dict[str, Column], limit: float = 3.5, ts: str = "ts") -> DataFrame:
    rows = robust_z(long, keys, season).where("mad > 0")
    score = 0.6745 * F.abs(F.col("value") - F.col("median")) / F.col("mad")
    return _flags(rows.where(score > limit), keys, ts, score, 1, "seasonal_hour_MAD")


def flag_wet(long: DataFrame, keys: list[str], wet: float = 0.1, q: float = 0.999, ts: str = "ts") -> DataFrame:
    """Values above the quantile of the wet ones; the rule's name holds the limit."""
    limits = _quantile(long, [*keys, "variable"], F.when(F.col("value") > wet, F.col("value")), q, "limit")
    hit = join_on(long, limits, [*keys, "variable"]).where("value > limit")
    return _flags(hit, keys, ts, F.col("value") / F.col("limit"), 1, F.format_string(f"wet_hour_q{q * 100:g}>%.2f", "limit"))


def flag_wet_by(long: DataFrame, keys: list[str], by: dict[str, Column], wet: float = 0.1, q: float = 0.995, ts: str = "ts") -> DataFrame:
    """Wet values above the quantile of the wet values of their group."""
    rows = long.where(F.col("value") > wet).withColumns(by)
    limits = _quantile(rows, [*keys, "variable", *by], F.col("value"), q, "limit")
    hit = join_on(rows, limits, [*keys, "variable", *by]).where("value > limit")
    return _flags(hit, keys, ts, F.col("value") / F.col("limit"), 1, "wet_hour_month_q995")


def flag_step(long: DataFrame, keys: list[str], limit: float = 8.0, ts: str = "ts", rule: str | None = None) -> DataFrame:
    """Changes of more than `limit` from the row before."""
    w = by_time([*keys, "variable"], ts)
    step = long.withColumn("step", F.abs(F.col("value") - F.lag("value").over(w)))
    return _flags(step.where(F.col("step") > limit), keys, ts, F.col("step") / limit, 2, rule or f"hourly_jump>{limit:g}C")


def circular_difference(a: Column, b: Column) -> Column:
    """a - b in degrees, in [-180, 180)."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def jumps(long: DataFrame, keys: list[str], season: dict[str, Column], floors: dict[str, float], circular: tuple = (), q: float = 0.995, ts: str = "ts") -> DataFrame:
    """Adds step (signed) and large: |step| above both the season's quantile of |step| and the variable's floor."""
    w = by_time([*keys, "variable"], ts)
    before = F.lag("value").over(w)
    step = F.when(F.col("variable").isin(*circular), circular_difference(F.col("value"), before)).otherwise(F.col("value") - before) if circular else F.col("value") - before
    long, group = seasonal(long.withColumn("step", step), keys, season)
    limit = _quantile(long, group, F.abs("step"), q, "q")
    floor = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("variable")]
    rows = join_on(long, limit, group).withColumn("limit", F.greatest("q", floor))
    return rows.withColumn("large", F.coalesce(F.abs("step") > F.col("limit"), F.lit(False)))


def flag_jump(long: DataFrame, keys: list[str], season: dict[str, Column], floors: dict[str, float], circular: tuple = (), ts: str = "ts") -> DataFrame:
    rows = jumps(long, keys, season, floors, circular, ts=ts)
    return _flags(rows.where("large"), keys, ts, F.abs("step") / F.col("limit"), 2, "large_hourly_jump")


def flag_spike(long: DataFrame, keys: list[str], season: dict[str, Column], floors: dict[str, float], ts: str = "ts") -> DataFrame:
    """A large jump followed by a large jump back."""
    w = by_time([*keys, "variable"], ts)
    rows = jumps(long, keys, season, floors, ts=ts).withColumns({"next_step": F.lead("step").over(w), "next_large": F.lead("large").over(w)})
    return _flags(rows.where(F.col("large") & F.col("next_large") & (F.col("step") * F.col("next_step") < 0)), keys, ts, F.abs("step") / F.col("limit"), 3, "isolated_reversing_spike")


def flag_flat(long: DataFrame, keys: list[str], least: int = 12, ts: str = "ts") -> DataFrame:
    """Stretches of at least `least` equal values; a null ends a stretch."""
    rows = scanned(long, F.col("value"), lambda a, b: a == b, [*keys, "variable"], ts, "_run", "_rows").where("value is not null")
    return _flags(rows.where(F.col("_rows") >= least), keys, ts, F.col("_rows") / least, 2, f"constant_run_ge{least}h")


def flat_runs(long: DataFrame, keys: list[str], least: int = 12, ts: str = "ts") -> DataFrame:
    """(keys, variable, start, end, hours) of the stretches that flag_flat() marks."""
    group = [*keys, "variable"]
    rows = scanned(long, F.col("value"), lambda a, b: a == b, group, ts, "_run").where("value is not null")
    out = rows.groupBy(*group, "_run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("hours"))
    return out.where(F.col("hours") >= least).drop("_run")


def flag_night(long: DataFrame, keys: list[str], limit: float = 5.0, ts: str = "ts") -> DataFrame:
    """Radiation above the limit deep in the night."""
    night = (F.hour(ts) >= 22) | (F.hour(ts) <= 3)
    return _flags(long.where(night & (F.col("value") > limit)), keys, ts, F.col("value") / limit, 3, f"deep_night_radiation_gt{limit:g}")


def level_shifts(long: DataFrame, keys: list[str], season: dict[str, Column], floors: dict[str, float], days: int = 7, least_hours: int = 20, q: float = 0.995, ts: str = "ts") -> DataFrame:
    """(keys, variable, date, level_shift, limit): days whose median residual over the next `days` differs from the `days` before by more than the limit."""
    long, group = seasonal(long, keys, season)
    residual = join_on(long, _quantile(long, group, F.col("value"), 0.5, "median", largest_group(long, group)), group).withColumn("residual", F.col("value") - F.col("median"))
    daily = residual.groupBy(*keys, "variable", F.to_date(ts).alias("date")).agg(F.percentile("residual", F.lit(0.5)).alias("r"), F.count("residual").alias("n"))
    daily = daily.withColumn("r", F.when(F.col("n") >= least_hours, F.col("r")))
    w = W.partitionBy(*keys, "variable").orderBy("date")
    part = lambda a, b: F.when(F.count("r").over(w.rowsBetween(a, b)) == days, F.percentile("r", F.lit(0.5)).over(w.rowsBetween(a, b)))
    shifted = daily.withColumn("level_shift", part(0, days - 1) - part(-days, -1))
    limit = _quantile(shifted, [*keys, "variable"], F.abs("level_shift"), q, "q")
    floor = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("variable")]
    rows = join_on(shifted, limit, [*keys, "variable"]).withColumn("limit", F.greatest("q", floor))
    return rows.where(F.abs("level_shift") > F.col("limit")).select(*keys, "variable", "date", "level_shift", "limit")


def flag_names(flags: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """(keys, ts, outlier_flags): the flagged variables of each hour, distinct, sorted, joined by |."""
    return flags.groupBy(*keys, ts).agg(F.array_join(F.array_sort(F.collect_set("variable")), "|").alias("outlier_flags"))


def attach_flags(df: DataFrame, flags: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return join_on(df, flag_names(flags, keys, ts), [*keys, ts], "left").withColumn("outlier_flags", F.coalesce("outlier_flags", F.lit("none")))


def events(flags: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Groups flags of a variable in adjacent hours: (keys, variable, start, end, hours, severity, score, reasons)."""
    group = [*keys, "variable"]
    cells = flags.groupBy(*group, ts).agg(F.max("severity").alias("severity"), F.max("score").alias("score"), F.collect_set("rule").alias("rules"))
    numbered = islands(cells, group, ts)
    out = numbered.groupBy(*group, "island").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("hours"), F.max("severity").alias("severity"), F.max("score").alias("score"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))), "|").alias("reasons"))
    return out.drop("island")


def ranked_events(found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds event_id, E00001 on, by severity and score downwards, then variable, start and keys; numbered by ranges, not in one task."""
    placed = cumulated(found, [F.desc("severity"), F.desc("score"), "variable", "start", *keys], F.lit(1), "_before")
    return placed.withColumn("event_id", F.format_string("E%05d", F.col("_before") + 1)).drop("_before")


def review_pick(ranked: DataFrame, top: int = 3) -> DataFrame:
    """The top events overall and the top ones of severity 1, each once, with empty fields for a reviewer."""
    # As a string E100000 would come before E10001.
    rank = F.expr("cast(substr(event_id, 2) as bigint)")
    first = ranked.orderBy(rank).limit(top)
    mild = ranked.where("severity = 1").orderBy(rank).limit(top)
    picked = first.unionByName(mild).dropDuplicates(["event_id"])
    return picked.withColumns({"decision": F.lit("pending"), "evidence": F.lit(""), "reviewer": F.lit("")})


def flags_within(flags: DataFrame, found: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The flags that lie within an event of their variable, with its event_id."""
    return within(flags, found.select(*keys, "variable", "start", "end", "event_id"), [*keys, "variable"], ts).drop("start", "end")
