"""From untyped text to typed rows: strict times, numbers, physical bounds, duplicates and conflicts, and their audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF](inity)?)$"
OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})$"
#: Markers of missing cells.
FILL_VALUES = (-999.0, -99.0)


@dataclass(frozen=True)
class Variable:
    """A measured variable: its inclusive physical bounds and how it is filled."""

    name: str
    low: float
    high: float
    kind: str = "linear"


#: The physical bounds of the hourly weather profile.
WEATHER = (
    Variable("T2M", -10.0, 50.0),
    Variable("PRECTOTCORR", 0.0, 200.0),
    Variable("RH2M", 0.0, 100.0),
    Variable("PS", 90.0, 110.0),
    Variable("WS2M", 0.0, 75.0),
    Variable("WD2M", 0.0, 360.0, "circular"),
    Variable("ALLSKY_SFC_SW_DWN", 0.0, 1400.0),
)

#: The audit profile, which refuses only what is physically impossible; zero pressure is refused too.
ABOVE_ZERO, NO_LIMIT = 5e-324, float("inf")
AUDIT = (
    Variable("T2M", -273.15, NO_LIMIT),
    Variable("PRECTOTCORR", 0.0, NO_LIMIT),
    Variable("RH2M", 0.0, 100.0),
    Variable("PS", ABOVE_ZERO, NO_LIMIT),
    Variable("WS2M", 0.0, NO_LIMIT),
    Variable("WD2M", 0.0, 360.0, "circular"),
    Variable("ALLSKY_SFC_SW_DWN", 0.0, NO_LIMIT),
)
AUDIT_FILLS = (-999.0,)


def require(df: DataFrame, columns: list[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def to_number(text: Column) -> Column:
    """A double, or null for what is not a plain decimal number; suffixed literals such as 1d are not."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf"))


def mask_invalid(x: Column, low: float, high: float, fills: tuple = FILL_VALUES) -> Column:
    """Null where x is not finite, a marker of missing cells, or out of its bounds."""
    return F.when(is_finite(x) & ~x.isin(*fills) & x.between(low, high), x)


def fold_north(direction: Column) -> Column:
    """360 degrees is 0."""
    return F.when(direction == 360, 0.0).otherwise(direction)


def parse_time(text: Column) -> Column:
    """An instant from ISO 8601 with an offset, extended or basic, or null."""
    ok = text.rlike(OFFSET)
    basic = [F.try_to_timestamp(text, F.lit(p)) for p in ("yyyyMMdd'T'HHmmssX", "yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd'T'HH:mm:ssxx")]
    return F.when(ok, F.coalesce(text.try_cast("timestamp"), *basic))


def time_faults(text: Column) -> dict[str, Column]:
    """Counts of what strict parsing refuses: no offset, unparseable, not on an hour."""
    parsed = parse_time(text)
    bare = F.coalesce(~text.rlike(OFFSET), F.lit(True))
    return {
        "without_offset": F.count_if(bare),
        "unparseable": F.count_if(~bare & parsed.isNull()),
        "off_hour": F.count_if(F.unix_micros(parsed) % 3_600_000_000 != 0),
    }


def parse_times(df: DataFrame, column: str = "timestamp", zone: str = "Asia/Ho_Chi_Minh", name: str = "ts") -> DataFrame:
    """Replaces a text column by local hours; raises if any row lacks an offset, can't be read or is off the hour."""
    faults = df.agg(*[c.alias(k) for k, c in time_faults(F.col(column)).items()]).first()
    if faults["without_offset"]:
        raise ValueError(f"{faults['without_offset']} times name no offset from UTC")
    if faults["unparseable"]:
        raise ValueError(f"{faults['unparseable']} times are not ISO 8601")
    if faults["off_hour"]:
        raise ValueError(f"{faults['off_hour']} times lie between two hours")
    return df.withColumn(name, to_local(parse_time(F.col(column)), zone)).drop(*([column] if column != name else []))


def to_local(instant: Column, zone: str) -> Column:
    """Wall-clock time in a zone, as TIMESTAMP_NTZ."""
    # Counted from 1970 in UTC: as the session's wall-clock time an instant may be one of two.
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_micros(instant).cast("decimal(20, 0)") / F.lit(1_000_000).cast("decimal(7, 0)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def typed(df: DataFrame, variables: tuple[Variable, ...] = WEATHER, fills: tuple = FILL_VALUES) -> DataFrame:
    """Text columns to masked doubles; circular variables fold 360 to 0."""
    out = {}
    for v in variables:
        x = mask_invalid(to_number(F.col(v.name)), v.low, v.high, fills)
        out[v.name] = fold_north(x) if v.kind == "circular" else x
    return df.withColumns(out)


def audit_text(df: DataFrame, columns: list[str], fills: tuple = FILL_VALUES) -> DataFrame:
    """(variable, blank, unparseable, fill_value, infinity): one pass over text columns, one row for each."""
    aggs = []
    for c in columns:
        x = to_number(F.col(c))
        blank = is_blank(F.col(c))
        aggs.append(F.struct(
            F.lit(c).alias("variable"), F.count_if(blank).alias("blank"), F.count_if(~blank & x.isNull()).alias("unparseable"),
            F.count_if(x.isin(*fills)).alias("fill_value"), F.count_if(x.isin(float("inf"), float("-inf"))).alias("infinity")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def row_audit(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """(rows, exact_duplicate_rows, duplicate_timestamps) of text rows."""
    groups = df.groupBy(*df.columns).count()
    by_row = groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("exact_duplicate_rows"))
    by_time = df.groupBy(ts).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_timestamps"))
    return by_row.crossJoin(by_time)


def column_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, missing, missing_pct, unique) of every column, in one pass."""
    aggs = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count_if(F.col(c).isNull()).alias("missing"),
                 (F.count_if(F.col(c).isNull()) * 100 / F.count(F.lit(1))).alias("missing_pct"), F.count_distinct(F.col(c)).alias("unique"))
        for c, t in df.dtypes
    ]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def drop_exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of those that agree in all the columns, null agreeing with null. Comes after masking, so a marker and a blank agree."""
    return df.dropDuplicates(columns)


def conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows hold, with their number; after drop_exact these rows disagree."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def column_conflicts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column names in conflict) where rows of the same key hold different values, null counting as a value."""
    kinds = {c: F.count_distinct(F.col(c)) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0)) for c in columns}
    counted = df.groupBy(*keys).agg(*[k.alias(f"_{c}") for c, k in kinds.items()])
    names = F.array_compact(F.array(*[F.when(F.col(f"_{c}") > 1, F.lit(c)) for c in columns]))
    return counted.select(*keys, F.array_join(names, "|").alias("columns")).where("columns <> ''")


def refuse_conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    n = conflicts(df, keys).agg(F.sum("rows")).first()[0]
    if n:
        raise ValueError(f"{n} rows contradict another row of their hour")
    return df


def cell_changes(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each cell that differs between two versions with the same keys: (keys, column, before, after)."""
    b = before.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").alias("before"), F.col(c).alias("after")) for c in columns])
    both = b.join(after.select(*keys, *columns), keys).select(*keys, F.inline(cells))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
