"""Filling short gaps of a dense hourly axis: linear, circular and causal, with a record of what was filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .axis import PIECE, by_time, chunked, hours_between


def _neighbours(column: Column, keys: list[str], ts: str, most: int) -> tuple[Column, Column]:
    """The last observed (value, time) before a row of a dense axis and the first after it, where the gap between can be of at most `most` hours."""
    w = by_time(keys, ts)
    seen = F.when(column.isNotNull(), F.struct(column.alias("v"), F.col(ts).alias("t")))
    return F.last(seen, ignorenulls=True).over(w.rowsBetween(-most, -1)), F.first(seen, ignorenulls=True).over(w.rowsBetween(1, most))


def _between(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def _line(before: str, after: str, share: Column) -> Column:
    return _between(F.col(f"{before}.v"), F.col(f"{after}.v"), share)


def _turn(before: str, after: str, share: Column) -> Column:
    part = lambda f: _between(f(F.radians(F.col(f"{before}.v"))), f(F.radians(F.col(f"{after}.v"))), share)
    return F.pmod(F.degrees(F.atan2(part(F.sin), part(F.cos))), F.lit(360.0))


def fill(df: DataFrame, linear: list[str], circular: list[str], keys: list[str], ts: str = "ts", most: int = 3) -> DataFrame:
    """Fills interior gaps of at most `most` hours of a dense axis; longer gaps and edges stay null. Adds filled_<column>.

    The whole gap counts, inserted hours included. Linear columns are filled in a line over time. Circular ones are angles
    in degrees: sine and cosine are filled each by itself, and the result lies in [0, 360). All columns share one window,
    whose frames reach `most` rows, so a long series goes to several tasks.
    """
    kinds = {**dict.fromkeys(linear, _line), **dict.fromkeys(circular, _turn)}

    def filled(df: DataFrame, keys: list[str]) -> DataFrame:
        sides = {c: _neighbours(F.col(c), keys, ts, most) for c in kinds}
        df = df.withColumns({name: side for c, both in sides.items() for name, side in zip((f"_b_{c}", f"_a_{c}"), both, strict=True)})
        done = {}
        for c, between in kinds.items():
            span = hours_between(F.col(f"_a_{c}.t"), F.col(f"_b_{c}.t"))
            fits = F.coalesce(F.col(c).isNull() & (span - 1 <= most), F.lit(False))
            share = hours_between(F.col(ts), F.col(f"_b_{c}.t")) / span
            done[f"filled_{c}"], done[c] = fits, F.when(fits, between(f"_b_{c}", f"_a_{c}", share)).otherwise(F.col(c))
        return df.withColumns(done).drop(*[f"_{side}_{c}" for c in kinds for side in "ba"])

    return chunked(df, filled, keys, most, most, ts=ts)


def interpolate(df: DataFrame, columns: list[str], keys: list[str], ts: str = "ts", most: int = 3) -> DataFrame:
    return fill(df, columns, [], keys, ts, most)


def interpolate_direction(df: DataFrame, column: str, keys: list[str], ts: str = "ts", most: int = 3) -> DataFrame:
    return fill(df, [], [column], keys, ts, most)


def carry_forward(df: DataFrame, columns: list[str], keys: list[str], ts: str = "ts", most: int = 2, hours: int = PIECE) -> DataFrame:
    """Fills gaps of at most `most` hours of a dense axis with the last value before them. Adds filled_<column>.

    The whole gap counts, up to the end of the series. A gap that is filled has its last value and its end within `most`
    rows, so frames reach no further, all columns share one window and a long series goes to several tasks.
    """

    def carried(df: DataFrame, keys: list[str]) -> DataFrame:
        rows_after = F.count(F.lit(1)).over(by_time(keys, ts).rowsBetween(1, most))
        df = df.withColumns({"_after": rows_after, **{n: side for c in columns for n, side in zip((f"_b_{c}", f"_a_{c}"), _neighbours(F.col(c), keys, ts, most), strict=True)}})
        done = {}
        for c in columns:
            gone, left = hours_between(F.col(ts), F.col(f"_b_{c}.t")), hours_between(F.col(f"_a_{c}.t"), F.col(ts)) - 1
            # Without a value ahead the gap ends with the series, if that ends within reach.
            left = F.coalesce(left, F.when(F.col("_after") < most, F.col("_after")))
            fits = F.coalesce(F.col(c).isNull() & (gone + left <= most), F.lit(False))
            done[f"filled_{c}"], done[c] = fits, F.when(fits, F.col(f"_b_{c}.v")).otherwise(F.col(c))
        return df.withColumns(done).drop("_after", *[f"_{side}_{c}" for c in columns for side in "ba"])

    return chunked(df, carried, keys, most, most, hours, ts)


def joined_names(flags: dict[str, Column], empty: str = "none") -> Column:
    """The names whose flags hold, in their order, joined by |."""
    names = F.array_join(F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()])), "|")
    return F.when(names == "", empty).otherwise(names)


def provenance(df: DataFrame, columns: list[str]) -> DataFrame:
    """is_imputed and imputed_columns from the filled_ flags."""
    flags = {c: F.col(f"filled_{c}") for c in columns}
    names = joined_names(flags)
    return df.withColumns({"is_imputed": F.when(names == "none", 0).otherwise(1), "imputed_columns": names})
