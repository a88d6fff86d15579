"""Leakage-free features, targets, splits, scaling and sequence windows of a dense hourly series.

A feature at t uses rows up to t. All frames of one kind share a window, so a series is sorted once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import cyclic, dewpoint, wind_uv
from .axis import PIECE, by_time, chunked, hour_number, hours_between

#: The steps, horizons and window of the forecast, and (in feature_names) its columns' names.
LAGS = (1, 2, 3, 6, 12, 24)
HORIZONS = (1, 6, 12, 24)
SEQUENCE_LENGTH = 48


def lags(column: str, steps: tuple, w) -> dict[str, Column]:
    return {f"{column}_lag_{k}h": F.lag(column, k).over(w) for k in steps}


def leads(column: str, steps: tuple, w) -> dict[str, Column]:
    return {f"{column}_t+{h}h": F.lead(column, h).over(w) for h in steps}


def rolling(column: str, n: int, w, fn) -> Column:
    """fn over the n rows that end here; null unless all of them have a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(frame) == n, fn(column).over(frame))


def centred(column: str, n: int, w, fn=F.avg) -> Column:
    """As rolling(), centred; of an even width, one row more lies before."""
    frame = w.rowsBetween(-(n // 2), n - n // 2 - 1)
    return F.when(F.count(column).over(frame) == n, fn(column).over(frame))


def change(column: str, k: int, w) -> Column:
    return F.col(column) - F.lag(column, k).over(w)


def add_features(df: DataFrame, keys: list[str], ts: str = "ts", names: dict[str, str] | None = None) -> DataFrame:
    """The 26 features and 4 targets of the temperature forecast; `names` maps the variables to df's columns."""
    n = {v: v for v in ("T2M", "PRECTOTCORR", "RH2M", "PS", "WS2M", "WD2M", "ALLSKY_SFC_SW_DWN")} | (names or {})
    t, rain, ps, rad = n["T2M"], n["PRECTOTCORR"], n["PS"], n["ALLSKY_SFC_SW_DWN"]
    w = by_time(keys, ts)
    u, v = wind_uv(F.col(n["WS2M"]), F.col(n["WD2M"]))
    now = {"DEWPOINT": dewpoint(F.col(t), F.col(n["RH2M"])), "WIND_U": u, "WIND_V": v, f"{rain}_log1p": F.log1p(rain), **cyclic(ts)}
    past = {
        **lags(t, LAGS, w), f"{t}_roll_mean_24h": rolling(t, 24, w, F.avg), f"{t}_roll_min_24h": rolling(t, 24, w, F.min), f"{t}_roll_max_24h": rolling(t, 24, w, F.max),
        f"{ps}_diff_3h": change(ps, 3, w), f"{ps}_diff_24h": change(ps, 24, w),
        f"{rain}_sum_24h_log1p": F.log1p(rolling(rain, 24, w, F.sum)), f"{rad}_sum_24h": rolling(rad, 24, w, F.sum),
    }
    return df.withColumns({**now, **past, **leads(t, HORIZONS, w)})


def feature_names(names: dict[str, str] | None = None) -> dict[str, list[str]]:
    """sequence, tabular, targets, unscaled and scaled columns."""
    n = {v: v for v in ("T2M", "PRECTOTCORR", "RH2M", "PS", "WS2M", "WD2M", "ALLSKY_SFC_SW_DWN")} | (names or {})
    t, rain, ps, rad = n["T2M"], n["PRECTOTCORR"], n["PS"], n["ALLSKY_SFC_SW_DWN"]
    unscaled = ["hour_sin", "hour_cos", "doy_sin", "doy_cos"]
    sequence = [t, n["RH2M"], "DEWPOINT", ps, n["WS2M"], "WIND_U", "WIND_V", f"{rain}_log1p", rad, *unscaled]
    history = [*(f"{t}_lag_{k}h" for k in LAGS), f"{t}_roll_mean_24h", f"{t}_roll_min_24h", f"{t}_roll_max_24h", f"{ps}_diff_3h", f"{ps}_diff_24h", f"{rain}_sum_24h_log1p", f"{rad}_sum_24h"]
    tabular = [*sequence, *history]
    return {"sequence": sequence, "tabular": tabular, "targets": [f"{t}_t+{h}h" for h in HORIZONS], "unscaled": unscaled, "scaled": [c for c in tabular if c not in unscaled]}


def quality_bad(raw: list[str]) -> Column:
    """An hour that was inserted, filled, or lacks a raw value."""
    return (F.col("is_inserted_hour") == 1) | (F.col("is_imputed") == 1) | ~complete(raw)


def complete(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"`{c}`").isNotNull()
    return out


def bad_windows(df: DataFrame, bad: Column, keys: list[str], ts: str = "ts", back: int = SEQUENCE_LENGTH, ahead: int = max(HORIZONS)) -> DataFrame:
    """bad_past: a bad row among the last `back` (or fewer exist); bad_future: one among the next `ahead` (or none exists)."""
    w = by_time(keys, ts)
    df = df.withColumn("_bad", bad.cast("int"))
    past = F.when(F.count(F.lit(1)).over(w.rowsBetween(-(back - 1), 0)) < back, 1).otherwise(F.max("_bad").over(w.rowsBetween(-(back - 1), 0)))
    future = F.coalesce(F.max("_bad").over(w.rowsBetween(1, ahead)), F.lit(1))
    return df.withColumns({"bad_past": past, "bad_future": future}).drop("_bad")


def assign_split(df: DataFrame, bad: Column, needed: list[str], splits: dict[str, tuple[str, str]], keys: list[str], ts: str = "ts", ahead: int = max(HORIZONS)) -> DataFrame:
    """Adds split: a usable row whose last target still lies in its period; else none."""
    df = bad_windows(df, bad, keys, ts, ahead=ahead)
    usable = complete(needed) & (F.col("bad_past") == 0) & (F.col("bad_future") == 0)
    label = F.lit(None).cast("string")
    for name, (start, end) in splits.items():
        inside = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) + F.expr(f"interval {ahead} hours") <= F.lit(end).cast("timestamp_ntz"))
        label = F.when(usable & inside, name).otherwise(label)
    return df.withColumn("split", F.coalesce(label, F.lit("none"))).drop("bad_past", "bad_future")


def labelled_features(df: DataFrame, bad: Column, splits: dict[str, tuple[str, str]], keys: list[str], ts: str = "ts", names: dict[str, str] | None = None) -> DataFrame:
    """add_features() and assign_split() in one pass. Their frames reach 47 rows back and 24 ahead, so a long series goes to several tasks."""
    cols = feature_names(names)
    made = lambda d, k: assign_split(add_features(d, k, ts, names), bad, [*cols["tabular"], *cols["targets"]], splits, k, ts)
    return chunked(df, made, keys, SEQUENCE_LENGTH - 1, max(HORIZONS), ts=ts)


def fit_scaler(df: DataFrame, columns: list[str], target: str, rows: Column) -> DataFrame:
    """One row: mean_<c> and std_<c> (population; 1 where below 1e-9) over the chosen rows, and the target's own, unguarded."""
    train = df.where(rows)
    aggs = []
    for c in columns:
        std = F.stddev_pop(f"`{c}`")
        aggs += [F.avg(f"`{c}`").alias(f"mean_{c}"), F.when(std < 1e-9, 1.0).otherwise(std).alias(f"std_{c}")]
    return train.agg(*aggs, F.avg(f"`{target}`").alias("target_mean"), F.stddev_pop(f"`{target}`").alias("target_std"))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / std for all rows; the scaler is one row, so it is broadcast."""
    joined = df.crossJoin(F.broadcast(scaler))
    scaled = {c: (F.col(f"`{c}`") - F.col(f"`mean_{c}`")) / F.col(f"`std_{c}`") for c in columns}
    return joined.withColumns(scaled).select(*[f"`{c}`" for c in df.columns])


def sequence_windows(df: DataFrame, split: str | None, features: list[str], targets: list[str], keys: list[str], ts: str = "ts", length: int = SEQUENCE_LENGTH, check: bool = True) -> DataFrame:
    """(keys, ts, X, y): for each row of the split the last `length` rows' features, as floats, and its targets.

    Without a split the rows of all of them, with split beside. Raises if the series isn't hourly without breaks or a
    window is short or holds a null.
    """
    row = F.array(*[F.col(f"`{c}`").cast("float") for c in features])
    step = hours_between(F.col(ts), F.lag(ts).over(by_time(keys, ts)))
    breaks = df.select(step.alias("_step")).agg(F.count_if(F.col("_step") != 1)).first()[0] if check else 0
    if breaks:
        raise ValueError("the table must be hourly without breaks")
    slim = df.select(*keys, ts, "split", row.alias("_row"), F.array(*[F.col(f"`{c}`").cast("float") for c in targets]).alias("y"))
    past = lambda d, k: d.withColumn("X", F.collect_list("_row").over(by_time(k, ts).rowsBetween(-(length - 1), 0)))
    built = chunked(slim, past, keys, length - 1, 0, ts=ts)
    built = built.where(F.col("split") == split if split else F.col("split") != "none").drop("_row")
    if check:
        holes = F.exists("X", lambda r: F.exists(r, lambda x: x.isNull())) | F.exists("y", lambda x: x.isNull())
        f = built.agg(F.count_if(F.size("X") < length).alias("short"), F.count_if(holes).alias("holes")).first()
        if f["short"]:
            raise ValueError(f"{f['short']} windows lack {length} hours of history")
        if f["holes"]:
            raise ValueError(f"{f['holes']} windows hold nulls")
    return built.drop("split") if split else built


def window_shards(df: DataFrame, features: list[str], targets: list[str], keys: list[str], ts: str = "ts", length: int = SEQUENCE_LENGTH, hours: int = PIECE, target_scale: tuple[float, float] | None = None) -> DataFrame:
    """(keys, piece, first, halo, x, at, split, y, breaks, short, holes): what windows are cut from, each row's features once.

    A shard is a piece of `hours` hours of a series with the length - 1 rows before it: x holds their features as float32, row by
    row, from hour number `first` on. at lists the rows of x that end a window, those whose split isn't none, split and y their splits
    and float32 targets, as (y - mean) / std where target_scale gives both. breaks, short and holes count steps that aren't
    one hour, windows without all their rows, and windows or targets with a null; check_shards() raises on them.
    """
    series = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("_none"))
    at = hour_number(F.col(ts))
    spots = F.sequence(F.floor(at / hours), F.floor((at + length - 1) / hours))
    cells = [F.array(*[F.col(f"`{c}`").cast("float") for c in names]).alias(n) for n, names in (("x", features), ("y", targets))]
    rows = df.select(series.alias("_series"), at.alias("hour"), "split", *cells, F.explode(spots).alias("piece"))
    mean, std = target_scale or (0.0, 1.0)

    def shard(key, table):
        first_own = key[1].as_py() * hours
        table = table.sort_by("hour")
        hour = table.column("hour").to_numpy()
        own = hour >= first_own
        if not own.any():
            return out_schema.empty_table()
        matrix = lambda name, width: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
        x, y = matrix("x", len(features)), (matrix("y", len(targets)) - mean) / std
        split = table.column("split").to_pylist()
        ends = np.array([i for i in np.flatnonzero(own).tolist() if split[i] != "none"], int)
        hole = np.isnan(x).any(1).cumsum()
        before = np.concatenate([[0], hole])
        full = ends[ends >= length - 1]
        holes = (before[full + 1] - before[full + 1 - length] > 0) | np.isnan(y[full]).any(1)
        values = (key[0].as_py(), key[1].as_py(), int(hour[0]), int((~own).sum()), x.tobytes(), ends.tolist(), [split[i] for i in ends], y[ends].astype(np.float32).tobytes(), int((np.diff(hour) != 1).sum()), len(ends) - len(full), int(holes.sum()))
        return pa.table([pa.array([v], f.type) for v, f in zip(values, out_schema, strict=True)], schema=out_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    more = T._parse_datatype_string("piece long, first long, halo int, x binary, at array<int>, split array<string>, y binary, breaks int, short int, holes int")
    schema = T.StructType([rows.schema["_series"], *more.fields])
    out_schema = to_arrow_schema(schema)
    return rows.groupBy("_series", "piece").applyInArrow(shard, schema).select("_series.*", *more.names).drop("_none")


def check_shards(shards: DataFrame, keys: list[str], length: int = SEQUENCE_LENGTH) -> None:
    """Raises if the series of some shards isn't hourly without breaks, or a window is short or holds a null."""
    # A shard without halo starts a series, of which each has one start.
    starts = shards.groupBy(*keys).agg((F.count_if(F.col("halo") < length - 1) - F.count_if((F.col("halo") < length - 1) & (F.col("halo") > 0))).alias("n"), *[F.sum(c).alias(c) for c in ("breaks", "short", "holes")])
    found = starts.agg((F.coalesce(F.sum("breaks"), F.lit(0)) + F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0))).alias("breaks"), F.sum("short").alias("short"), F.sum("holes").alias("holes")).first()
    if found["breaks"]:
        raise ValueError("the table must be hourly without breaks")
    if found["short"]:
        raise ValueError(f"{found['short']} windows lack {length} hours of history")
    if found["holes"]:
        raise ValueError(f"{found['holes']} windows hold nulls")


def windows_of(x: bytes, at: list[int], width: int, length: int = SEQUENCE_LENGTH) -> np.ndarray:
    """The windows (n, length, width) that end at rows `at` of a shard's x, cut from one sliding view of it, so only the windows asked for are ever copied."""
    rows = np.frombuffer(x, np.float32).reshape(-1, width)
    return np.lib.stride_tricks.sliding_window_view(rows, length, axis=0).transpose(0, 2, 1)[np.asarray(at, int) - length + 1] if len(at) else np.empty((0, length, width), np.float32)


def read_windows(shards: DataFrame, keys: list[str], n_features: int, n_targets: int, split: str | None = None, length: int = SEQUENCE_LENGTH, batch: int = 256) -> DataFrame:
    """(keys, ts, split, X, y): the shards' windows, X row by row as one array of float32, in batches of `batch`."""
    wanted = split

    def cut(batches):
        for shards in batches:
            for i in range(shards.num_rows):
                row = {c: shards.column(c)[i].as_py() for c in ("first", "x", "at", "split", "y")}
                y = np.frombuffer(row["y"], np.float32).reshape(-1, n_targets)
                picked = [k for k, s in enumerate(row["split"]) if wanted in (None, s)]
                for k in range(0, len(picked), batch):
                    some = picked[k : k + batch]
                    at = [row["at"][j] for j in some]
                    flat = windows_of(row["x"], at, n_features, length).reshape(len(some), -1)
                    lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
                    hours = pa.array((row["first"] + np.array(at)) * 3_600_000_000, pa.int64()).cast(pa.timestamp("us"))
                    yield pa.RecordBatch.from_arrays([*[pa.repeat(shards.column(c)[i], len(some)) for c in keys], hours, pa.array([row["split"][j] for j in some]), lists(flat), lists(y[some])], names=[*keys, "ts", "split", "X", "y"])

    schema = T.StructType([*[shards.schema[k] for k in keys], *T._parse_datatype_string("ts timestamp_ntz, split string, X array<float>, y array<float>").fields])
    return shards.select(*keys, "first", "x", "at", "split", "y").mapInArrow(cut, schema)


def split_summary(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_t"), F.max(ts).alias("last_t"))

