"""Queries by name, bound to the driver's tables, with the SQL that checks them.

The hourly series are made of `events`: one series for each event type and one for all events, their variables from value and props, with gaps
put in at fixed hours. Doubles are rounded to 8 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cyclic, dewpoint, uuid5, wind_uv
from ..operators import analytics, axis, features, forecast, impute, ingest, quality, ranks
from ..sources import payload
from ..sources.shared import new_path, written
from . import pipeline

FLAGSHIP = "rolling_24h"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = ["series"]
VARS = ["t2m", "rain", "rh", "ps", "ws", "wd", "rad"]
NAMES = {"T2M": "t2m", "PRECTOTCORR": "rain", "RH2M": "rh", "PS": "ps", "WS2M": "ws", "WD2M": "wd", "ALLSKY_SFC_SW_DWN": "rad"}
SPLITS = {"train": ("2024-01-01", "2024-01-15 23:00"), "val": ("2024-01-16", "2024-01-22 23:00"), "test": ("2024-01-23", "2024-01-31 23:00")}
NAMESPACE = __import__("uuid").NAMESPACE_URL


def season() -> dict:
    """The seasons of a table of thirty days: its hours."""
    return {"season": F.hour("ts")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours that have events, with the gaps put in."""
    e = table(spark, sf_dir, "events").select(F.explode(F.array("event_type", F.lit("all"))).alias("series"), axis.hour_of(F.col("ts")).alias("ts"), "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    e = e.groupBy("series", "ts").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.sum("k").alias("ks"))
    t2m_gap = ((F.day("ts") == 10) & F.hour("ts").between(5, 10)) | ((F.day("ts") % 7 == 3) & (F.hour("ts") == 4))
    wd_gap = (F.day("ts") % 5 == 0) & (F.hour("ts") == 15)
    return e.select(
        "series", "ts", F.when(~t2m_gap, F.col("hi") / 10).alias("t2m"), (F.greatest(F.col("hi") - 300, F.lit(0.0)) / 10).alias("rain"),
        F.col("k1").cast("double").alias("rh"), (F.col("k0") / 10 + 95).alias("ps"), (F.col("lo") / 20).alias("ws"),
        F.when(~wd_gap, F.col("k0") * 3.6).alias("wd"), F.col("ks").cast("double").alias("rad"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis.densify(observed(spark, sf_dir), KEYS)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hours with short gaps filled."""
    return impute.provenance(impute.fill(dense(spark, sf_dir), [v for v in VARS if v != "wd"], ["wd"], KEYS), VARS)


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.labelled_features(filled(spark, sf_dir), features.quality_bad(VARS), SPLITS, KEYS, names=NAMES)


def r(x: str) -> str:
    return f"(round({x}, 8) + 0.0)"


BASE = """
WITH e AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS ts, max(value) AS hi, min(value) AS lo,
    min(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS k0, max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS k1, sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS ks
  FROM (SELECT event_type, ts, value, props FROM events UNION ALL SELECT 'all', ts, value, props FROM events) GROUP BY 1, 2
), observed AS (
  SELECT series, ts, CASE WHEN (day(ts) = 10 AND hour(ts) BETWEEN 5 AND 10) OR (day(ts) % 7 = 3 AND hour(ts) = 4) THEN NULL ELSE hi / 10 END AS t2m,
    greatest(hi - 300, 0.0::DOUBLE) / 10 AS rain, k1::DOUBLE AS rh, k0::DOUBLE / 10 + 95 AS ps, lo / 20 AS ws,
    CASE WHEN day(ts) % 5 = 0 AND hour(ts) = 15 THEN NULL ELSE k0 * 3.6::DOUBLE END AS wd, ks::DOUBLE AS rad
  FROM e
), cal AS (
  SELECT series, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (SELECT series, min(ts) AS a, max(ts) AS b FROM observed GROUP BY series)
), dense AS (
  SELECT c.series, c.ts, t2m, rain, rh, ps, ws, wd, rad, CASE WHEN o.ts IS NULL THEN 1 ELSE 0 END AS is_inserted_hour FROM cal c LEFT JOIN observed o ON c.series = o.series AND c.ts = o.ts
), long AS (
  SELECT series, ts, hour(ts) AS season, variable, value FROM (SELECT series, ts, t2m, rh, ps, ws, rad FROM dense) UNPIVOT INCLUDE NULLS (value FOR variable IN (t2m, rh, ps, ws, rad))
)
"""


def _fill_sql(c: str) -> str:
    before = "OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = "OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    seen = f"CASE WHEN {c} IS NOT NULL THEN ts END"
    return f"last_value({c} IGNORE NULLS) {before} AS {c}_b, last_value({seen} IGNORE NULLS) {before} AS {c}_bt, first_value({c} IGNORE NULLS) {after} AS {c}_a, first_value({seen} IGNORE NULLS) {after} AS {c}_at"


def _ok(c: str) -> str:
    return f"({c} IS NULL AND {c}_bt IS NOT NULL AND {c}_at IS NOT NULL AND date_diff('hour', {c}_bt, {c}_at) - 1 <= 3)"


def _line(c: str) -> str:
    return f"CASE WHEN {_ok(c)} THEN {c}_b + ({c}_a - {c}_b) * (date_diff('hour', {c}_bt, ts)::DOUBLE / date_diff('hour', {c}_bt, {c}_at)) ELSE {c} END"


_SHARE = "(date_diff('hour', wd_bt, ts)::DOUBLE / date_diff('hour', wd_bt, wd_at))"
_PART = lambda f: f"({f}(radians(wd_b)) + ({f}(radians(wd_a)) - {f}(radians(wd_b))) * {_SHARE})"
_ANGLE = f"degrees(atan2({_PART('sin')}, {_PART('cos')}))"
_TURN = f"CASE WHEN {_ANGLE} < 0 THEN {_ANGLE} + 360 ELSE {_ANGLE} END"
FILLED = BASE + f""", sides AS (SELECT *, {', '.join(map(_fill_sql, VARS))} FROM dense
), filled AS (
  SELECT series, ts, is_inserted_hour, {', '.join(f'{_line(c)} AS {c}' for c in VARS if c != 'wd')}, CASE WHEN {_ok('wd')} THEN {_TURN} ELSE wd END AS wd,
    {', '.join(f'{_ok(c)} AS filled_{c}' for c in VARS)}, CASE WHEN {' OR '.join(map(_ok, VARS))} THEN 1 ELSE 0 END AS is_imputed
  FROM sides
)
"""
_W = "(PARTITION BY series ORDER BY ts)"
_ROLL = lambda f, c, n=24: f"CASE WHEN count({c}) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {f}({c}) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
_FEATURES = {
    "DEWPOINT": "243.04 * (ln((CASE WHEN rh < 1 THEN 1.0 ELSE rh END) / 100) + 17.625 * t2m / (243.04 + t2m)) / (17.625 - (ln((CASE WHEN rh < 1 THEN 1.0 ELSE rh END) / 100) + 17.625 * t2m / (243.04 + t2m)))",
    "WIND_U": "-ws * sin(radians(wd))", "WIND_V": "-ws * cos(radians(wd))", "rain_log1p": "ln(1 + rain)",
    "hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
    "doy_sin": "sin(2 * pi() * (dayofyear(ts) - 1 + hour(ts) / 24.0::DOUBLE) / 365.25)", "doy_cos": "cos(2 * pi() * (dayofyear(ts) - 1 + hour(ts) / 24.0::DOUBLE) / 365.25)",
    **{f"t2m_lag_{k}h": f"lag(t2m, {k}) OVER {_W}" for k in features.LAGS},
    "t2m_roll_mean_24h": _ROLL("avg", "t2m"), "t2m_roll_min_24h": _ROLL("min", "t2m"), "t2m_roll_max_24h": _ROLL("max", "t2m"),
    "ps_diff_3h": f"ps - lag(ps, 3) OVER {_W}", "ps_diff_24h": f"ps - lag(ps, 24) OVER {_W}", "rain_sum_24h_log1p": f"ln(1 + {_ROLL('sum', 'rain')})", "rad_sum_24h": _ROLL("sum", "rad"),
    **{f"t2m_t+{h}h": f"lead(t2m, {h}) OVER {_W}" for h in features.HORIZONS},
}
FEATURED = FILLED + f""", featured AS (
  SELECT series, ts, t2m, rain, rh, ps, ws, wd, rad, is_inserted_hour, is_imputed, {', '.join(f'{x} AS "{n}"' for n, x in _FEATURES.items())} FROM filled
), judged AS (
  SELECT *, CASE WHEN is_inserted_hour = 1 OR is_imputed = 1 OR {' OR '.join(f'{v} IS NULL' for v in VARS)} THEN 1 ELSE 0 END AS bad FROM featured
), spans AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) < 48 THEN 1 ELSE max(bad) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) END AS bad_past,
    coalesce(max(bad) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING), 1) AS bad_future FROM judged
), parted AS (
  SELECT *, CASE WHEN bad_past = 0 AND bad_future = 0 AND {' AND '.join(f'"{n}" IS NOT NULL' for n in ['t2m', 'rh', 'ps', 'ws', 'rad', *_FEATURES])} THEN CASE
    {' '.join(f"WHEN ts >= TIMESTAMP '{a}' AND ts + INTERVAL 24 HOUR <= TIMESTAMP '{b}' THEN '{n}'" for n, (a, b) in SPLITS.items())} ELSE 'none' END ELSE 'none' END AS split FROM spans
)
"""


def add(name: str, sql: str | None = None, base: str = BASE):
    """Registers a query, rounding its doubles; sql follows base's tables."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.withColumns({f.name: F.round(F.col(f"`{f.name}`"), 8) + 0.0 for f in out.schema.fields if f.dataType.typeName() == "double"} or {out.columns[0]: F.col(f"`{out.columns[0]}`")})

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = base + sql
        return fn

    return register


# The time axis.
add("densify_hours", "SELECT series, ts, is_inserted_hour, " + r("t2m") + " AS t2m FROM dense")(lambda s, d: dense(s, d).select("series", "ts", "is_inserted_hour", "t2m"))
add("missing_hours", "SELECT series, ts FROM dense WHERE is_inserted_hour = 1")(lambda s, d: axis.axis_difference(axis.calendar(observed(s, d), KEYS), observed(s, d), KEYS))
add("expected_axis_diff", "SELECT s.series, t.ts FROM (SELECT DISTINCT series FROM observed) s, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00', INTERVAL 1 HOUR)) AS ts) t WHERE NOT EXISTS (SELECT 1 FROM observed o WHERE o.series = s.series AND o.ts = t.ts)")(
    lambda s, d: axis.axis_difference(axis.declared_axis(observed(s, d), KEYS, "2024-01-01 00:00:00", "2024-01-30 23:00:00"), observed(s, d), KEYS))
add("gap_lengths", """, marked AS (SELECT *, CASE WHEN (t2m IS NULL) IS DISTINCT FROM (lag(t2m) OVER w IS NULL) OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM dense WINDOW w AS (PARTITION BY series ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY ts) AS run FROM marked)
SELECT series, ts, CASE WHEN t2m IS NULL THEN count(*) OVER (PARTITION BY series, run) ELSE 0 END AS gap_length FROM numbered""")(lambda s, d: axis.gap_lengths(dense(s, d), "t2m", KEYS).select("series", "ts", "gap_length"))
_RUNS = """, hit AS (SELECT series, ts, ts - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY series ORDER BY ts) AS grp FROM dense WHERE t2m IS NULL)
SELECT series, min(ts) AS start, max(ts) AS "end", count(*) AS hours FROM hit GROUP BY series, grp"""
add("runs", _RUNS)(lambda s, d: axis.runs(dense(s, d), F.col("t2m").isNull(), KEYS))
add("runs_in_pieces", _RUNS)(lambda s, d: axis.runs(dense(s, d), F.col("t2m").isNull(), KEYS, hours=100))
add("topk_gaps", _RUNS + " ORDER BY hours DESC, series, start LIMIT 20")(lambda s, d: axis.runs(dense(s, d), F.col("t2m").isNull(), KEYS).orderBy(F.desc("hours"), "series", "start").limit(20))
add("continuity_check", """, st AS (SELECT series, date_diff('hour', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts) AS step FROM observed)
SELECT series, count(*) AS rows, count(*) FILTER (WHERE step <> 1) AS breaks, max(step) AS longest_step FROM st GROUP BY series""")(lambda s, d: axis.continuity(observed(s, d), KEYS))
add("hours_except", "SELECT ts FROM observed WHERE series = (SELECT min(series) FROM observed) EXCEPT SELECT ts FROM observed WHERE series = (SELECT max(series) FROM observed)")(lambda s, d: _two(s, d, "exceptAll"))
add("hours_intersect", "SELECT ts FROM observed WHERE series = (SELECT min(series) FROM observed) INTERSECT SELECT ts FROM observed WHERE series = (SELECT max(series) FROM observed)")(lambda s, d: _two(s, d, "intersect"))


def _two(spark, sf_dir, how):
    o = observed(spark, sf_dir)
    ends = o.agg(F.min("series").alias("a"), F.max("series").alias("b"))
    one = lambda c: o.join(F.broadcast(ends.select(F.col(c).alias("series"))), "series", "left_semi").select("ts").distinct()
    return getattr(one("a"), how)(one("b"))


# Filling.
add("interpolate_short_gaps", f"SELECT series, ts, {r('t2m')} AS t2m, filled_t2m FROM filled", FILLED)(lambda s, d: impute.interpolate(dense(s, d), ["t2m"], KEYS).select("series", "ts", "t2m", "filled_t2m"))
add("interpolate_wind", f"SELECT series, ts, {r('sin(radians(wd))')} AS wd_sin, {r('cos(radians(wd))')} AS wd_cos, filled_wd FROM filled", FILLED)(
    lambda s, d: impute.interpolate_direction(dense(s, d), "wd", KEYS).select("series", "ts", F.sin(F.radians("wd")).alias("wd_sin"), F.cos(F.radians("wd")).alias("wd_cos"), "filled_wd"))
add("ffill_causal", f""", marked AS (SELECT *, CASE WHEN (t2m IS NULL) IS DISTINCT FROM (lag(t2m) OVER w IS NULL) OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM dense WINDOW w AS (PARTITION BY series ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY ts) AS run, last_value(t2m IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM marked),
sized AS (SELECT *, count(*) OVER (PARTITION BY series, run) AS n FROM numbered)
SELECT series, ts, {r('CASE WHEN t2m IS NULL AND n <= 2 THEN prev ELSE t2m END')} AS t2m FROM sized""")(lambda s, d: impute.carry_forward(dense(s, d), ["t2m"], KEYS).select("series", "ts", "t2m"))
add("impute_provenance", f"SELECT series, ts, is_inserted_hour, is_imputed, CASE WHEN is_imputed = 1 THEN concat_ws('|', {', '.join(f'CASE WHEN filled_{v} THEN {chr(39)}{v}{chr(39)} END' for v in VARS)}) ELSE 'none' END AS imputed_columns FROM filled", FILLED)(
    lambda s, d: filled(s, d).select("series", "ts", "is_inserted_hour", "is_imputed", "imputed_columns"))

# Features.
add("rolling_24h", f"SELECT series, ts, {', '.join(f'{r(_FEATURES[c])} AS {c}' for c in ('t2m_roll_mean_24h', 't2m_roll_min_24h', 't2m_roll_max_24h', 'rad_sum_24h'))} FROM filled", FILLED)(lambda s, d: _rolling(s, d))


def _rolling(spark, sf_dir):
    w = axis.by_time(KEYS)
    roll = lambda c, f: features.rolling(c, 24, w, f)
    return filled(spark, sf_dir).select("series", "ts", roll("t2m", F.avg).alias("t2m_roll_mean_24h"), roll("t2m", F.min).alias("t2m_roll_min_24h"), roll("t2m", F.max).alias("t2m_roll_max_24h"), roll("rad", F.sum).alias("rad_sum_24h"))


def _windowed(build):
    return lambda s, d: dense(s, d).select("series", "ts", *[c.alias(n) for n, c in build(axis.by_time(KEYS)).items()])


_FROM_DENSE = lambda cols: "SELECT series, ts, " + ", ".join(f'{r(x)} AS "{n}"' for n, x in cols.items()) + " FROM dense"
add("lag_features", _FROM_DENSE({k: v for k, v in _FEATURES.items() if "_lag_" in k}))(_windowed(lambda w: features.lags("t2m", features.LAGS, w)))
add("lead_targets", _FROM_DENSE({k: v for k, v in _FEATURES.items() if "_t+" in k}))(_windowed(lambda w: features.leads("t2m", features.HORIZONS, w)))
add("diff_features", _FROM_DENSE({k: v for k, v in _FEATURES.items() if "_diff_" in k}))(_windowed(lambda w: {f"ps_diff_{k}h": features.change("ps", k, w) for k in (3, 24)}))
_CIRC = "(wd - lag(wd) OVER (PARTITION BY series ORDER BY ts) + 180)"
add("circular_diff", _FROM_DENSE({"turn": f"({_CIRC} - 360 * floor({_CIRC} / 360)) % 360 - 180"}))(_windowed(lambda w: {"turn": quality.circular_difference(F.col("wd"), F.lag("wd").over(w))}))
add("centered_12", _FROM_DENSE({"t2m_mean": "CASE WHEN count(t2m) OVER c = 12 THEN avg(t2m) OVER c END"}) + " WINDOW c AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)")(_windowed(lambda w: {"t2m_mean": features.centred("t2m", 12, w)}))
add("dewpoint", _FROM_DENSE({"dewpoint": _FEATURES["DEWPOINT"]}))(_windowed(lambda w: {"dewpoint": dewpoint(F.col("t2m"), F.col("rh"))}))
add("wind_uv", _FROM_DENSE({"u": _FEATURES["WIND_U"], "v": _FEATURES["WIND_V"]}))(_windowed(lambda w: dict(zip("uv", wind_uv(F.col("ws"), F.col("wd")), strict=True))))
add("cyclic_time", _FROM_DENSE({k: _FEATURES[k] for k in ("hour_sin", "hour_cos", "doy_sin", "doy_cos")}))(_windowed(lambda w: cyclic("ts")))
add("add_features", "SELECT series, ts, " + ", ".join(f'{r(chr(34) + n + chr(34))} AS "{n}"' for n in _FEATURES) + " FROM featured", FEATURED)(
    lambda s, d: features.add_features(filled(s, d), KEYS, names=NAMES).select("series", "ts", *[f"`{n}`" for n in _FEATURES]))
add("quality_windows", "SELECT series, ts, bad_past, bad_future FROM spans", FEATURED)(lambda s, d: features.bad_windows(filled(s, d), features.quality_bad(VARS), KEYS).select("series", "ts", "bad_past", "bad_future"))
add("assign_split", "SELECT series, ts, split FROM parted", FEATURED)(lambda s, d: split_rows(s, d).select("series", "ts", "split"))
add("split_summary", "SELECT split, count(*) AS rows, min(ts) AS first_t, max(ts) AS last_t FROM parted GROUP BY split", FEATURED)(lambda s, d: features.split_summary(split_rows(s, d)))
_SCALED = ["t2m", "rh", "DEWPOINT", "ps_diff_24h", "t2m_roll_mean_24h"]


def _scaler(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    return rows, features.fit_scaler(rows, _SCALED, "t2m", F.col("split") == "train")


_STD = lambda c: f'CASE WHEN stddev_pop("{c}") < 1e-9 THEN 1.0 ELSE stddev_pop("{c}") END'
_FIT = ", ".join(f"avg(\"{c}\") AS \"mean_{c}\", {_STD(c)} AS \"std_{c}\"" for c in _SCALED)
add("scaler_fit", "SELECT " + ", ".join(f"{r(f'avg({chr(34)}{c}{chr(34)})')} AS \"mean_{c}\", {r(_STD(c))} AS \"std_{c}\"" for c in _SCALED) + f", {r('avg(t2m)')} AS target_mean, {r('stddev_pop(t2m)')} AS target_std FROM parted WHERE split = 'train'", FEATURED)(lambda s, d: _scaler(s, d)[1])
add("scaled_features", f", fit AS (SELECT {_FIT} FROM parted WHERE split = 'train') SELECT series, ts, " + ", ".join(f"{r(f'({chr(34)}{c}{chr(34)} - {chr(34)}mean_{c}{chr(34)}) / {chr(34)}std_{c}{chr(34)}')} AS \"{c}\"" for c in _SCALED) + " FROM parted, fit", FEATURED)(
    lambda s, d: features.apply_scaler(*_scaler(s, d), _SCALED).select("series", "ts", *_SCALED))
_ALL_SCALED = features.feature_names(NAMES)["scaled"]


def _train_scaler(spark, sf_dir):
    """The rows and the scaler of all scaled columns, fitted on train rows."""
    rows = split_rows(spark, sf_dir)
    return rows, features.fit_scaler(rows, _ALL_SCALED, "t2m", F.col("split") == "train")


_FIT_ALL = ", ".join(f"avg(\"{c}\") AS \"mean_{c}\", {_STD(c)} AS \"std_{c}\"" for c in _ALL_SCALED)
add("scaler_fit_train", "SELECT " + ", ".join(f"{r(f'avg({chr(34)}{c}{chr(34)})')} AS \"mean_{c}\", {r(_STD(c))} AS \"std_{c}\"" for c in _ALL_SCALED) + f", {r('avg(t2m)')} AS target_mean, {r('stddev_pop(t2m)')} AS target_std FROM parted WHERE split = 'train'", FEATURED)(lambda s, d: _train_scaler(s, d)[1])
add("scaled_features_train", f", fit AS (SELECT {_FIT_ALL} FROM parted WHERE split = 'train') SELECT series, ts, " + ", ".join(f"{r(f'({chr(34)}{c}{chr(34)} - {chr(34)}mean_{c}{chr(34)}) / {chr(34)}std_{c}{chr(34)}')} AS \"{c}\"" for c in _ALL_SCALED) + " FROM parted, fit", FEATURED)(
    lambda s, d: features.apply_scaler(*_train_scaler(s, d), _ALL_SCALED).select("series", "ts", *_ALL_SCALED))
_CELLS = ", ".join(f"lag({c}, {k}) OVER {_W}" if k else c for k in range(47, -1, -1) for c in ("t2m", "rh"))
_WHOLE = lambda x: f"md5(array_to_string(list_transform({x}, lambda x: CAST(CAST(round(CAST(CAST(x AS FLOAT) AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)), ','))"
add("sequence_windows", f", windowed AS (SELECT series, ts, split, list_value({_CELLS}) AS x, list_value(\"t2m_t+1h\", \"t2m_t+24h\") AS y FROM parted) SELECT series, ts, split, 48 AS n, {_WHOLE('x')} AS x, {_WHOLE('y')} AS y FROM windowed WHERE split <> 'none'", FEATURED)(lambda s, d: _sequences(s, d))


def _sequences(spark, sf_dir):
    """Every window of every split, as digests over all its values to three decimals."""
    rows = features.sequence_windows(split_rows(spark, sf_dir), None, ["t2m", "rh"], ["t2m_t+1h", "t2m_t+24h"], KEYS, check=False)
    whole = lambda x: F.md5(F.array_join(F.transform(x, lambda v: F.round(v.cast("double") * 1000).cast("long").cast("string")), ",").cast("binary"))
    return rows.select("series", "ts", "split", F.size("X").alias("n"), whole(F.flatten("X")).alias("x"), whole(F.col("y")).alias("y"))


# Typing, masking, duplicates.
_TEXT = """, raw AS (SELECT *, date_diff('hour', TIMESTAMP '1970-01-01', ts) % 11 AS m FROM observed)
, text AS (SELECT series, ts, CASE m WHEN 1 THEN '-999' WHEN 2 THEN ' ' WHEN 3 THEN '1d' WHEN 4 THEN 'abc' WHEN 5 THEN '1e2' WHEN 6 THEN 'inf' WHEN 7 THEN '-99.0' WHEN 8 THEN '360' ELSE ' 12.5 ' END AS cell FROM raw)
, numbers AS (SELECT *, CASE WHEN regexp_full_match(trim(cell), '[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF](inity)?)') THEN TRY_CAST(trim(cell) AS DOUBLE) END AS x FROM text)
"""


def _text(spark, sf_dir):
    o = observed(spark, sf_dir).withColumn("m", axis.hours_between(F.col("ts"), F.lit("1970-01-01").cast("timestamp_ntz")) % 11)
    cell = F.lit(" 12.5 ")
    for m, v in ((1, "-999"), (2, " "), (3, "1d"), (4, "abc"), (5, "1e2"), (6, "inf"), (7, "-99.0"), (8, "360")):
        cell = F.when(F.col("m") == m, v).otherwise(cell)
    return o.select("series", "ts", cell.alias("cell"))


add("coerce_numeric", "SELECT series, ts, CASE WHEN isinf(x) THEN NULL ELSE " + r("x") + " END AS x, isinf(x) AS is_inf FROM numbers", BASE + _TEXT)(lambda s, d: _text(s, d).select("series", "ts", F.when(~ingest.to_number(F.col("cell")).isin(float("inf")), ingest.to_number(F.col("cell"))).alias("x"), ingest.to_number(F.col("cell")).isin(float("inf")).alias("is_inf")))
add("invalid_to_null", f"SELECT series, ts, {r('CASE WHEN x BETWEEN 0 AND 360 AND x NOT IN (-999, -99) AND NOT isinf(x) THEN x END')} AS x FROM numbers", BASE + _TEXT)(lambda s, d: _text(s, d).select("series", "ts", ingest.mask_invalid(ingest.to_number(F.col("cell")), 0, 360).alias("x")))
add("wind_360_to_0", f"SELECT series, ts, {r('CASE WHEN x = 360 THEN 0 WHEN x BETWEEN 0 AND 360 THEN x END')} AS x FROM numbers", BASE + _TEXT)(lambda s, d: _text(s, d).select("series", "ts", ingest.fold_north(ingest.mask_invalid(ingest.to_number(F.col("cell")), 0, 360)).alias("x")))
add("audit_raw", "SELECT 'cell' AS variable, count(*) FILTER (WHERE trim(cell) = '') AS blank, count(*) FILTER (WHERE trim(cell) <> '' AND x IS NULL) AS unparseable, count(*) FILTER (WHERE x IN (-999, -99)) AS fill_value, count(*) FILTER (WHERE isinf(x)) AS infinity FROM numbers", BASE + _TEXT)(lambda s, d: ingest.audit_text(_text(s, d), ["cell"]))
add("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS missing, {r(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*)')} AS missing_pct, count(DISTINCT {c}) AS \"unique\" FROM dense" for c, t in (("series", "string"), ("t2m", "double"), ("rh", "double"))))(
    lambda s, d: ingest.column_profile(dense(s, d).select("series", "t2m", "rh")))
add("dedup_exact", "SELECT DISTINCT event_type, hour(ts) AS h, CASE WHEN value > 100 THEN NULL ELSE floor(value / 10) END AS v FROM events", "")(lambda s, d: ingest.drop_exact(_events(s, d), ["event_type", "h", "v"]))
add("dup_conflicts", "SELECT event_type, h, count(*) AS rows FROM (SELECT DISTINCT event_type, hour(ts) AS h, CASE WHEN value > 100 THEN NULL ELSE floor(value / 10) END AS v FROM events) GROUP BY 1, 2 HAVING count(*) > 1", "")(lambda s, d: ingest.conflicts(ingest.drop_exact(_events(s, d), ["event_type", "h", "v"]), ["event_type", "h"]))
add("dup_conflicts_cols", """, k AS (SELECT event_type, date_trunc('hour', ts) AS ts, user_id, CASE WHEN value > 100 THEN NULL ELSE floor(value / 10) END AS v FROM events)
SELECT * FROM (SELECT event_type, ts, concat_ws('|', CASE WHEN count(DISTINCT user_id) > 1 THEN 'user_id' END, CASE WHEN count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) > 1 THEN 'v' END) AS columns FROM k GROUP BY 1, 2) WHERE columns <> ''""")(
    lambda s, d: ingest.column_conflicts(table(s, d, "events").select("event_type", axis.hour_of(F.col("ts")).alias("ts"), "user_id", F.when(~(F.col("value") > 100), F.floor(F.col("value") / 10)).alias("v")), ["event_type", "ts"], ["user_id", "v"]))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("h"), F.when(~(F.col("value") > 100), F.floor(F.col("value") / 10).cast("double")).alias("v"))


add("parse_ts_validate", "SELECT count(*) FILTER (WHERE event_id % 10 = 0) AS without_offset, 0::BIGINT AS unparseable, count(*) FILTER (WHERE event_id % 10 <> 0 AND date_trunc('hour', ts) <> ts) AS off_hour FROM events", "")(
    lambda s, d: table(s, d, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 10 == 0, "").otherwise("Z")).alias("t")).agg(*[c.alias(n) for n, c in ingest.time_faults(F.col("t")).items()]))
add("localize_ts", "SELECT event_id, ts + INTERVAL 7 HOUR AS local FROM events", "")(lambda s, d: table(s, d, "events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("Asia/Ho_Chi_Minh"), F.col("ts")).alias("local")))
add("change_log", ", ".join(["", "x AS (SELECT 1)"]) + f" SELECT d.series, d.ts, 't2m' AS \"column\", {r('d.t2m')} AS before, {r('f.t2m')} AS after FROM dense d JOIN filled f ON d.series = f.series AND d.ts = f.ts WHERE d.t2m IS DISTINCT FROM f.t2m", FILLED)(
    lambda s, d: ingest.cell_changes(dense(s, d), filled(s, d), ["series", "ts"], ["t2m"]))
add("compare_versions", "SELECT 't2m' AS variable, count(*) FILTER (WHERE NOT (coalesce(abs(d.t2m - f.t2m) <= 1e-9, false) OR d.t2m IS NOT DISTINCT FROM f.t2m)) AS changed, count(*) FILTER (WHERE d.t2m IS NULL) AS missing_a, count(*) FILTER (WHERE f.t2m IS NULL) AS missing_b FROM dense d JOIN filled f ON d.series = f.series AND d.ts = f.ts", FILLED)(
    lambda s, d: analytics.compare_versions(dense(s, d), filled(s, d), ["series", "ts"], ["t2m"]))
_DIGEST = "SELECT n_nationkey, sha1('" + "".join(f"\\x{b:02X}" for b in NAMESPACE.bytes) + "'::BLOB || encode(n_name || '|' || CAST(n_nationkey AS VARCHAR))) AS d FROM nation"
add("record_id", f"SELECT n_nationkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (position(substr(d, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS record_id FROM ({_DIGEST})", "")(lambda s, d: table(s, d, "nation").select("n_nationkey", uuid5(NAMESPACE, F.concat_ws("|", "n_name", "n_nationkey")).alias("record_id")))
add("lineage", "SELECT event_type AS series, date_trunc('hour', ts) AS ts, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY event_id) AS source_rows FROM events GROUP BY 1, 2", "")(
    lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("series"), axis.hour_of(F.col("ts")).alias("ts")).agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), "|").alias("source_rows")))

# Rows.
add("complete_rows", "SELECT series, ts FROM dense WHERE " + " AND ".join(f"{v} IS NOT NULL" for v in VARS))(lambda s, d: dense(s, d).dropna(subset=VARS).select("series", "ts"))
add("time_slice", f"SELECT series, ts, {r('t2m')} AS t2m FROM dense WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")(lambda s, d: dense(s, d).where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-08'").select("series", "ts", "t2m"))
add("tabular_xy", f"SELECT series, ts, {r('t2m')} AS t2m, {r(chr(34) + 't2m_t+24h' + chr(34))} AS \"t2m_t+24h\" FROM parted WHERE split = 'train'", FEATURED)(lambda s, d: split_rows(s, d).where("split = 'train'").select("series", "ts", "t2m", "`t2m_t+24h`"))
add("latest_complete_row", f"SELECT series, max(ts) AS ts, {r('max_by(t2m, ts)')} AS t2m FROM dense WHERE " + " AND ".join(f"{v} IS NOT NULL" for v in VARS) + " GROUP BY series")(lambda s, d: dense(s, d).dropna(subset=VARS).groupBy("series").agg(F.max("ts").alias("ts"), F.max_by("t2m", "ts").alias("t2m")))
add("unpivot_vars", f"SELECT series, ts, variable, {r('value')} AS value FROM long")(lambda s, d: _long(s, d).select("series", "ts", "variable", "value"))


def _long(spark, sf_dir, variables=("t2m", "rh", "ps", "ws", "rad")):
    return quality.unpivot(dense(spark, sf_dir), KEYS, list(variables))


# Aggregations.
_DESC = lambda c, qs: f"SELECT '{c}' AS variable, count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, " + ", ".join(f"{r(f'quantile_cont({c}, {q})')} AS p{100 * q:g}" for q in qs) + f", {r(f'max({c})')} AS max FROM dense"
add("describe_vars", " UNION ALL ".join(_DESC(c, (0.25, 0.5, 0.75)) for c in VARS))(lambda s, d: analytics.describe(dense(s, d), VARS))
add("describe_ext", " UNION ALL ".join(_DESC(c, (0.01, 0.25, 0.5, 0.75, 0.99)) for c in VARS))(lambda s, d: analytics.describe(dense(s, d), VARS, (0.01, 0.25, 0.5, 0.75, 0.99)))
_MONTHS = ", mon AS (SELECT l_returnflag AS flag, date_trunc('month', l_shipdate) AS month, max(l_extendedprice) AS top, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _monthly(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.date_trunc("MONTH", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.max("l_extendedprice").alias("top"), F.count(F.lit(1)).alias("n"))


add("monthly_resample", """, f AS (SELECT l_returnflag AS flag, date_trunc('month', l_shipdate) AS bin, count(*) AS rows, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2),
b AS (SELECT flag, unnest(generate_series(min(bin), max(bin), INTERVAL 1 MONTH)) AS bin FROM f GROUP BY flag)
SELECT b.flag, b.bin, coalesce(rows, 0) AS rows, """ + r("top") + " AS top FROM b LEFT JOIN f ON b.flag = f.flag AND b.bin = f.bin")(
    lambda s, d: analytics.resample(table(s, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "month", {"top": F.max("l_extendedprice")}, ["flag"], "l_shipdate"))
add("climatology", _MONTHS + f"""SELECT e.flag, e.m, {r('avg(top)')} AS mean, {r('median(top)')} AS median, {r('min(top)')} AS min, {r('max(top)')} AS max, count(top) AS n_years
FROM (SELECT flag, unnest(range(1, 13))::INT AS m FROM (SELECT DISTINCT flag FROM mon)) e LEFT JOIN mon ON mon.flag = e.flag AND month(mon.month) = e.m GROUP BY 1, 2""")(lambda s, d: analytics.climatology(_monthly(s, d), "top", ["flag"]))
add("pivot_year_month", _MONTHS + "SELECT year(month) AS year, " + ", ".join(f"{r(f'max(top) FILTER (WHERE month(month) = {m})')} AS m{m}" for m in range(1, 13)) + " FROM mon WHERE flag = 'N' GROUP BY 1")(lambda s, d: analytics.pivot_months(_monthly(s, d).where("flag = 'N'"), "top"))
add("pivot_year_month_flags", _MONTHS + "SELECT flag, year(month) AS year, " + ", ".join(f"{r(f'max(top) FILTER (WHERE month(month) = {m})')} AS m{m}" for m in range(1, 13)) + " FROM mon GROUP BY 1, 2")(lambda s, d: analytics.pivot_months(_monthly(s, d), "top", keys=["flag"]))
add("yearly_agg", f"SELECT year(l_shipdate) AS year, {r('min(l_extendedprice)')} AS lo, {r('max(l_extendedprice)')} AS hi, count(*) AS n FROM lineitem GROUP BY 1", "")(lambda s, d: table(s, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.count(F.lit(1)).alias("n")))
add("month_hour_mean", "SELECT series AS row, " + ", ".join(f"{r(f'avg(t2m) FILTER (WHERE hour(ts) = {h})')} AS h{h}" for h in range(24)) + " FROM dense GROUP BY 1")(lambda s, d: analytics.hour_matrix(dense(s, d), "t2m", F.col("series")))
add("rain_coverage", f"""SELECT series, date_trunc('month', ts) AS month, {r('sum(rain) FILTER (WHERE is_inserted_hour = 0)')} AS total, count(rain) FILTER (WHERE is_inserted_hour = 0) AS observed, (day(last_day(min(ts))) * 24)::INT AS expected,
{r("count(rain) FILTER (WHERE is_inserted_hour = 0) * 100.0::DOUBLE / (day(last_day(min(ts))) * 24)")} AS coverage_pct, count(rain) FILTER (WHERE is_inserted_hour = 0) = day(last_day(min(ts))) * 24 AS is_complete FROM dense GROUP BY 1, 2""")(lambda s, d: analytics.month_coverage(dense(s, d), "rain", F.col("is_inserted_hour") == 0, KEYS))
_Q = ", q AS (SELECT series, variable, season, count(value) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, mad(value) AS mad FROM long GROUP BY 1, 2, 3)"
add("seasonal_thresholds", _Q + f"SELECT series, variable, season, n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3, {r('mad')} AS mad FROM q")(lambda s, d: analytics.group_thresholds(dense(s, d), KEYS, ["t2m", "rh", "ps", "ws", "rad"], season()))
add("wet_quantile", f"SELECT series, {r('quantile_cont(rain, 0.999) FILTER (WHERE rain > 0.1)')} AS wet_limit FROM dense GROUP BY 1")(lambda s, d: dense(s, d).groupBy("series").agg(F.percentile(F.when(F.col("rain") > 0.1, F.col("rain")), F.lit(0.999)).alias("wet_limit")))
add("skew_log1p", " UNION ALL ".join(f"SELECT '{c}' AS variable, {r(f'skewness({c})')} AS skew, {r(f'skewness(ln(1 + {c}))')} AS skew_log1p FROM dense" for c in ("rain", "ws")))(lambda s, d: analytics.skews(dense(s, d), ["rain", "ws"]))
add("feature_target_corr", " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS target, {r(f'corr({chr(34)}{a}{chr(34)}, {chr(34)}{b}{chr(34)})')} AS r FROM featured" for a in ("t2m", "rh", "ps", "t2m_lag_24h") for b in ("t2m_t+1h", "t2m_t+24h")), FEATURED)(
    lambda s, d: analytics.correlations(features.add_features(filled(s, d), KEYS, names=NAMES), ["t2m", "rh", "ps", "t2m_lag_24h"], ["t2m_t+1h", "t2m_t+24h"]))
_COLS = features.feature_names(NAMES)
add("feature_target_corr_train", " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS target, {r(f'corr({chr(34)}{a}{chr(34)}, {chr(34)}{b}{chr(34)})')} AS r FROM train" for a in _COLS["tabular"] for b in _COLS["targets"]), FEATURED + ", train AS (SELECT * FROM parted WHERE split = 'train')")(
    lambda s, d: analytics.correlations(split_rows(s, d).where("split = 'train'"), _COLS["tabular"], _COLS["targets"]))
_LAGS = [0, 1, 2, 12, 24, 48]
add("acf", ", l AS (SELECT series, rh, " + ", ".join(f"lag(rh, {k}) OVER {_W} AS x{k}" for k in _LAGS[1:]) + " FROM dense) SELECT series, 0 AS lag, 1.0::DOUBLE AS acf FROM l GROUP BY series UNION ALL " + " UNION ALL ".join(f"SELECT series, {k} AS lag, {r(f'corr(rh, x{k})')} AS acf FROM l GROUP BY series" for k in _LAGS[1:]))(
    lambda s, d: analytics.autocorrelation(dense(s, d), "rh", _LAGS, KEYS))
add("acf_168", f"SELECT a.series, k::INT AS lag, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE {r('corr(a.rh, b.rh)')} END AS acf FROM dense a, range(169) t(k), dense b WHERE b.series = a.series AND b.ts = a.ts - INTERVAL 1 HOUR * k GROUP BY 1, k")(lambda s, d: analytics.autocorrelation(dense(s, d), "rh", list(range(169)), KEYS))
add("histogram", "SELECT 'rh' AS variable, least(floor((rh - lo) * 60 / (hi - lo)), 59)::INT AS bin, count(*) AS n FROM dense, (SELECT min(rh) AS lo, max(rh) AS hi FROM dense) WHERE rh IS NOT NULL GROUP BY 2")(lambda s, d: analytics.histogram(dense(s, d), ["rh"], 60))
_EDGES = [0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0]
add("speed_bin_mean", f", t AS (SELECT ws, abs({_CIRC} - 360 * floor({_CIRC} / 360) - 180) AS turn FROM dense) SELECT CASE " + " ".join(f"WHEN ws {'>=' if i == 0 else '>'} {a} AND ws <= {b} THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))) + f" END AS bin, count(*) AS n, {r('avg(turn)')} AS mean_turn FROM t WHERE turn IS NOT NULL AND ws BETWEEN 0 AND 16 GROUP BY 1")(
    lambda s, d: analytics.speed_bins(dense(s, d), "ws", "wd", _EDGES, KEYS))
add("wind_rose", f""", w AS (SELECT series, floor(CASE WHEN wd + 11.25 >= 360 THEN wd + 11.25 - 360 ELSE wd + 11.25 END / 22.5)::INT AS sector, count(*) AS n FROM dense WHERE ws >= 0.5 AND wd IS NOT NULL GROUP BY 1, 2)
SELECT series, sector, n, {r('n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY series)')} AS share_pct, row_number() OVER (PARTITION BY series ORDER BY n DESC, sector) = 1 AS is_peak FROM w""")(lambda s, d: analytics.wind_rose(dense(s, d), "ws", "wd", {"series": F.col("series")}))
add("density_2d", "SELECT floor(t2m / 5)::INT AS cell_x, floor(rh / 10)::INT AS cell_y, count(*) AS n FROM dense WHERE t2m IS NOT NULL AND rh IS NOT NULL GROUP BY 1, 2")(lambda s, d: analytics.density(dense(s, d), "t2m", "rh", 5, 10))
add("box_stats", f""", q AS (SELECT series, quantile_cont(rad, 0.25) AS q1, median(rad) AS median, quantile_cont(rad, 0.75) AS q3 FROM dense GROUP BY 1)
SELECT d.series, {r('any_value(q1)')} AS q1, {r('any_value(median)')} AS median, {r('any_value(q3)')} AS q3, {r('min(rad) FILTER (WHERE rad BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_low, {r('max(rad) FILTER (WHERE rad BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_high,
count(*) FILTER (WHERE NOT rad BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers FROM dense d JOIN q ON d.series = q.series GROUP BY 1""")(lambda s, d: analytics.box_stats(dense(s, d), "rad", {"series": F.col("series")}))
add("global_iqr", f""", q AS (SELECT quantile_cont(rad, 0.25) AS a, quantile_cont(rad, 0.75) AS b FROM dense), o AS (SELECT ts, NOT rad BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AS is_out FROM dense, q)
SELECT 'rad' AS variable, count(*) FILTER (WHERE is_out) AS outside, {r('count(*) FILTER (WHERE is_out AND hour(ts) < 6) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE is_out), 0)')} AS cold_share_pct FROM o""")(lambda s, d: analytics.global_outliers(dense(s, d), ["rad"], F.hour("ts") < 6))
add("daily_median", f"SELECT series, strftime(ts, '%Y-%m-%d') AS date, {r('median(t2m)')} AS median, count(t2m) AS n FROM dense GROUP BY 1, 2")(lambda s, d: dense(s, d).groupBy("series", F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.percentile("t2m", F.lit(0.5)).alias("median"), F.count("t2m").alias("n")))
add("daily_mode_split", ", c AS (SELECT series, CAST(ts AS DATE) AS date, split, count(*) AS n FROM parted GROUP BY 1, 2, 3) SELECT series, strftime(date, '%Y-%m-%d') AS date, split AS mode FROM c QUALIFY row_number() OVER (PARTITION BY series, date ORDER BY n DESC, split) = 1", FEATURED)(lambda s, d: analytics.daily_mode(split_rows(s, d), "split", KEYS).withColumn("date", F.col("date").cast("string")))
add("horizon_difficulty", ", y AS (SELECT rh, " + ", ".join(f"lead(rh, {h}) OVER {_W} AS y{h}" for h in features.HORIZONS) + " FROM dense) " + " UNION ALL ".join(f"SELECT {h} AS horizon, {r(f'corr(rh, y{h})')} AS r, {r(f'avg(abs(y{h} - rh))')} AS mean_abs_change FROM y" for h in features.HORIZONS))(lambda s, d: analytics.horizon_difficulty(dense(s, d), "rh", features.HORIZONS, KEYS))

# Flags and events.
_DEV = ", med AS (SELECT series, variable, season, median(value) AS median, mad(value) AS mad, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2, 3), dev AS (SELECT l.*, median, mad, q1, q3, abs(value - median) / nullif(1.4826 * mad, 0) AS z FROM long l JOIN med USING (series, variable, season))"
add("seasonal_robust_z", _DEV + f"SELECT series, ts, variable, {r('value')} AS value, {r('z')} AS score, 1 AS severity, 'seasonal_robust_z>5' AS rule FROM dev WHERE z > 5")(lambda s, d: quality.flag_robust_z(_long(s, d), KEYS, season()))
add("flag_mad", _DEV + f"SELECT series, ts, variable, {r('value')} AS value, {r('0.6745 * abs(value - median) / mad')} AS score, 1 AS severity, 'seasonal_hour_MAD' AS rule FROM dev WHERE mad > 0 AND 0.6745 * abs(value - median) / mad > 3.5")(lambda s, d: quality.flag_mad(_long(s, d), KEYS, season()))
_IQR = f"SELECT series, ts, variable, {r('value')} AS value, {r('greatest(q1 - value, value - q3) / (q3 - q1)')} AS score, 1 AS severity, 'seasonal_hour_IQR' AS rule FROM dev WHERE q3 > q1 AND greatest(q1 - value, value - q3) > 1.5 * (q3 - q1)"
add("flag_iqr", _DEV + _IQR)(lambda s, d: quality.flag_iqr(_long(s, d), KEYS, season()))
add("wet_hour_flag", f""", lim AS (SELECT series, quantile_cont(rain, 0.99) FILTER (WHERE rain > 0.1) AS lim FROM dense GROUP BY 1)
SELECT d.series, d.ts, 'rain' AS variable, {r('rain')} AS value, {r('rain / lim')} AS score, 1 AS severity, 'wet_hour_q99>' || printf('%.2f', lim) AS rule FROM dense d JOIN lim l ON d.series = l.series WHERE rain > lim""")(lambda s, d: quality.flag_wet(_long(s, d, ["rain"]), KEYS, q=0.99))
add("flag_wet_month", f""", lim AS (SELECT series, month(ts) AS m, quantile_cont(rain, 0.995) AS lim FROM dense WHERE rain > 0.1 GROUP BY 1, 2)
SELECT d.series, d.ts, 'rain' AS variable, {r('rain')} AS value, {r('rain / lim')} AS score, 1 AS severity, 'wet_hour_month_q995' AS rule FROM dense d JOIN lim l ON d.series = l.series AND month(d.ts) = l.m WHERE rain > lim""")(lambda s, d: quality.flag_wet_by(_long(s, d, ["rain"]), KEYS, {"m": F.month("ts")}))
add("hourly_jump", f", st AS (SELECT series, ts, t2m, abs(t2m - lag(t2m) OVER {_W}) AS step FROM dense) SELECT series, ts, 't2m' AS variable, {r('t2m')} AS value, {r('step / 8')} AS score, 2 AS severity, 'hourly_jump>8C' AS rule FROM st WHERE step > 8")(lambda s, d: quality.flag_step(_long(s, d, ["t2m"]), KEYS))
_FLOORS = {"t2m": 5.0, "ps": 1.0, "rh": 10.0}
_JUMP = f""", st AS (SELECT series, ts, season, variable, value, value - lag(value) OVER (PARTITION BY series, variable ORDER BY ts) AS step FROM long WHERE variable IN ('t2m', 'ps', 'rh')),
lim AS (SELECT series, variable, season, quantile_cont(abs(step), 0.995) AS q FROM st GROUP BY 1, 2, 3),
j AS (SELECT st.*, greatest(q, CASE variable WHEN 't2m' THEN 5.0 WHEN 'ps' THEN 1.0 ELSE 10.0 END) AS lim FROM st JOIN lim USING (series, variable, season)),
k AS (SELECT *, coalesce(abs(step) > lim, false) AS large FROM j), n AS (SELECT *, lead(step) OVER w AS next_step, lead(large) OVER w AS next_large FROM k WINDOW w AS (PARTITION BY series, variable ORDER BY ts))"""
add("flag_jump", _JUMP + f"SELECT series, ts, variable, {r('value')} AS value, {r('abs(step) / lim')} AS score, 2 AS severity, 'large_hourly_jump' AS rule FROM n WHERE large")(lambda s, d: quality.flag_jump(_long(s, d, _FLOORS), KEYS, season(), _FLOORS))
add("flag_spike", _JUMP + f"SELECT series, ts, variable, {r('value')} AS value, {r('abs(step) / lim')} AS score, 3 AS severity, 'isolated_reversing_spike' AS rule FROM n WHERE large AND next_large AND step * next_step < 0")(lambda s, d: quality.flag_spike(_long(s, d, _FLOORS), KEYS, season(), _FLOORS))
add("flag_flat", f""", z AS (SELECT series, ts, floor(rain / 20) AS value FROM dense), nw AS (SELECT *, CASE WHEN value = lag(value) OVER {_W} THEN 0 ELSE 1 END AS new FROM z), rn AS (SELECT *, sum(new) OVER {_W} AS run FROM nw),
sz AS (SELECT *, count(*) OVER (PARTITION BY series, run) AS n FROM rn WHERE value IS NOT NULL) SELECT series, ts, 'rain' AS variable, {r('value')} AS value, {r('n / 6.0::DOUBLE')} AS score, 2 AS severity, 'constant_run_ge6h' AS rule FROM sz WHERE n >= 6""")(
    lambda s, d: quality.flag_flat(_long(s, d, ["rain"]).withColumn("value", F.floor(F.col("value") / 20).cast("double")), KEYS, 6))
add("flag_night_rad", f"SELECT series, ts, 'rad' AS variable, {r('rad')} AS value, {r('rad / 5')} AS score, 3 AS severity, 'deep_night_radiation_gt5' AS rule FROM dense WHERE (hour(ts) >= 22 OR hour(ts) <= 3) AND rad > 5")(lambda s, d: quality.flag_night(_long(s, d, ["rad"]), KEYS))
add("level_shift", f""", med AS (SELECT series, variable, season, median(value) AS median FROM long GROUP BY 1, 2, 3), res AS (SELECT l.series, l.variable, CAST(ts AS DATE) AS date, value - median AS residual FROM long l JOIN med USING (series, variable, season)),
da AS (SELECT series, variable, date, CASE WHEN count(residual) >= 20 THEN median(residual) END AS r FROM res GROUP BY 1, 2, 3),
sh AS (SELECT *, CASE WHEN count(r) OVER a = 3 THEN quantile_cont(r, 0.5) OVER a END - CASE WHEN count(r) OVER b = 3 THEN quantile_cont(r, 0.5) OVER b END AS shift FROM da
  WINDOW a AS (PARTITION BY series, variable ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS (PARTITION BY series, variable ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
lim AS (SELECT series, variable, greatest(quantile_cont(abs(shift), 0.9), 0.1) AS lim FROM sh GROUP BY 1, 2)
SELECT series, variable, strftime(date, '%Y-%m-%d') AS date, {r('shift')} AS level_shift, {r('lim')} AS "limit" FROM sh JOIN lim USING (series, variable) WHERE abs(shift) > lim""")(lambda s, d: quality.level_shifts(_long(s, d), KEYS, season(), dict.fromkeys(("t2m", "rh", "ps", "ws", "rad"), 0.1), days=3, q=0.9).withColumn("date", F.col("date").cast("string")))


def _flags(spark, sf_dir):
    long = _long(spark, sf_dir)
    return quality.flag_iqr(long, KEYS, season()).unionByName(quality.flag_step(_long(spark, sf_dir, ["t2m"]), KEYS, 30.0))


_ALL = _DEV + f""", flags AS ({_IQR} UNION ALL SELECT series, ts, 't2m', {r('t2m')}, {r('step / 30')}, 2, 'hourly_jump>30C' FROM (SELECT series, ts, t2m, abs(t2m - lag(t2m) OVER {_W}) AS step FROM dense) WHERE step > 30)
, cells AS (SELECT series, variable, ts, max(severity) AS severity, max(score) AS score FROM flags GROUP BY 1, 2, 3), ni AS (SELECT *, CASE WHEN date_diff('hour', lag(ts) OVER w, ts) = 1 THEN 0 ELSE 1 END AS new FROM cells WINDOW w AS (PARTITION BY series, variable ORDER BY ts)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY series, variable ORDER BY ts) AS island FROM ni),
ev AS (SELECT series, variable, min(ts) AS start, max(ts) AS "end", count(*) AS hours, max(severity) AS severity, max(score) AS score, island FROM isl GROUP BY series, variable, island),
why AS (SELECT i.series, i.variable, i.island, string_agg(DISTINCT f.rule, '|' ORDER BY f.rule) AS reasons FROM isl i JOIN flags f ON i.series = f.series AND i.variable = f.variable AND i.ts = f.ts GROUP BY 1, 2, 3),
named AS (SELECT e.series, e.variable, start, "end", hours, severity, score, reasons, printf('E%05d', row_number() OVER (ORDER BY severity DESC, score DESC, e.variable, start, e.series)) AS event_id FROM ev e JOIN why w ON e.series = w.series AND e.variable = w.variable AND e.island = w.island)
"""


def _ranked(spark, sf_dir):
    flags = _flags(spark, sf_dir).withColumn("score", F.round("score", 8) + 0.0)
    return quality.ranked_events(quality.events(flags, KEYS), KEYS)


add("flags_union", _ALL + "SELECT * FROM flags")(_flags)
add("flags_by_rule", _ALL + "SELECT rule, count(*) AS n FROM flags GROUP BY rule")(lambda s, d: _flags(s, d).groupBy("rule").agg(F.count(F.lit(1)).alias("n")))
add("flagged_unique", _ALL + "SELECT DISTINCT series, ts, variable FROM flags")(lambda s, d: _flags(s, d).select("series", "ts", "variable").distinct())
add("flag_summary", _ALL + f"SELECT (SELECT count(*) FROM cells) AS cells, {r('(SELECT count(*) FROM cells) * 100.0::DOUBLE / ((SELECT count(*) FROM dense) * 5)')} AS pct")(
    lambda s, d: _flags(s, d).select("series", "ts", "variable").distinct().agg(F.count(F.lit(1)).alias("cells")).crossJoin(dense(s, d).agg(F.count(F.lit(1)).alias("n"))).select("cells", (F.col("cells") * 100 / (F.col("n") * 5)).alias("pct")))
add("attach_flags", _ALL + "SELECT d.series, d.ts, coalesce(f.names, 'none') AS outlier_flags FROM dense d LEFT JOIN (SELECT series, ts, string_agg(DISTINCT variable, '|' ORDER BY variable) AS names FROM flags GROUP BY 1, 2) f ON d.series = f.series AND d.ts = f.ts")(
    lambda s, d: quality.attach_flags(dense(s, d), _flags(s, d), KEYS).select("series", "ts", "outlier_flags"))
add("flag_events", _ALL + "SELECT series, variable, start, \"end\", hours, severity, score, reasons FROM named")(lambda s, d: quality.events(_flags(s, d), KEYS))
add("events_ranked", _ALL + "SELECT * FROM named")(_ranked)
add("review_pick", _ALL + ", a AS (SELECT * FROM named ORDER BY CAST(substr(event_id, 2) AS BIGINT) LIMIT 3), b AS (SELECT * FROM named WHERE severity = 1 ORDER BY CAST(substr(event_id, 2) AS BIGINT) LIMIT 3) SELECT *, 'pending' AS decision, '' AS evidence, '' AS reviewer FROM (SELECT * FROM a UNION SELECT * FROM b)")(lambda s, d: quality.review_pick(_ranked(s, d)))
add("flags_in_event", _ALL + "SELECT f.*, n.event_id FROM flags f JOIN named n ON f.series = n.series AND f.variable = n.variable AND f.ts BETWEEN n.start AND n.\"end\"")(lambda s, d: quality.flags_within(_flags(s, d), _ranked(s, d), KEYS))

# Sources: request months and hour keys, payloads, text files, audits of the axis.
_MONTH_SQL = """SELECT status, greatest(a, m::DATE) AS first, least(b, last_day(m::DATE)) AS last
FROM (SELECT status, a, b, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM (SELECT o_orderstatus AS status, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1))"""


def _order_months(spark, sf_dir):
    """The request months of the days that each status of orders spans."""
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    return payload.months_of(spans)


add("month_ranges", f"SELECT status, strftime(first, '%Y-%m-%d') AS first, strftime(last, '%Y-%m-%d') AS last FROM ({_MONTH_SQL})", "")(
    lambda s, d: _order_months(s, d).select("status", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last")))
add("hour_keys", f"SELECT status, strftime(unnest(generate_series(first::TIMESTAMP, last::TIMESTAMP + INTERVAL 23 HOUR, INTERVAL 1 HOUR)), '%Y%m%d%H') AS key FROM ({_MONTH_SQL})", "")(
    lambda s, d: payload.hour_keys(_order_months(s, d)).select("status", "key"))


def _payloads(spark, sf_dir):
    """One JSON payload for each series and day, with fill values where a value is missing."""
    hours = observed(spark, sf_dir).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "key": F.date_format("ts", "yyyyMMddHH")})
    values = {c: F.map_from_entries(F.collect_list(F.struct("key", F.coalesce(c, F.lit(-999.0))))) for c in ("t2m", "rh")}
    made = hours.groupBy("series", "day").agg(F.create_map(*[x for c, m in values.items() for x in (F.lit(c), m)]).alias("parameter"))
    header = F.struct(F.when(F.col("day") != "2024-01-02", "UTC").otherwise("LST").alias("time_standard"), F.lit(-999.0).alias("fill_value"))
    units = F.create_map(F.lit("t2m"), F.struct(F.lit("C").alias("units")), F.lit("rh"), F.struct(F.lit("%").alias("units")))
    body = F.struct(header.alias("header"), F.struct(F.array(F.lit(105.8542), F.lit(21.0285)).alias("coordinates")).alias("geometry"), units.alias("parameters"), F.struct("parameter").alias("properties"))
    return payload.parse_payloads(made.select("series", "day", F.to_json(body).alias("json")))


add("json_map_to_wide", f"SELECT series, strftime(ts, '%Y-%m-%d') AS day, ts, {r('coalesce(t2m, -999)')} AS t2m, {r('coalesce(rh, -999)')} AS rh FROM observed")(
    lambda s, d: payload.payload_rows(_payloads(s, d), ["series", "day"], ["t2m", "rh"]))
add("payload_key_diff", """SELECT series, strftime(ts, '%Y-%m-%d') AS day, p AS parameter, 23 - count(*) FILTER (WHERE hour(ts) <> 3) AS missing, count(*) FILTER (WHERE hour(ts) = 3) AS unexpected
FROM observed, (VALUES ('t2m'), ('rh')) v(p) GROUP BY 1, 2, 3""")(lambda s, d: _key_difference(_payloads(s, d)))
add("payload_faults", "SELECT series, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN strftime(any_value(ts), '%Y-%m-%d') = '2024-01-02' THEN 'time standard is not UTC|' ELSE '' END || 'ps missing in data|ps missing in metadata' AS faults FROM observed GROUP BY 1, 2")(
    lambda s, d: _payloads(s, d).select("series", "day", F.array_join(payload.payload_faults(21.0285, 105.8542, ["t2m", "rh", "ps"]), "|").alias("faults")))
add("payload_missing_values", "SELECT series, strftime(ts, '%Y-%m-%d') AS day, p AS parameter, count(*) FILTER (WHERE p = 't2m' AND t2m IS NULL) AS missing FROM observed, (VALUES ('t2m'), ('rh')) v(p) GROUP BY 1, 2, 3")(
    lambda s, d: payload.hour_values(_payloads(s, d), ["series", "day"]).groupBy("series", "day", "parameter").agg(payload.missing_values(F.lit(-999.0)).alias("missing")))
add("completeness_check", "SELECT series, count(*) AS rows, count(DISTINCT ts) AS distinct_hours, 720 AS expected, count(*) = 720 AND count(DISTINCT ts) = 720 AS is_complete FROM observed GROUP BY 1")(
    lambda s, d: payload.completeness(observed(s, d), KEYS, F.lit(30)))


def _key_difference(parsed):
    """Payload hours against all hours of their day but 3 o'clock."""
    days = parsed.select("day", F.to_date("day").alias("first"), F.to_date("day").alias("last")).distinct()
    expected = payload.hour_keys(days).where(~F.col("key").endswith("03")).select("day", "key")
    return payload.key_difference(payload.hour_values(parsed, ["series", "day"]), expected, ["series", "day"])


add("scan_raw_text", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN '1d' ELSE c_mktsegment END AS cell FROM customer", "")(lambda s, d: _text_file(s, d))


def _text_file(spark, sf_dir):
    """Customers as a CSV file in the shared folder, read back as text."""
    path = new_path(spark, "customers")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 == 0, "1d").otherwise(F.col("c_mktsegment")).alias("cell"))
    rows.write.option("header", True).csv(path)
    return payload.read_text_table(spark, path, ["c_custkey", "c_name", "cell"])


_HIDDEN = "count(*) FILTER (WHERE trim(cell) = '') AS blank, count(*) FILTER (WHERE trim(cell) <> '' AND x IS NULL) AS unparseable, count(*) FILTER (WHERE x IN (-999, -99)) AS fill_value, count(*) FILTER (WHERE isinf(x)) AS infinity FROM numbers"
add("hidden_missing", f"SELECT 'cell' AS variable, {_HIDDEN} UNION ALL SELECT 'series' AS variable, 0, count(*), 0, 0 FROM numbers", BASE + _TEXT)(lambda s, d: ingest.audit_text(_text(s, d), ["cell", "series"]))
add("audit_rows", "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, h FROM e)) AS exact_duplicate_rows, count(*) - count(DISTINCT h) AS duplicate_timestamps FROM e", "WITH e AS (SELECT event_type, CAST(hour(ts) AS VARCHAR) AS h FROM events) ")(
    lambda s, d: ingest.row_audit(table(s, d, "events").select("event_type", F.hour("ts").cast("string").alias("h")), "h"))
add("invalid_to_null_audit", f"SELECT series, ts, {r('CASE WHEN x >= -273.15 AND x <> -999 AND NOT isinf(x) THEN x END')} AS \"T2M\", {r('CASE WHEN x > 0 AND NOT isinf(x) THEN x END')} AS \"PS\", {r('CASE WHEN x = 360 THEN 0 WHEN x BETWEEN 0 AND 360 THEN x END')} AS \"WD2M\" FROM numbers", BASE + _TEXT)(
    lambda s, d: ingest.typed(_text(s, d).select("series", "ts", *[F.col("cell").alias(v.name) for v in ingest.AUDIT]), ingest.AUDIT, ingest.AUDIT_FILLS).select("series", "ts", "T2M", "PS", "WD2M"))


def _source_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), axis.hour_of(F.col("ts")).alias("ts"), "event_id")
    return e, axis.declared_axis(e, KEYS, "2024-01-01 00:00:00", "2024-01-29 23:00:00")


_AXIS = """WITH s AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, event_id FROM events), b AS (SELECT *, coalesce(ts < lag(ts) OVER (PARTITION BY series ORDER BY event_id), false) AS back FROM s),
x AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29 23:00', INTERVAL 1 HOUR)) AS ts),
a AS (SELECT series, count(*) AS rows, count(DISTINCT ts) AS hours, count(*) - count(DISTINCT ts) AS duplicates, (SELECT count(*) FROM x) - count(DISTINCT ts) FILTER (WHERE ts IN (SELECT ts FROM x)) AS missing,
  count(DISTINCT ts) FILTER (WHERE ts NOT IN (SELECT ts FROM x)) AS unexpected, NOT bool_or(back) AS in_order, min(ts) AS start, max(ts) AS "end" FROM b GROUP BY 1) """
add("time_axis_audit", "SELECT * FROM a", _AXIS)(lambda s, d: axis.audit_axis(*_source_rows(s, d), KEYS, "event_id"))
add("export_invariants", "SELECT series, count(*) = count(DISTINCT ts) AS \"unique\", true AS in_order, true AS equals_axis FROM dense GROUP BY 1")(
    lambda s, d: axis.export_invariants(dense(s, d), axis.calendar(observed(s, d), KEYS), KEYS, "ts"))

# Months.
add("complete_months", """, dd AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT 1 AS part, date_trunc('month', day)::TIMESTAMP AS month, CAST(sum(n) FILTER (WHERE n >= 2) AS BIGINT) AS total, count(*) FILTER (WHERE n >= 2) AS observed, day(last_day(min(day)))::INT AS expected, 100.0::DOUBLE AS coverage_pct, true AS is_complete
FROM dd GROUP BY 2 HAVING count(*) FILTER (WHERE n >= 2) = day(last_day(min(day)))""")(
    lambda s, d: analytics.complete_months(table(s, d, "orders").groupBy(F.lit(1).alias("part"), F.date_trunc("DAY", "o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n")), "n", F.col("n") >= 2, ["part"], 1, "day"))
add("centered_12m", """, f AS (SELECT l_returnflag AS flag, date_trunc('month', l_shipdate) AS bin, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2),
b AS (SELECT flag, unnest(generate_series(min(bin), max(bin), INTERVAL 1 MONTH)) AS bin FROM f GROUP BY flag)
SELECT b.flag, b.bin, """ + r("CASE WHEN count(top) OVER c = 12 THEN avg(top) OVER c END") + " AS top_mean FROM b LEFT JOIN f ON b.flag = f.flag AND b.bin = f.bin WINDOW c AS (PARTITION BY b.flag ORDER BY b.bin ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)")(
    lambda s, d: analytics.resample(table(s, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "month", {"top": F.max("l_extendedprice")}, ["flag"], "l_shipdate").select("flag", "bin", features.centred("top", 12, axis.by_time(["flag"], "bin")).alias("top_mean")))

# The batch pipeline.
_BOUNDS = {v.name: (v.low, v.high) for v in ingest.WEATHER}
_MASKED = ", ".join(f"CASE WHEN {short} BETWEEN {_BOUNDS[long][0]} AND {_BOUNDS[long][1]} THEN {short} END AS {short}" for long, short in NAMES.items())
CLEANED = FILLED.replace("observed AS (", "measured AS (", 1).replace("), cal AS (", f"), observed AS (SELECT series, ts, {_MASKED} FROM measured\n), cal AS (", 1)
_CLEAN_COLS = [n for n in NAMES if n != "WD2M"]
add("clean_pipeline", "SELECT series, ts, " + ", ".join(f"{r(NAMES[n])} AS \"{n}\"" for n in _CLEAN_COLS) + f", {r('sin(radians(wd))')} AS wd_sin, {r('cos(radians(wd))')} AS wd_cos, is_inserted_hour, is_imputed, CASE WHEN is_imputed = 1 THEN concat_ws('|', {', '.join(f'CASE WHEN filled_{v} THEN {chr(39)}{n}{chr(39)} END' for n, v in NAMES.items())}) ELSE 'none' END AS imputed_columns FROM filled", CLEANED)(
    lambda s, d: _cleaned(s, d).clean.select("series", "ts", *_CLEAN_COLS, F.sin(F.radians("WD2M")).alias("wd_sin"), F.cos(F.radians("WD2M")).alias("wd_cos"), "is_inserted_hour", "is_imputed", "imputed_columns"))
add("clean_report", "SELECT series, count(*) AS rows, CAST(sum(is_inserted_hour) AS BIGINT) AS inserted_hours, CAST(sum(is_imputed) AS BIGINT) AS imputed_rows, " + ", ".join(f"count(*) FILTER (WHERE filled_{v}) AS \"filled_{n}\", count(*) FILTER (WHERE {v} IS NULL) AS \"missing_{n}\"" for n, v in NAMES.items()) + " FROM filled GROUP BY 1", CLEANED)(lambda s, d: _cleaned(s, d).report)


def _cleaned(spark, sf_dir):
    """The observed hours as text with an offset, cleaned."""
    o = observed(spark, sf_dir)
    text = o.select("series", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"), *[F.coalesce(F.col(v).cast("string"), F.lit("")).alias(n) for n, v in NAMES.items()])
    return pipeline.clean(text, KEYS, "UTC", validate=False, season=season())


_FIT_TRAIN = f", fit AS (SELECT {_FIT} FROM parted WHERE split = 'train')"
add("model_ready", _FIT_TRAIN + " SELECT series, ts, split, " + ", ".join(f"{r(f'({chr(34)}{c}{chr(34)} - {chr(34)}mean_{c}{chr(34)}) / {chr(34)}std_{c}{chr(34)}')} AS \"{c}\"" for c in _SCALED) + f", {r(chr(34) + 't2m_t+24h' + chr(34))} AS \"t2m_t+24h\" FROM parted, fit", FEATURED)(
    lambda s, d: pipeline.model_ready(filled(s, d), KEYS, SPLITS, VARS, NAMES)[0].select("series", "ts", "split", *_SCALED, "`t2m_t+24h`"))

# Rules at their usual settings, on the hours that orders span: one series for even and one for odd keys, an order's hour being
# its key's. Both sides make the values from the hour's number and the orders of that hour.
_MADE = {
    "t2m": "CASE WHEN k % 97 = 5 THEN NULL ELSE CAST(hour(ts) * 37 % 24 AS DOUBLE) / 4 + month(ts) * 2 + CAST(k % 41 AS DOUBLE) / 10 + CASE WHEN k = 13 THEN 25 ELSE 0 END + CAST(n * n % 9973 AS DOUBLE) / 100000 END",
    "rain": "CASE WHEN k % 5 = 0 THEN CAST(k * k % 997 AS DOUBLE) / 50 ELSE CAST(0 AS DOUBLE) END",
    "rh": "CASE WHEN (n {div} 500) % 7 = 3 AND n % 500 < 15 THEN CAST(77 AS DOUBLE) ELSE 50 + CAST(k * 31 % 500 AS DOUBLE) / 10 + CAST(n * n % 9973 AS DOUBLE) / 100000 END",
    "ps": "100 + CAST((n {div} 720) % 9 AS DOUBLE) / 4 + CAST(k % 11 AS DOUBLE) / 100 + CAST(n * n % 9973 AS DOUBLE) / 100000",
    "ws": "CAST(k % 80 AS DOUBLE) / 10",
    "wd": "CAST(k * 13 % 360 AS DOUBLE)",
    "rad": "CASE WHEN hour(ts) BETWEEN 6 AND 18 THEN CAST(k * 17 % 900 AS DOUBLE) WHEN k = 500 THEN CAST(9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
}
_K = "(n * 7919 + (n {div} 24) * 104729 + m * 31 + top) % 1009"
_MADE_SQL = {v: x.replace("{div}", "//") for v, x in _MADE.items()}
YEARS = f"""
WITH ordered AS (SELECT o_orderkey % 2 AS m, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS ts, max(o_orderkey % 1009) AS top FROM orders GROUP BY 1, 2),
cal AS (SELECT m, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts, a FROM (SELECT min(ts) AS a, max(ts) AS b FROM ordered), range(2) u(m)),
numbered AS (SELECT m, ts, n, {_K.replace('{div}', '//')} AS k, CASE m WHEN 0 THEN 'a' ELSE 'b' END AS series FROM (SELECT c.m, c.ts, date_diff('hour', a, c.ts) AS n, coalesce(top, 0) AS top FROM cal c LEFT JOIN ordered o ON c.m = o.m AND c.ts = o.ts)),
dense AS (SELECT series, ts, {', '.join(f'{x} AS {v}' for v, x in _MADE_SQL.items())} FROM numbered
), long AS (
  SELECT series, ts, month(ts) * 100 + hour(ts) AS season, variable, value FROM (SELECT series, ts, t2m, rh, ps, ws, rad FROM dense) UNPIVOT INCLUDE NULLS (value FOR variable IN (t2m, rh, ps, ws, rad))
)
"""


def _valued(numbered: DataFrame) -> DataFrame:
    """(series, ts, variables) from (m, n, ts, top)."""
    rows = numbered.selectExpr("*", _K.replace("{div}", "div") + " AS k", "chr(cast(97 + m AS int)) AS series")
    return rows.selectExpr("series", "ts", *[f"{x.replace('{div}', 'div')} AS {v}" for v, x in _MADE.items()])


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour that orders span, for even and odd order keys."""
    hour = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    ordered = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 2).alias("m"), hour.alias("ts")).agg(F.max(F.col("o_orderkey") % 1009).alias("top"))
    span = ordered.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    hours = span.select("a", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("ts"), F.lit([0, 1]).cast("array<long>").alias("ms"))
    hours = hours.select("ts", axis.hours_between(F.col("ts"), F.col("a")).alias("n"), F.explode("ms").alias("m"))
    return _valued(hours.join(ordered, ["m", "ts"], "left").withColumn("top", F.coalesce("top", F.lit(0))))


def generated(spark: SparkSession, hours: int, series: int) -> DataFrame:
    """As many hours as a bench wants, of values made the same way."""
    rows = spark.range(hours * series).selectExpr(f"id div {hours} AS m", f"id % {hours} AS n", "0L AS top")
    return _valued(rows.selectExpr("*", "timestamp_ntz'2019-01-01' + make_interval(0, 0, 0, 0, cast(n AS int)) AS ts"))


def _long_years(spark, sf_dir, variables=("t2m", "rh", "ps", "ws", "rad")):
    return quality.unpivot(years(spark, sf_dir), KEYS, list(variables))


add("robust_z_month_hour", _DEV + f"SELECT series, ts, variable, {r('value')} AS value, {r('z')} AS score, 1 AS severity, 'seasonal_robust_z>5' AS rule FROM dev WHERE z > 5", YEARS)(lambda s, d: quality.flag_robust_z(_long_years(s, d), KEYS, quality.season_keys()))
add("flag_mad_month_hour", _DEV + f"SELECT series, ts, variable, {r('value')} AS value, {r('0.6745 * abs(value - median) / mad')} AS score, 1 AS severity, 'seasonal_hour_MAD' AS rule FROM dev WHERE mad > 0 AND 0.6745 * abs(value - median) / mad > 3.5", YEARS)(lambda s, d: quality.flag_mad(_long_years(s, d), KEYS, quality.season_keys()))
add("flag_iqr_month_hour", _DEV + _IQR, YEARS)(lambda s, d: quality.flag_iqr(_long_years(s, d), KEYS, quality.season_keys()))
add("seasonal_thresholds_month_hour", _Q + f"SELECT series, variable, (season // 100)::INT AS month, (season % 100)::INT AS hour, n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3, {r('mad')} AS mad FROM q", YEARS)(
    lambda s, d: analytics.group_thresholds(years(s, d), KEYS, ["t2m", "rh", "ps", "ws", "rad"], {"month": F.month("ts"), "hour": F.hour("ts")}))
add("wet_hour_q999", f""", lim AS (SELECT series, quantile_cont(rain, 0.999) FILTER (WHERE rain > 0.1) AS lim FROM dense GROUP BY 1)
SELECT d.series, d.ts, 'rain' AS variable, {r('rain')} AS value, {r('rain / lim')} AS score, 1 AS severity, 'wet_hour_q99.9>' || printf('%.2f', lim) AS rule FROM dense d JOIN lim l ON d.series = l.series WHERE rain > lim""", YEARS)(lambda s, d: quality.flag_wet(_long_years(s, d, ["rain"]), KEYS))
add("flag_jump_month_hour", _JUMP + f"SELECT series, ts, variable, {r('value')} AS value, {r('abs(step) / lim')} AS score, 2 AS severity, 'large_hourly_jump' AS rule FROM n WHERE large", YEARS)(lambda s, d: quality.flag_jump(_long_years(s, d, _FLOORS), KEYS, quality.season_keys(), _FLOORS))
add("flag_flat_12h", f""", nw AS (SELECT series, ts, rh AS value, CASE WHEN rh = lag(rh) OVER {_W} THEN 0 ELSE 1 END AS new FROM dense), rn AS (SELECT *, sum(new) OVER {_W} AS run FROM nw),
sz AS (SELECT *, count(*) OVER (PARTITION BY series, run) AS n FROM rn WHERE value IS NOT NULL) SELECT series, ts, 'rh' AS variable, {r('value')} AS value, {r('n / 12.0::DOUBLE')} AS score, 2 AS severity, 'constant_run_ge12h' AS rule FROM sz WHERE n >= 12""", YEARS)(
    lambda s, d: quality.flag_flat(_long_years(s, d, ["rh"]), KEYS))
add("level_shift_7d", f""", med AS (SELECT series, variable, season, median(value) AS median FROM long GROUP BY 1, 2, 3), res AS (SELECT l.series, l.variable, CAST(ts AS DATE) AS date, value - median AS residual FROM long l JOIN med USING (series, variable, season)),
da AS (SELECT series, variable, date, CASE WHEN count(residual) >= 20 THEN median(residual) END AS r FROM res GROUP BY 1, 2, 3),
sh AS (SELECT *, CASE WHEN count(r) OVER a = 7 THEN quantile_cont(r, 0.5) OVER a END - CASE WHEN count(r) OVER b = 7 THEN quantile_cont(r, 0.5) OVER b END AS shift FROM da
  WINDOW a AS (PARTITION BY series, variable ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING), b AS (PARTITION BY series, variable ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
lim AS (SELECT series, variable, greatest(quantile_cont(abs(shift), 0.995), 0.1) AS lim FROM sh GROUP BY 1, 2)
SELECT series, variable, strftime(date, '%Y-%m-%d') AS date, {r('shift')} AS level_shift, {r('lim')} AS "limit" FROM sh JOIN lim USING (series, variable) WHERE abs(shift) > lim""", YEARS)(
    lambda s, d: quality.level_shifts(_long_years(s, d), KEYS, quality.season_keys(), dict.fromkeys(("t2m", "rh", "ps", "ws", "rad"), 0.1)).withColumn("date", F.col("date").cast("string")))
_SEASON_SQL = "CASE " + " ".join(f"WHEN month(ts) IN {months} THEN '{name}'" for name, months in analytics.SEASONS.items()) + " END"
add("diurnal_curves", f"SELECT series, {_SEASON_SQL} AS season, hour(ts)::INT AS hour, {r('avg(t2m)')} AS mean, count(t2m) AS n FROM dense GROUP BY 1, 2, 3", YEARS)(lambda s, d: analytics.diurnal_curves(years(s, d), "t2m", KEYS))
add("month_hour_matrix", "SELECT month(ts)::INT AS row, " + ", ".join(f"{r(f'avg(t2m) FILTER (WHERE hour(ts) = {h})')} AS h{h}" for h in range(24)) + " FROM dense GROUP BY 1", YEARS)(lambda s, d: analytics.hour_matrix(years(s, d), "t2m", F.month("ts")))
add("wind_rose_seasons", f""", w AS (SELECT series, {_SEASON_SQL} AS season, floor(CASE WHEN wd + 11.25 >= 360 THEN wd + 11.25 - 360 ELSE wd + 11.25 END / 22.5)::INT AS sector, count(*) AS n FROM dense WHERE ws >= 0.5 AND wd IS NOT NULL GROUP BY 1, 2, 3)
SELECT series, season, sector, n, {r('n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY series, season)')} AS share_pct, row_number() OVER (PARTITION BY series, season ORDER BY n DESC, sector) = 1 AS is_peak FROM w""", YEARS)(
    lambda s, d: analytics.wind_rose(years(s, d), "ws", "wd", {"series": F.col("series"), "season": analytics.season_of()}))
_WINTER = f"month(ts) IN {analytics.SEASONS['winter']}"
add("global_iqr_winter", " UNION ALL ".join(f"""SELECT '{c}' AS variable, count(*) FILTER (WHERE NOT {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS outside,
{r(f'count(*) FILTER (WHERE {_WINTER} AND NOT {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE NOT {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)), 0)')} AS cold_share_pct
FROM dense, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM dense)""" for c in ("t2m", "rain")), YEARS)(lambda s, d: analytics.global_outliers(years(s, d), ["t2m", "rain"], F.month("ts").isin(*analytics.SEASONS["winter"])))
_BOX = f"""{r('any_value(q1)')} AS q1, {r('any_value(median)')} AS median, {r('any_value(q3)')} AS q3, {r('min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_low,
{r('max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_high, count(*) FILTER (WHERE NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers"""
add("box_stats_scaled", f""", z AS (SELECT 'before' AS stage, ps AS x FROM dense WHERE year(ts) < 2001 UNION ALL SELECT 'after', (ps - m) / s FROM dense, (SELECT avg(ps) AS m, stddev_pop(ps) AS s FROM dense WHERE year(ts) < 2001) WHERE year(ts) < 2001),
q AS (SELECT stage, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3 FROM z GROUP BY 1) SELECT z.stage, {_BOX} FROM z JOIN q ON z.stage = q.stage GROUP BY 1""", YEARS)(lambda s, d: _boxes(s, d))


def _boxes(spark, sf_dir):
    """Box figures of a variable's train rows (all years but the last) before and after scaling."""
    rows = years(spark, sf_dir).where(F.year("ts") < 2001).withColumn("split", F.lit("train"))
    scaled = features.apply_scaler(rows, features.fit_scaler(rows, ["ps"], "ps", F.lit(True)), ["ps"])
    both = rows.select(F.lit("before").alias("stage"), "ps").unionByName(scaled.select(F.lit("after").alias("stage"), "ps"))
    return analytics.box_stats(both, "ps", {"stage": F.col("stage")})


add("exact_quantiles", " UNION ALL ".join(f"SELECT '{c}' AS variable, {', '.join(f'{r(f'quantile_cont({c}, {q})')} AS q{i}' for i, q in enumerate((0.01, 0.5, 0.995)))} FROM dense" for c in ("t2m", "rain")), YEARS)(
    lambda s, d: ranks.exact_quantiles(years(s, d), ["t2m", "rain"], (0.01, 0.5, 0.995)).select("variable", *[F.col("q")[i].alias(f"q{i}") for i in range(3)]))
add("metadata_drift", "SELECT 't2m' AS parameter, 2::BIGINT AS versions WHERE (SELECT count(DISTINCT day(ts) = 3) FROM observed) > 1")(lambda s, d: _drift(s, d))


def _drift(spark, sf_dir):
    """Payloads whose units of one parameter change on one day."""
    bodies = _payloads(spark, sf_dir)
    units = F.transform_values(F.col("payload.parameters"), lambda k, v: F.struct(F.when((k == "t2m") & F.col("day").endswith("-03"), "K").otherwise(v["units"]).alias("units"), v["longname"].alias("longname")))
    return payload.metadata_drift(bodies.withColumn("payload", F.col("payload").withField("parameters", units)))


# What goes with the pipeline: counts of its steps, windows cut from shards, rows with every column, rounding, band joins, values as VARIANT.
_PER = lambda step, table, cond: [f"SELECT '{step}', '{n}', count(*) FILTER (WHERE {cond(v)}) FROM {table}" for n, v in NAMES.items()]
add("clean_steps", "SELECT 'before' AS step, 'rows' AS variable, count(*) AS n FROM measured UNION ALL " + " UNION ALL ".join([
    *_PER("blank", "measured", lambda v: f"{v} IS NULL"), *_PER("invalid_to_null", "observed", lambda v: f"{v} IS NULL"), *_PER("missing_before_fill", "dense", lambda v: f"{v} IS NULL"),
    *_PER("filled", "filled", lambda v: f"filled_{v}"), *_PER("missing_after_fill", "filled", lambda v: f"{v} IS NULL"), "SELECT 'folded_360_to_0', 'WD2M', count(*) FILTER (WHERE wd = 360) FROM observed",
    "SELECT 'exact_duplicates_removed', 'rows', 0", "SELECT 'inserted_hours', 'rows', count(*) FILTER (WHERE is_inserted_hour = 1) FROM dense", "SELECT 'imputed', 'rows', count(*) FILTER (WHERE is_imputed = 1) FROM filled", "SELECT 'after', 'rows', count(*) FROM filled"]), CLEANED)(
    lambda s, d: pipeline.step_counts(s, _cleaned(s, d)).where("step <> 'flags_kept'"))
_SEQ, _TARGETS = features.feature_names(NAMES)["sequence"], features.feature_names(NAMES)["targets"]
_ROWS_48 = "list([" + ", ".join(f'"{c}"' for c in _SEQ) + "]) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)"
add("sequence_windows_full", f""", fit AS (SELECT avg(t2m) AS m, stddev_pop(t2m) AS s FROM parted WHERE split = 'train'),
windowed AS (SELECT series, ts, split, {_ROWS_48} AS x, [{', '.join(f'"{c}"' for c in _TARGETS)}] AS y FROM parted)
SELECT series, ts, split, 48 * {len(_SEQ)} AS n, {_WHOLE('flatten(x)')} AS x, {_WHOLE('list_transform(list_transform(y, lambda v: CAST(v AS FLOAT)), lambda v: (v - CAST(m AS FLOAT)) / CAST(s AS FLOAT))')} AS y FROM windowed, fit WHERE split <> 'none'""", FEATURED)(
    lambda s, d: _windows(s, d))


def _windows(spark, sf_dir):
    """Every window of every split with all features, targets scaled by the train rows' mean and deviation, as digests of all values to three decimals."""
    rows = written(split_rows(spark, sf_dir), "split_rows")
    scale = features.fit_scaler(rows, [], "t2m", F.col("split") == "train").first()
    shards = written(features.window_shards(rows, _SEQ, _TARGETS, KEYS, target_scale=(scale["target_mean"] or 0.0, scale["target_std"] or 1.0)), "window_shards")
    features.check_shards(shards, KEYS)
    whole = lambda x: F.md5(F.array_join(F.transform(x, lambda v: F.round(v.cast("double") * 1000).cast("long").cast("string")), ",").cast("binary"))
    return features.read_windows(shards, KEYS, len(_SEQ), len(_TARGETS)).select("series", "ts", "split", F.size("X").alias("n"), whole("X").alias("x"), whole("y").alias("y"))


_TABULAR = features.feature_names(NAMES)["tabular"]
_READY = lambda c: r(f'("{c}" - "mean_{c}") / "std_{c}"') if c in _ALL_SCALED else r(f'"{c}"')
add("model_ready_full", f", fit AS (SELECT {_FIT_ALL} FROM parted WHERE split = 'train') SELECT series, ts, split, " + ", ".join(f'{_READY(c)} AS "{c}"' for c in [*_TABULAR, *_TARGETS]) + " FROM parted, fit", FEATURED)(
    lambda s, d: pipeline.model_ready(filled(s, d), KEYS, SPLITS, VARS, NAMES)[0])
add("half_even", "SELECT series, ts, round_even(t2m, 1) + 0.0 AS t2m FROM dense")(lambda s, d: dense(s, d).select("series", "ts", F.bround("t2m", 1).alias("t2m")))
add("events_in_gaps", _RUNS.replace("SELECT series, min(ts) AS start", ", r AS (SELECT series, min(ts) AS start", 1) + ") SELECT e.event_id, r.series, r.hours FROM events e JOIN r ON e.event_type = r.series AND e.ts BETWEEN r.start AND r.\"end\" + INTERVAL 59 MINUTE")(
    lambda s, d: axis.within(
        table(s, d, "events").select("event_id", F.col("event_type").alias("series"), "ts"),
        axis.runs(dense(s, d), F.col("t2m").isNull(), KEYS).withColumn("end", F.col("end") + F.expr("interval 59 minutes")), KEYS).select("event_id", "series", "hours"))
add("payload_value_faults", "SELECT event_id, 'v' AS parameter, strftime(ts, '%Y%m%d%H') AS key, CASE event_id % 6 WHEN 1 THEN '\"7\"' WHEN 2 THEN 'true' ELSE '{\"a\":1}' END AS value FROM events WHERE event_id % 6 IN (1, 2, 4)", "")(lambda s, d: _value_faults(s, d))


def _value_faults(spark, sf_dir):
    """Each event as a payload of one hour whose value is a number, a text, a boolean, null or nested, by its id."""
    cell = F.col("value").cast("string")
    for i, text in ((1, '"7"'), (2, "true"), (3, "null"), (4, '{"a":1}'), (5, "1e2")):
        cell = F.when(F.col("event_id") % 6 == i, text).otherwise(cell)
    body = F.concat(F.lit('{"properties":{"parameter":{"v":{"'), F.date_format("ts", "yyyyMMddHH"), F.lit('":'), cell, F.lit("}}}}"))
    return payload.value_faults(table(spark, sf_dir, "events").select("event_id", body.alias("json")), ["event_id"])


add("cold_flag_share", f""", q AS (SELECT series, variable, season, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2, 3),
f AS (SELECT l.variable, month(ts) IN (12, 1, 2) AS cold FROM long l JOIN q USING (series, variable, season) WHERE q3 > q1 AND greatest(q1 - value, value - q3) > 1.5 * (q3 - q1))
SELECT variable, count(*) AS flags, {r('count(*) FILTER (WHERE cold) * 100.0::DOUBLE / count(*)')} AS cold_share_pct FROM f GROUP BY 1""", YEARS)(
    lambda s, d: analytics.cold_share(quality.flag_iqr(_long_years(s, d), KEYS, quality.season_keys()).unionByName(quality.flag_step(_long_years(s, d, ["t2m"]), KEYS)), "seasonal", F.month("ts").isin(*analytics.SEASONS["winter"])))


# Forecasts.
add("persistence_forecast", f", fit AS (SELECT avg(t2m) AS m, stddev_pop(t2m) AS s FROM parted WHERE split = 'train') SELECT series, ts, {r('t2m')} AS predicted FROM parted, fit WHERE split <> 'none'", FEATURED)(
    lambda s, d: _scaler(s, d)[0].where("split <> 'none'").crossJoin(F.broadcast(_scaler(s, d)[1])).select("series", "ts", forecast.persistence((F.col("t2m") - F.col("target_mean")) / F.col("target_std"), F.col("target_mean"), F.col("target_std")).alias("predicted")))
_ERR = "abs(\"t2m_t+24h\" - t2m)"
add("metrics_persistence", f"SELECT series, count({_ERR}) AS n, {r(f'avg({_ERR})')} AS mae, {r(f'sqrt(avg({_ERR} * {_ERR}))')} AS rmse, {r(f'avg(CASE WHEN {_ERR} IS NULL THEN NULL WHEN {_ERR} <= 1 THEN 1 ELSE 0 END) * 100')} AS within_1_pct, {r(f'avg(CASE WHEN {_ERR} IS NULL THEN NULL WHEN {_ERR} <= 2 THEN 1 ELSE 0 END) * 100')} AS within_2_pct FROM featured GROUP BY series", FEATURED)(
    lambda s, d: forecast.errors(features.add_features(filled(s, d), KEYS, names=NAMES), "t2m_t+24h", "t2m", KEYS))
add("accuracy_within", "SELECT " + f"count({_ERR}) AS n, " + ", ".join(f"{r(f'count(*) FILTER (WHERE {_ERR} <= {t}) * 100.0::DOUBLE / count({_ERR})')} AS within_{n}_pct" for t, n in ((0.5, "0_5"), (5, "5"), (10, "10"))) + " FROM featured", FEATURED)(
    lambda s, d: forecast.errors(features.add_features(filled(s, d), KEYS, names=NAMES), "t2m_t+24h", "t2m", None, (0.5, 5.0, 10.0)).drop("mae", "rmse"))
add("forecast_trees")(lambda s, d: _trees(s, d))


def _trees(spark, sf_dir):
    """Boosted trees for each horizon over the model-ready rows of all series, beside persistence; a rows-only check, as trees have no SQL form."""
    cols = features.feature_names(NAMES)
    ready, scaler, _ = pipeline.model_ready(filled(spark, sf_dir), KEYS, SPLITS, VARS, NAMES)
    rows = ready.crossJoin(F.broadcast(scaler.select("target_mean", "target_std")))
    now = forecast.persistence(F.col("t2m"), F.col("target_mean"), F.col("target_std"))
    return forecast.train_horizons(rows, cols["tabular"], dict(zip(features.HORIZONS, cols["targets"], strict=True)), now)
