"""The batch pipeline as composed transforms: text to clean hours, clean hours to model-ready rows, and their files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import six_digits
from ..operators import analytics, axis, features, forecast, impute, ingest, quality
from ..sources.journal import Journal, file_info, inside
from ..sources.payload import read_text_table, write_once
from ..sources.shared import written

CLEAN_FLAGS = ["is_inserted_hour", "is_imputed", "imputed_columns", "outlier_flags"]


@dataclass(frozen=True)
class Cleaned:
    """clean has one row for each hour; flags one for each flagged cell; report one row of counts a series; steps what each step did, by step and variable."""

    clean: DataFrame
    flags: DataFrame
    report: DataFrame
    steps: dict[str, dict]


def rule_flags(df: DataFrame, keys: list[str], season: dict | None = None) -> DataFrame:
    """The three rules of the cleaning step, in one table."""
    season = season or quality.season_keys()
    steady = quality.unpivot(df, keys, ["T2M", "RH2M", "PS", "WS2M", "ALLSKY_SFC_SW_DWN"])
    rain = quality.unpivot(df, keys, ["PRECTOTCORR"])
    temperature = quality.unpivot(df, keys, ["T2M"])
    return quality.flag_robust_z(steady, keys, season).unionByName(quality.flag_wet(rain, keys)).unionByName(quality.flag_step(temperature, keys))


#: The kinds of rules that rule_flags() has, by the start of their names.
RULES = ("seasonal_robust_z", "wet_hour", "hourly_jump")


def _watch(df: DataFrame, metrics: dict[tuple[str, str], Column]) -> tuple[DataFrame, Observation, list]:
    """df that tells counts while it is written; their keys are (step, variable)."""
    seen = Observation()
    return df.observe(seen, *[c.alias(f"c{i}") for i, c in enumerate(metrics.values())]), seen, list(metrics)


def _told(*watched: tuple[Observation, list]) -> dict[str, dict]:
    steps: dict[str, dict] = {}
    for seen, names in watched:
        found = seen.get
        for i, (step, variable) in enumerate(names):
            steps.setdefault(step, {})[variable] = found[f"c{i}"]
    return steps


def clean(raw: DataFrame, keys: list[str], zone: str = "Asia/Ho_Chi_Minh", variables=ingest.WEATHER, validate: bool = True, season: dict | None = None) -> Cleaned:
    """Text rows (keys, timestamp, variables) to gap-free local hours with their flags.

    Strict times, invalid cells to null, exact duplicates dropped, conflicts refused, hours inserted, gaps of up to three
    hours filled, outliers flagged and kept. Inputs are refused only where validate is set. The typed rows, the filled hours and the
    flags are written to the shared folder, and what each step did is counted while they are, by no pass of its own.
    """
    names = [v.name for v in variables]
    ingest.require(raw, [*keys, "timestamp", *names])
    if validate:
        rows = ingest.parse_times(raw, "timestamp", zone)
    else:
        rows = raw.withColumn("ts", ingest.to_local(ingest.parse_time(F.col("timestamp")), zone))
    numbers = {v: ingest.to_number(F.col(v.name)) for v in variables}
    masked = {v.name: ingest.mask_invalid(x, v.low, v.high) for v, x in numbers.items()}
    rows, of_text, text_names = _watch(rows, {
        ("before", "rows"): F.count(F.lit(1)),
        **{("blank", v.name): F.count_if(ingest.is_blank(F.col(v.name))) for v in variables},
        **{("invalid_to_null", v.name): F.count_if(masked[v.name].isNull()) for v in variables},
        **{("folded_360_to_0", v.name): F.count_if(masked[v.name] == 360) for v in variables if v.kind == "circular"}})
    rows = ingest.drop_exact(ingest.typed(rows, variables).select(*keys, "ts", *names), [*keys, "ts", *names])
    rows, of_rows, row_names = _watch(rows, {("distinct", "rows"): F.count(F.lit(1))})
    rows = written(rows, "typed_rows")
    if validate:
        ingest.refuse_conflicts(rows, [*keys, "ts"])
    dense, of_hours, hour_names = _watch(axis.densify(rows, keys), {
        ("inserted_hours", "rows"): F.count_if(F.col("is_inserted_hour") == 1),
        **{("missing_before_fill", n): F.count_if(F.col(n).isNull()) for n in names}})
    kind = lambda k: [v.name for v in variables if v.kind == k]
    filled = impute.provenance(impute.fill(dense, kind("linear"), kind("circular"), keys), names)
    filled, of_filled, filled_names = _watch(filled, {
        ("after", "rows"): F.count(F.lit(1)), ("after", "start"): F.min("ts"), ("after", "end"): F.max("ts"), ("imputed", "rows"): F.count_if(F.col("is_imputed") == 1),
        **{("filled", n): F.count_if(F.col(f"filled_{n}")) for n in names}, **{("missing_after_fill", n): F.count_if(F.col(n).isNull()) for n in names},
        **{(k, n): f(n) for n in names for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))}})
    # Flags, the flagged table and the report all start from the filled hours, so these are written once.
    filled = written(filled, "filled_hours")
    flags, of_flags, flag_names = _watch(rule_flags(filled, keys, season), {("flags_kept", r): F.count_if(F.col("rule").startswith(r)) for r in RULES})
    flags = written(flags, "flags")
    steps = _told((of_text, text_names), (of_rows, row_names), (of_hours, hour_names), (of_filled, filled_names), (of_flags, flag_names))
    steps["exact_duplicates_removed"] = {"rows": steps["before"]["rows"] - steps.pop("distinct")["rows"]}
    marked = quality.attach_flags(filled, flags, keys)
    counts = [F.count_if(F.col(f"filled_{n}")).alias(f"filled_{n}") for n in names] + [F.count_if(F.col(n).isNull()).alias(f"missing_{n}") for n in names]
    report = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("is_inserted_hour").alias("inserted_hours"), F.sum("is_imputed").alias("imputed_rows"), *counts)
    return Cleaned(marked.select(*keys, "ts", *names, *CLEAN_FLAGS), flags, report, steps)


def step_counts(spark: SparkSession, result: Cleaned) -> DataFrame:
    """(step, variable, n) of the steps that count."""
    rows = [(step, variable, n) for step, each in result.steps.items() for variable, n in each.items() if isinstance(n, int)]
    return spark.createDataFrame(rows, "step string, variable string, n long")


def model_ready(cleaned: DataFrame, keys: list[str], splits: dict[str, tuple[str, str]], raw: list[str], names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model_ready, scaler, unscaled features). The scaler is fitted on train rows only and applied to all."""
    cols = features.feature_names(names)
    # Fitting and applying the scaler both read the features, so these are written once.
    made = written(features.labelled_features(cleaned, features.quality_bad(raw), splits, keys, names=names), "features")
    scaler = features.fit_scaler(made, cols["scaled"], cols["sequence"][0], F.col("split") == "train")
    scaled = features.apply_scaler(made, scaler, cols["scaled"])
    return scaled.select(*keys, "ts", "split", *[f"`{c}`" for c in [*cols["tabular"], *cols["targets"]]]), scaler, made


def write_clean(result: Cleaned, folder: str, keys: list[str], least_rows: int = 10_000, variables=ingest.WEATHER, journal: Journal | None = None, sealed: tuple[str, ...] = ("data/raw",)) -> None:
    """Parquet of the hours in order of time, the flags in order of time and variable, and the report as one JSON line a series.

    Refuses sealed folders and tables with too few complete rows. With a journal, what is written is noted with its counts.
    """
    if any(inside(folder, s) for s in sealed):
        raise ValueError(f"{folder} is sealed: cleaned hours go elsewhere")
    complete = features.complete([v.name for v in variables])
    n = result.clean.where(complete).count()
    if n < least_rows:
        raise ValueError(f"only {n} hours are complete, not {least_rows}")
    # Directions leave with one digit, half to even; the filled hours keep all.
    rounded = result.clean.withColumns({v.name: F.bround(v.name, 1) for v in variables if v.kind == "circular"})
    parts = {"clean": (rounded, ["ts", *keys]), "outlier_flags": (result.flags, ["ts", "variable", "rule", *keys])}
    for name, (df, order) in parts.items():
        rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
        if journal:
            journal.note("WRITE_PLANNED", name=name, path=f"{folder}/{name}")
            rows = journal.watch(rows, name, rows=F.count(F.lit(1)), first=F.min("ts"), last=F.max("ts"))
        if write_once(rows, f"{folder}/{name}") and journal:
            journal.tell(name, "WRITTEN")
    write_once(result.report.coalesce(1), f"{folder}/report", "json")
    told = result.clean.sparkSession.createDataFrame([(json.dumps(result.steps, default=str, sort_keys=True),)], "value string")
    write_once(told.coalesce(1), f"{folder}/steps", "text")


def clean_step(spark: SparkSession, raw_path: str, folder: str, keys: list[str], journal_folder: str, least_rows: int = 10_000, zone: str = "Asia/Ho_Chi_Minh", variables=ingest.WEATHER, season: dict | None = None) -> Cleaned:
    """The cleaning step from a text table to its files, told in a journal that is open before anything is read."""
    with Journal(spark, journal_folder, "clean", {"input": raw_path, "output": folder, "zone": zone}) as journal:
        journal.note("INPUT", **file_info(spark, raw_path))
        raw = read_text_table(spark, raw_path, [*keys, "timestamp", *[v.name for v in variables]])
        result = clean(raw, keys, zone, variables, season=season)
        journal.note("TRANSFORMED", name="clean", steps=result.steps)
        write_clean(result, folder, keys, least_rows, variables, journal)
        journal.note("OUTPUT", **file_info(spark, f"{folder}/clean"))
    return result


def load_clean(spark: SparkSession, folder: str, keys: list[str], variables=ingest.WEATHER) -> DataFrame:
    """The clean table as it was typed: local hours, doubles, flags."""
    columns = [*[f"{k} string" for k in keys], "ts timestamp_ntz", *[f"{v.name} double" for v in variables], "is_inserted_hour int", "is_imputed int", "imputed_columns string", "outlier_flags string"]
    return spark.read.schema(", ".join(columns)).parquet(f"{folder}/clean")


def imputed(column: str) -> Column:
    """Whether a clean row's value of a column was filled, from the names joined by |."""
    return F.array_contains(F.split("imputed_columns", r"\|"), column)


def write_model_ready(ready: DataFrame, scaler: DataFrame, folder: str, columns: list[str] | None = None) -> None:
    """Parquet partitioned by split, lossless; the scaler as it is and, for the columns named, as one JSON document of column to mean and std; and a CSV of six significant digits, which loses the rest."""
    ready.write.mode("errorifexists").partitionBy("split").parquet(f"{folder}/model_ready")
    scaler.coalesce(1).write.mode("errorifexists").json(f"{folder}/scaler")
    if columns:
        spark = ready.sparkSession
        spark.createDataFrame([(scaler_params(scaler, columns),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/scaler_params")
    texts = [six_digits(F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in ready.dtypes]
    ready.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias("ts") if n == "ts" else c for (n, _), c in zip(ready.dtypes, texts, strict=True)]).write.mode("errorifexists").option("header", True).csv(f"{folder}/model_ready_csv")


def load_model_ready(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """The model-ready table; of one split only that split's files are read."""
    rows = spark.read.parquet(f"{folder}/model_ready")
    return rows.where(F.col("split") == split) if split else rows


def target_scaler(spark: SparkSession, folder: str) -> tuple[float, float]:
    row = spark.read.json(f"{folder}/scaler").select("target_mean", "target_std").first()
    return row["target_mean"], row["target_std"]


def scaler_params(scaler: DataFrame, columns: list[str]) -> str:
    """The scaler's one row as a JSON text of column to mean and std."""
    row = scaler.first()
    return json.dumps({c: {"mean": row[f"mean_{c}"], "std": row[f"std_{c}"]} for c in columns} | {"__target__": {"mean": row["target_mean"], "std": row["target_std"]}})


def feature_step(spark: SparkSession, clean_folder: str, folder: str, keys: list[str], splits: dict[str, tuple[str, str]], journal_folder: str, variables=ingest.WEATHER) -> None:
    """The feature step from the clean table's files to the model-ready ones, told in a journal."""
    names = [v.name for v in variables]
    with Journal(spark, journal_folder, "features", {"input": clean_folder, "output": folder, "splits": splits}) as journal:
        journal.note("INPUT", **file_info(spark, f"{clean_folder}/clean"))
        ready, scaler, made = model_ready(load_clean(spark, clean_folder, keys, variables), keys, splits, names)
        journal.note("TRANSFORMED", name="features", splits={r["split"]: r["rows"] for r in features.split_summary(made).collect()})
        journal.note("WRITE_PLANNED", path=folder)
        write_model_ready(ready, scaler, folder, features.feature_names()["scaled"])
        journal.note("OUTPUT", **file_info(spark, f"{folder}/model_ready"))


def train_step(spark: SparkSession, ready_folder: str, folder: str, journal_folder: str, config: forecast.LeafWise | forecast.Boosting = forecast.LeafWise()) -> DataFrame:
    """The training step from the model-ready files to models and their report, told in a journal. Returns the records."""
    cols = features.feature_names()
    targets = dict(zip(features.HORIZONS, cols["targets"], strict=True))
    with Journal(spark, journal_folder, "training", {"input": ready_folder, "output": folder, "config": asdict(config)}) as journal:
        journal.note("INPUT", **file_info(spark, f"{ready_folder}/model_ready"))
        mean, std = target_scaler(spark, ready_folder)
        now = forecast.persistence(F.col(cols["sequence"][0]), mean, std)
        scores = forecast.train_horizons(load_model_ready(spark, ready_folder), cols["tabular"], targets, now, config, folder=f"{folder}/models")
        records = forecast.horizon_records(scores, targets, f"{folder}/models")
        journal.note("TRANSFORMED", name="models", trees={r["horizon"]: r["trees"] for r in records.collect()})
        journal.note("WRITE_PLANNED", path=f"{folder}/report")
        forecast.write_report(records, f"{folder}/report", config)
        journal.note("OUTPUT", **file_info(spark, f"{folder}/report"))
    return records


def report_tables(raw: DataFrame, result: Cleaned, keys: list[str], variables=ingest.WEATHER, season: dict | None = None, floors: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """The exploratory step's tables by name, for write_reports(): audits of the text rows, what is missing and flat, shifts of level, flags, events and a table to review them.

    raw are the text rows that result was cleaned from; floors are least changes, of a level or from hour to hour, by variable.
    """
    names, season = [v.name for v in variables], season or quality.season_keys()
    linear, floors = [v.name for v in variables if v.kind == "linear"], floors or {}
    hours = result.clean
    long = quality.unpivot(hours, keys, linear)
    least = {n: floors.get(n, 0.0) for n in linear}
    flags = quality.flag_iqr(long, keys, season).unionByName(quality.flag_jump(long, keys, season, least)).unionByName(quality.flag_spike(long, keys, season, least)).unionByName(quality.flag_flat(long, keys))
    flags = written(flags, "exploratory_flags")
    ranked = quality.ranked_events(quality.events(flags, keys), keys)
    missing = [axis.runs(hours, F.col(n).isNull(), keys).withColumn("variable", F.lit(n)) for n in names]
    filled = hours.select(*keys, "ts", *[F.when(imputed(n), F.lit(None)).otherwise(F.col(n)).alias(n) for n in names])
    cold = F.month("ts").isin(*analytics.SEASONS["winter"])
    return {
        "descriptive_statistics": analytics.describe(hours, names), "raw_audit": ingest.column_profile(raw), "hidden_missing": ingest.audit_text(raw, names),
        "missing_runs": reduce(DataFrame.unionByName, missing), "flat_runs": quality.flat_runs(long, keys), "level_shifts": quality.level_shifts(long, keys, season, least),
        "change_log": ingest.cell_changes(filled, hours, [*keys, "ts"], names), "comparison": analytics.compare_versions(filled, hours, [*keys, "ts"], names),
        "flags_by_rule": flags.groupBy("rule", "variable").agg(F.count(F.lit(1)).alias("n")), "cold_flags": analytics.cold_share(flags, "seasonal", cold),
        "events": ranked, "review": quality.review_pick(ranked)}


def write_reports(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Small report tables as CSV, one file each; a table that is there already stays, as a reviewer may have filled it in. Returns the names written."""
    done = []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(target):
            df.coalesce(1).write.option("header", True).csv(path)
            done.append(name)
    return done
