"""Forecasts: the persistence baseline, error measures, one model of boosted trees for each horizon, and forecasts for one hour."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from . import boosting
from .boosting import BoostedTrees, LeafWise
from .ingest import to_local


def persistence(scaled: Column, mean: Column | float, std: Column | float) -> Column:
    """The value now, scaled back: the forecast that nothing changes."""
    return scaled * std + mean


def errors(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None, tolerances: tuple = (1.0, 2.0)) -> DataFrame:
    """(by, n, mae, rmse, within_<tol>_pct) over rows where both exist; a tolerance includes its bound."""
    if any(t <= 0 for t in tolerances):
        raise ValueError("tolerances must be positive")
    e = F.abs(F.col(f"`{actual}`") - F.col(f"`{predicted}`"))
    rows = df.withColumn("_e", e).where("_e is not null")
    within = [(F.avg((F.col("_e") <= t).cast("int")) * 100).alias(f"within_{t:g}_pct".replace(".", "_")) for t in tolerances]
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), *within)


def accuracy(df: DataFrame, actual: str, predicted: str, tolerance: float) -> float:
    """Share of rows, in per cent, whose error is within the tolerance; raises on a table without rows to measure."""
    row = errors(df, actual, predicted, tolerances=(tolerance,)).first()
    if not row["n"]:
        raise ValueError("no rows to measure")
    return row[-1]


@dataclass(frozen=True)
class Boosting:
    """MLlib's trees, grown level by level, in place of LeafWise; depth 5 stands for at most 31 leaves."""

    trees: int = 300
    rate: float = 0.05
    depth: int = 5
    least_rows: int = 30
    columns_share: str = "0.9"
    patience: int = 100
    seed: int = 42


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model's first n trees, as if boosting had ended there."""
    java = model._java_obj
    jvm = SparkSession.active()._jvm
    kinds = jvm.org.apache.spark.ml.regression
    trees = SparkSession.active().sparkContext._gateway.new_array(kinds.DecisionTreeRegressionModel, n)
    weights = SparkSession.active().sparkContext._gateway.new_array(jvm.double, n)
    for i, (tree, weight) in enumerate(zip(java.trees(), java.treeWeights(), strict=True)):
        if i < n:
            trees[i], weights[i] = tree, weight
    cut = kinds.GBTRegressionModel(model.uid, trees, weights)
    return GBTRegressionModel(java.copyValues(cut, jvm.org.apache.spark.ml.param.ParamMap.empty()))


def best_size(curve: list[float], patience: int) -> int:
    """How many trees give the least error, where training stops `patience` trees after the best one so far."""
    best = 0
    for i, error in enumerate(curve):
        if error < curve[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_horizon(train: DataFrame, validation: DataFrame, features: list[str], target: str, config: Boosting = Boosting()) -> PipelineModel:
    """Boosted trees for one target, fitted on squared loss and cut back to the number with the least absolute error on the validation rows.

    Trees beyond `patience` after the best one don't count, as if training had stopped there. Without validation rows all trees stay.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    gbt = GBTRegressor(
        featuresCol="features", labelCol=target, maxIter=config.trees, stepSize=config.rate, maxDepth=config.depth,
        minInstancesPerNode=config.least_rows, featureSubsetStrategy=config.columns_share, lossType="squared", seed=config.seed)
    model = gbt.fit(assembler.transform(train.select(*features, target)))
    if not validation.isEmpty():
        curve = model.evaluateEachIteration(assembler.transform(validation.select(*features, target)), "absolute")
        model = first_trees(model, best_size(curve, config.patience))
    return PipelineModel(stages=[assembler, model])


def score(model: PipelineModel | BoostedTrees, rows: DataFrame, target: str | None = None) -> DataFrame:
    """Adds prediction, and abs_error where the target is known."""
    out = model.transform(rows).drop("features")
    return out.withColumn("abs_error", F.abs(F.col(f"`{target}`") - F.col("prediction"))) if target else out


def train_horizons(rows: DataFrame, inputs: list[str], targets: dict[int, str], baseline: Column, config: LeafWise | Boosting = LeafWise(), split: str = "split", tolerances: tuple = (1.0, 2.0), folder: str | None = None) -> DataFrame:
    """One record for each horizon and split: the trees kept, then n, mae, rmse and within_<tol>_pct of its model and of the baseline.

    `targets` maps each horizon to its column. Every horizon has a model of its own, fitted on all rows of split train and
    cut back on those of val; rows of split none take no part. Without train rows the models' figures are null. LeafWise
    fits all horizons in the same rounds over the rows, Boosting each by itself.
    Models are saved in folder, if one is given, for load_model().
    """
    spark = rows.sparkSession
    kept = rows.where(F.col(split) != "none").select(split, *[f"`{c}`" for c in [*inputs, *targets.values()]], baseline.alias("_baseline")).persist()
    part = lambda name: kept.where(F.col(split) == name)

    def by_levels(target: str) -> PipelineModel:
        mine = lambda name: part(name).withColumn("_target", F.col(f"`{target}`"))
        return fit_horizon(mine("train"), mine("val"), inputs, "_target", config)

    def one(item: tuple[int, str]) -> list:
        horizon, target = item
        mine, trees = kept.withColumn("_target", F.col(f"`{target}`")), 0
        scored = mine.withColumn("prediction", F.lit(None).cast("double"))
        if horizon in models:
            model = models[horizon]
            scored = score(model, mine, "_target")
            trees = len(model.trees) if isinstance(model, BoostedTrees) else model.stages[-1].getNumTrees
            if folder is not None and isinstance(model, BoostedTrees):
                model.save(spark, horizon_path(folder, horizon))
            elif folder is not None:
                model.write().overwrite().save(horizon_path(folder, horizon))
        base = errors(scored, "_target", "_baseline", [split], tolerances)
        base = base.select(split, *[F.col(c).alias(c if c == "n" else f"persistence_{c}") for c in base.columns if c != split])
        own = errors(scored, "_target", "prediction", [split], tolerances).drop("n")
        return base.join(own, split, "left").select(F.lit(horizon).alias("horizon"), split, F.lit(trees).alias("trees"), "n", *[c for c in own.columns if c != split], *[c for c in base.columns if c.startswith("persistence_")]).collect()

    models: dict[int, PipelineModel | BoostedTrees] = {}
    try:
        with ThreadPool(len(targets)) as pool:
            if part("train").isEmpty():
                pass
            elif isinstance(config, LeafWise):
                fitted = boosting.fit(kept.where(F.col(split).isin("train", "val")), inputs, list(targets.values()), F.col(split) == "train", config)
                models = dict(zip(targets, fitted, strict=True))
            else:
                if spark.sparkContext.getCheckpointDir() is None:
                    # Each tree adds to the lineage of the residuals, which MLlib cuts only where it can checkpoint.
                    spark.sparkContext.setCheckpointDir(shared_dir(spark))
                models = dict(zip(targets, pool.map(by_levels, targets.values()), strict=True))
            records = [r for part in pool.map(one, targets.items()) for r in part]
    finally:
        kept.unpersist()
    names = ["mae", "rmse", *[f"within_{t:g}_pct".replace(".", "_") for t in tolerances]]
    schema = f"horizon int, {split} string, trees int, n long, " + ", ".join(f"{c} double" for c in [*names, *[f"persistence_{c}" for c in names]])
    return spark.createDataFrame(records, schema)


def horizon_records(scores: DataFrame, targets: dict[int, str], folder: str | None = None) -> DataFrame:
    """One record of eleven fields for each horizon, from train_horizons(): what validation chose and what test rows say, beside persistence on test rows. Errors are null where a split has no rows."""
    of = lambda name, part: F.max(F.when(F.col("split") == part, F.col(name)))
    name = F.create_map(*[x for h, t in targets.items() for x in (F.lit(h), F.lit(t))])[F.col("horizon")]
    path = F.concat(F.lit(f"{folder.rstrip('/')}/horizon-"), F.col("horizon").cast("string")) if folder else F.lit(None).cast("string")
    return scores.groupBy("horizon").agg(
        F.max("trees").alias("trees"), of("mae", "val").alias("validation_mae"), of("rmse", "val").alias("validation_rmse"), of("mae", "test").alias("test_mae"), of("rmse", "test").alias("test_rmse"),
        of("persistence_mae", "test").alias("persistence_test_mae"), of("persistence_rmse", "test").alias("persistence_test_rmse"),
        of("within_1_pct", "test").alias("test_within_1_pct"), of("within_2_pct", "test").alias("test_within_2_pct"),
    ).select("horizon", name.alias("target"), *["trees", "validation_mae", "validation_rmse", "test_mae", "test_rmse", "persistence_test_mae", "persistence_test_rmse", "test_within_1_pct", "test_within_2_pct"], path.alias("model")).drop(*([] if folder else ["model"]))


def write_report(records: DataFrame, folder: str, config: LeafWise | Boosting = LeafWise()) -> None:
    """The records as one CSV file with six decimals and, with the settings, as one JSON line. Records are one row for each horizon."""
    rows = records.orderBy("horizon").coalesce(1)
    texts = [F.format_string("%.6f", F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in rows.dtypes]
    rows.select(*texts).write.mode("errorifexists").option("header", True).csv(f"{folder}/metrics_csv")
    told = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("results"))
    told.select(F.lit(json.dumps(asdict(config))).alias("settings"), "results").coalesce(1).write.mode("errorifexists").json(f"{folder}/metrics_json")


def horizon_path(folder: str, horizon: int) -> str:
    return f"{folder.rstrip('/')}/horizon-{horizon}"


def load_model(path: str) -> PipelineModel | BoostedTrees:
    spark = SparkSession.active()
    exists = lambda p: (t := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(t)
    if not exists(path):
        raise FileNotFoundError(f"no model at {path}")
    return PipelineModel.load(path) if exists(f"{path}/metadata") else BoostedTrees.load(spark, path)


def local_time(text: str, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """A local TIMESTAMP_NTZ from ISO text: without an offset it is local already, with one it is converted."""
    if re.search(r"(?:Z|[+-]\d{2}:?\d{2})$", text):
        return to_local(F.lit(text).cast("timestamp"), zone)
    return F.lit(text).cast("timestamp_ntz")


def select_row(df: DataFrame, at: str | None, targets: list[str], ts: str = "ts", zone: str = "Asia/Ho_Chi_Minh") -> DataFrame:
    """The row at a time, or the latest one whose targets all exist; raises if there is none."""
    if at is not None:
        row = df.where(F.col(ts) == local_time(at, zone))
    else:
        row = df.dropna(subset=targets).orderBy(F.desc(ts)).limit(1)
    if row.isEmpty():
        raise ValueError(f"the table has no row at {at}" if at else "no row has all its targets")
    return row


def predict_row(row: DataFrame, folder: str, targets: dict[int, str]) -> DataFrame:
    """(horizon, prediction, actual, abs_error) for a row, one for each horizon's saved model; actual and error are null where the target isn't known."""
    parts = []
    for horizon, target in targets.items():
        scored = score(load_model(horizon_path(folder, horizon)), row)
        actual = F.col(f"`{target}`")
        parts.append(scored.select(F.lit(horizon).alias("horizon"), "prediction", actual.alias("actual"), F.abs(F.col("prediction") - actual).alias("abs_error")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
