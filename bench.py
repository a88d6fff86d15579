"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The driver's events span thirty days at every scale factor, so the two steps that have a published time are timed on
generated hours as well: clean_25y and model_ready_25y take 219,144 hours of one series (25 years), whose published times
are 30.4 s and 33.1 s; clean_25y_x10 takes ten such series. Each reads text or Parquet and computes every column.
"""

import json
import os
import sys
import time

from pyspark.sql import functions as F

from tidewright.operators import ingest
from tidewright.plans import catalog, pipeline
from tidewright.session import local_session
from tidewright.sources.shared import new_path

HEADLINE = [
    "rolling_24h", "densify_hours", "interpolate_short_gaps", "add_features", "assign_split", "scaled_features", "seasonal_robust_z", "flag_jump",
    "flag_events", "level_shift", "describe_vars", "acf_168", "feature_target_corr", "climatology", "pivot_year_month", "wind_rose", "sequence_windows"]
HOURS = 219_144
SPLITS = {"train": ("2019-01-01", "2036-12-31 23:00"), "val": ("2037-01-01", "2039-12-31 23:00"), "test": ("2040-01-01", "2043-12-31 23:00")}


def finish(*tables):
    for df in tables:
        df.write.format("noop").mode("overwrite").save()


def raw_hours(spark, series):
    """Text rows as a CSV file."""
    made = catalog.generated(spark, HOURS, series)
    text = made.select("series", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"), *[F.coalesce(F.col(v).cast("string"), F.lit("")).alias(n) for n, v in catalog.NAMES.items()])
    path = new_path(spark, "bench_raw")
    text.repartition(8).write.option("header", True).csv(path)
    return spark.read.schema(text.schema).option("header", True).csv(path)


def main():
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle_partitions=cpus)
    finish(catalog.QUERIES[catalog.FLAGSHIP](spark, sf_dir))
    took = {}

    def timed(name, work):
        began = time.time()
        work()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)

    for name in HEADLINE:
        timed(name, lambda name=name: finish(catalog.QUERIES[name](spark, sf_dir)))
    one, ten = raw_hours(spark, 1), raw_hours(spark, 10)
    folder = new_path(spark, "bench_clean")
    names = [v.name for v in ingest.WEATHER]

    def clean(raw, keep=False):
        result = pipeline.clean(raw, ["series"])
        if keep:
            result.clean.write.parquet(folder)
        finish(*([] if keep else [result.clean]), result.flags, result.report)

    def ready():
        rows, scaler, _ = pipeline.model_ready(spark.read.parquet(folder), ["series"], SPLITS, names)
        finish(rows)

    timed("clean_25y", lambda: clean(one, keep=True))
    timed("model_ready_25y", ready)
    timed("clean_25y_x10", lambda: clean(ten))
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
