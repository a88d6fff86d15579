"""Event ranks on more events than five digits number, and on many tasks."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators import quality


def made(spark, n, severity):
    return spark.range(n).select(
        F.lit("s").alias("series"), F.lit("x").alias("variable"), F.expr("timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, 0, cast(id as int))").alias("start"),
        severity.cast("int").alias("severity"), (F.xxhash64("id") % 50).cast("double").alias("score"))


def test_top_is_by_rank_beyond_five_digits(spark):
    ranked = spark.range(1, 100_101).select(F.format_string("E%05d", "id").alias("event_id"), F.when(F.col("id") <= 10_000, 2).otherwise(1).alias("severity"))
    assert sorted(r["event_id"] for r in quality.review_pick(ranked).collect()) == ["E00001", "E00002", "E00003", "E10001", "E10002", "E10003"]


def test_ranges_number_as_one_window(spark):
    found = made(spark, 3000, F.col("id") % 3 + 1)
    got = quality.ranked_events(found, ["series"])
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    one = W.orderBy(F.desc("severity"), F.desc("score"), "variable", "start", "series")
    want = found.withColumn("event_id", F.format_string("E%05d", F.row_number().over(one)))
    assert set(got.columns) == set(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_no_events(spark):
    assert quality.ranked_events(made(spark, 0, F.lit(1)), ["series"]).collect() == []
