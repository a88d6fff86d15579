"""Places in a total order and exact quantiles, by ranges of the order rather than in one task."""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written
from .axis import join_on


def cumulated(df: DataFrame, order: list, weight: Column, name: str = "before") -> DataFrame:
    """Adds the sum of the weights of all rows that come earlier in the order.

    Rows are dealt to ranges of the order and summed up within each, after the ranges before. The ranges are written to the
    shared folder, as bounds sampled anew would not agree with the sums; one number a range comes to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(df.withColumn("_weight", weight.cast("long")).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = sorted(ranges.groupBy("_range").agg(F.sum("_weight").alias("n")).collect())
    first = spark.createDataFrame(list(zip([r["_range"] for r in sums], accumulate((r["n"] for r in sums), initial=0), strict=False)), "_range int, _first long")
    within = F.sum("_weight").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("_weight")
    return ranges.withColumn("_within", within).join(F.broadcast(first), "_range").withColumn(name, F.col("_first") + F.col("_within")).drop("_range", "_weight", "_first", "_within")


#: Rows of a group that may be ordered in one task's memory.
SMALL = 100_000
#: Value ranges for each doubling of a value, and a number above any range's.
PER_OCTAVE, NO_RANGE = 256, 1_000_000


def value_range(x: Column) -> Column:
    """The number of the range a double lies in, which never falls as the value rises: the logarithm is monotone in floating point too."""
    size = F.floor(F.ln(F.abs(x)) * (PER_OCTAVE / math.log(2))) + 1100 * PER_OCTAVE
    size = F.when(F.abs(x) == float("inf"), NO_RANGE - 1).otherwise(size)
    return F.when(x.isNull(), -NO_RANGE).when(F.isnan(x), NO_RANGE).when(x > 0, size).when(x < 0, -size).otherwise(0)


def largest_group(df: DataFrame, group: list[str]) -> int:
    """How many rows the largest group has, by one counting pass."""
    return df.groupBy(*[F.col(f"`{g}`") for g in group]).count().agg(F.max("count")).first()[0] or 0


def group_quantiles(df: DataFrame, group: list[str], value: Column, quantiles: tuple, name: str = "q", size: str = "n", most: int | None = None) -> DataFrame:
    """(group, n, q): for each group, null agreeing with null, the number of its values and their exact quantiles, between ranks in a line; null without values.

    Equal values of a group are counted first. Counts by value range say in which ranges the wanted ranks lie, and only
    the values of those ranges are put in order, each range by itself; so memory doesn't grow with a group, and a large group
    is several tasks. The counted values are shuffled once and read by both steps. Where the caller knows that no group has more than
    `most` rows and that is at most SMALL, each is ordered in its task's memory instead, with the same result and fewer stages.
    """
    if most is not None and most <= SMALL:
        few = df.select(*[F.col(f"`{g}`") for g in group], value.cast("double").alias("_x")).groupBy(*[F.col(f"`{g}`") for g in group])
        return few.agg(F.count("_x").alias(size), F.percentile("_x", F.array(*[F.lit(float(p)) for p in quantiles])).alias(name))
    key = F.struct(*[F.col(f"`{g}`") for g in group]) if group else F.struct(F.lit(0).alias("_none"))
    counted = df.select(key.alias("_g"), value.cast("double").alias("_x")).groupBy("_g", "_x").agg(F.count("_x").alias("_n")).withColumn("_r", value_range(F.col("_x")))
    ranges = counted.groupBy("_g", "_r").agg(F.sum("_n").alias("_rn"))
    w = W.partitionBy("_g")
    ranges = ranges.withColumns({"_before": F.sum("_rn").over(w.orderBy("_r")) - F.col("_rn"), "_total": F.sum("_rn").over(w)})
    spots = [(F.col("_total") - 1) * p for p in quantiles]
    ranks = [f(spot) for spot in spots for f in (F.floor, F.ceil)]
    holds = lambda first, n: reduce(lambda a, b: a | b, [(first <= k) & (k < first + n) for k in ranks])
    # The range of nulls stays for the groups that have nothing else.
    wanted = ranges.where(holds(F.col("_before"), F.col("_rn")) | (F.col("_r") == -NO_RANGE)).select("_g", "_r", "_before", "_total")
    placed = counted.join(wanted, ["_g", "_r"]).withColumn("_at", F.col("_before") + F.sum("_n").over(W.partitionBy("_g", "_r").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    at = lambda k: F.max(F.when((F.col("_at") <= k) & (k < F.col("_at") + F.col("_n")), F.col("_x")))
    found = placed.groupBy("_g", "_total").agg(*[f(spot).alias(f"_{side}{i}") for i, spot in enumerate(spots) for side, f in (("a", lambda x: at(F.floor(x))), ("b", lambda x: at(F.ceil(x))))])
    # Equal ends are taken as they are: infinite ones have no difference.
    line = [F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (spot - F.floor(spot))) for i, spot in enumerate(spots)]
    return found.select("_g.*", F.col("_total").alias(size), F.array(*line).alias(name)).drop("_none")


def exact_quantiles(df: DataFrame, columns: list[str], quantiles: tuple) -> DataFrame:
    """(variable, q): each column's exact quantiles, by group_quantiles()."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])))
    found = group_quantiles(long, ["variable"], F.col("value"), quantiles).select("variable", F.when(F.col("n") > 0, F.col("q")).alias("q"))
    return join_on(df.sparkSession.createDataFrame([(c,) for c in columns], "variable string"), found, ["variable"], "left")
