"""Mixing sources to target weights, as a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]. Its integral gives the source's token target, its
running integral the cumulative demand. A document copy takes an interval of its source's token stream; inverting the
demand at the interval's middle gives the training position t. Documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, written

#: Weights, dealt in this order to the sources sorted by code point, null last.
WEIGHTS = (5, 2, 1)
#: Slope of each schedule, dealt alike: weight(t) = w * (1 + slope * (2t - 1)), so its integral over [0, 1] is w.
SLOPES = (-0.5, 0.0, 0.5)
MOST_PASSES = 3


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS + "+"))).cast("long")


def dealt(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), ((rank - 1) % len(values) + 1).cast("int"))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size) to (sid, source, source_size, weight, slope, target).

    Water-filling: with sources in the order of cap / weight, a source is capped if the level that all up to it leave
    is above its own cap / weight. The windows see one row for each source.
    """
    ranked = sources.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumns({"weight": dealt(weights, F.col("sid")).cast("long"), "slope": dealt(slopes, F.col("sid")), "cap": F.col("source_size") * most})
    total = W.partitionBy()
    ranked = ranked.withColumns({"all_size": F.sum("source_size").over(total), "all_weight": F.sum("weight").over(total)})
    before = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    ranked = ranked.withColumn("capped", F.col("cap") * (F.col("all_weight") - F.col("weight_before")) < (F.col("all_size") - F.col("cap_before")) * F.col("weight"))
    left = F.col("all_size") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(total)
    weight_left = F.col("all_weight") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(total)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((left * F.col("weight")).cast("double") / weight_left.cast("double"))
    return ranked.select("sid", "source", "source_size", "weight", "slope", target.alias("target"))


def position(share: Column, slope: Column) -> Column:
    """Inverse of the cumulative demand (1 - slope) t + slope t^2."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / F.when(slope != 0, 2 * slope))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST_PASSES, slice_digits: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, positions), one row for each document, range-sorted by first position.

    A document's copies follow its source's order by md5 of (doc_id, size); the last pass ends at the target, within a
    document if need be, so a source's taken words are its rounded target. positions holds one training position for
    each copy taken (none where nothing is taken; such rows sort last).
    Running sums are taken within slices of a source (the first digits of that md5) and over the slices' sums, so no
    task holds a whole source. Null text has size 0; null is a source of its own, after all others; rows that repeat a
    doc_id are documents of their own; an empty table gives an empty mix. Other columns are not read.
    """
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("key", key), "mix_sizes")
    sources = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, slopes, most), "mix_sources")
    plan = sources.withColumnRenamed("source", "_source")
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["_source"])).drop("_source").withColumn("slice", F.substring("key", 1, slice_digits))
    sums = rows.groupBy("sid", "slice").agg(F.sum("size").alias("slice_size"))
    sums = sums.select("sid", "slice", (F.sum("slice_size").over(W.partitionBy("sid").orderBy("slice")) - F.col("slice_size")).alias("slice_before"))
    rows = rows.withColumn("within", F.sum("size").over(W.partitionBy("sid", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(sums, ["sid", "slice"])
    before = F.col("slice_before") + F.col("within")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rows = rows.withColumns({"before": before, "goal": goal, "passes": passes})
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("passes") * F.col("source_size") - F.col("before")))
    rows = rows.withColumn("extra", extra.cast("long"))
    copies = F.col("passes") + (F.col("extra") > 0).cast("long")
    middle = lambda k: (k * F.col("source_size") + F.col("before") + F.when(k < F.col("passes"), F.col("size")).otherwise(F.col("extra")) / 2) / F.greatest("goal", F.lit(1))
    spots = F.when((copies > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), lambda k: position(middle(k), F.col("slope")))).otherwise(F.array().cast("array<double>"))
    mixed = written(rows.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"), spots.alias("positions")), "mix_rows")
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    return mixed.repartitionByRange(first, F.col("doc_id")).sortWithinPartitions(first, F.col("doc_id"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken, (doc_id, source, size, pass, position), range-sorted by position."""
    copies = mixed.select("doc_id", "source", "size", F.posexplode("positions").alias("pass", "position"))
    return copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """positions lists a document's training positions, in parts of 10^9, comma-joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    places = F.transform("positions", lambda x: F.floor(x * 1e9).cast("string"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", F.array_join(places, ",").alias("positions"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), keyed AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)) AS key FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CAST(CASE (sid - 1) % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0 ELSE 0.5 END AS DOUBLE) AS slope, 3 * source_size AS cap FROM sources
), run AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, cap * (all_weight - weight_before) < (all_size - cap_before) * weight AS is_capped FROM run
), targets AS (
  SELECT source, source_size, slope, CASE WHEN is_capped THEN CAST(cap AS DOUBLE) ELSE
    CAST((all_size - sum(CASE WHEN is_capped THEN cap ELSE 0 END) OVER ()) * weight AS DOUBLE) / CAST(all_weight - sum(CASE WHEN is_capped THEN weight ELSE 0 END) OVER () AS DOUBLE) END AS target
  FROM capped
), placed AS (
  SELECT k.doc_id, k.key, k.size, t.source_size, t.target, t.slope, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
    CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS BIGINT) AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM placed
), extended AS (
  SELECT *, greatest(0, least(size, goal - passes * source_size - before)) AS extra FROM passed
), copied AS (
  SELECT *, unnest(CASE WHEN size > 0 THEN range(passes + CASE WHEN extra > 0 THEN 1 ELSE 0 END) ELSE [] END) AS k FROM extended
), shared AS (
  SELECT doc_id, key, size, k, slope, (CAST(k * source_size + before AS DOUBLE) + CAST(CASE WHEN k < passes THEN size ELSE extra END AS DOUBLE) / 2) / CAST(greatest(goal, 1) AS DOUBLE) AS share FROM copied
), located AS (
  SELECT doc_id, key, size, k, CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END AS position FROM shared
), listed AS (
  SELECT doc_id, key, size, string_agg(CAST(CAST(floor(position * 1e9) AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS positions FROM located GROUP BY doc_id, key, size
)
SELECT e.doc_id, e.size, source_size, target, CAST(passes * e.size + extra AS BIGINT) AS taken, coalesce(positions, '') AS positions
FROM extended e LEFT JOIN listed l ON e.doc_id = l.doc_id AND e.key = l.key
"""
