"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, source mixing.

Each stage takes what its predecessor kept, written as Parquet in between, and all but the last return the columns of
documents. A stage's decision takes effect in what it returns.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import written
from tidewright.llm.decontaminate import contamination
from tidewright.llm.line_dedup import dedup_lines
from tidewright.llm.mixing import mix_sources
from tidewright.llm.simhash import simhash_groups
from tidewright.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Row numbers, 16 bytes each, that may be broadcast; more are joined by shuffle.
MOST_SENT = 500_000


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents with part and row, which tell every row apart and stay the same however often a stage reads its table.

    They are the row's file and place there, so a stage can drop rows by their numbers without moving texts. A table that
    was not read from files is written first.
    """
    try:
        return docs.select(*COLUMNS, F.xxhash64("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return numbered(written(docs.select(*COLUMNS), "stage_input"))


def by_number(rows: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    """The columns of documents of the rows whose numbers are (left_semi) or aren't (left_anti) in a written table."""
    small = numbers.count() <= MOST_SENT
    return rows.join(F.broadcast(numbers) if small else numbers, ["part", "row"], how).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it is fitted on labelled rows outside the held-out fold.

    Null and empty texts score 0 and stay, as do null ids; repeated rows share a score and go or stay together; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs.select(*COLUMNS), labels).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents or more hold but for the last one. Every document stays, with the text it has left.

    A null text becomes empty; a row without id keeps its lines; rows that share an id are one document here.
    """
    kept = dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each SimHash group the row with the smallest doc_id, null ids last; of equal ids the one whose text has the
    smallest hash, of equal rows one. Null and empty texts are one group."""
    rows = numbered(docs)
    groups = simhash_groups(rows.withColumn("key", F.xxhash64("text")), keep=["key", "part", "row"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "part", "row"))
    kept = written(groups.groupBy("root").agg(first.alias("c")).select("c.part", "c.row"), "kept_rows")
    return by_number(rows, kept, "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item. Each row is judged by its own text, whatever its id; null and empty texts stay."""
    rows = numbered(docs)
    judged = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return by_number(rows, written(judged.where("contaminated").select("part", "row"), "hit_rows"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix of what is left: how many words of each document are taken, and at which positions.

    A null text has no words and is taken never; null is a source of its own; repeated rows are documents of their own.
    """
    return mix_sources(docs.select(*COLUMNS))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("source mixing", mixing)]

#: A trained classifier and 64-bit hashes have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage_" + name.replace(" ", "_"))
    return docs
