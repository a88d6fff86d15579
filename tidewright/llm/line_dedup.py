"""Line dedup over levelled sorted runs of line hashes.

The index is a small log-structured store. A run is a table of (h1, h2, n_docs, n_rows, max_doc), one row for each line
key, bucketed and sorted by the 128-bit key hash, one file for each bucket. Spark is told that such files keep their
order, so merging with a run neither shuffles nor sorts what is already indexed. Each new batch is reduced to such a
table itself, merge-anti-joins every run to find the keys not seen before, and adds those as its own run at level 0;
what it holds of known keys goes to the repeats. When a level has `fanout` runs they are merged to one run of the next
level. A key stands in one run at most. Replaced runs are deleted, files and all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, ascii_lower, heat_join, new_path, remove, without, written

KEY = ["h1", "h2"]
#: Spark takes a bucket for sorted only where this is set and the bucket is one file.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def key_hash(key: Column) -> tuple[Column, Column]:
    """128 bits, as two chained 64-bit hashes: at 10^13 lines a chance collision stays improbable."""
    return F.xxhash64(key), F.xxhash64(F.lit("line"), key)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of every line whose key is long enough; th tells rows that share a doc_id apart."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = key_hash(F.col("key"))
    return keyed.select("doc_id", "th", "pos", h1.alias("h1"), h2.alias("h2"))


@contextmanager
def sorted_runs(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ORDERED)
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


class LineRuns:
    """The store: `levels[i]` lists the run tables of level i, `repeats` the tables of further sightings of known keys."""

    def __init__(self, spark: SparkSession, id_type: T.DataType | None = None, fanout: int = 2):
        self.spark, self.id_type, self.fanout = spark, id_type or T.LongType(), fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root, self.name = new_path(spark, "line_runs"), f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = [[]]
        self.repeats: list[str] = []
        self.made = 0

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        with sorted_runs(self.spark):
            df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{self.made}").saveAsTable(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, f"{self.root}/{table.rsplit('_', 1)[1]}")

    def close(self) -> None:
        """Drops every table and deletes the store's folder."""
        for table in [*self.runs(), *self.repeats]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.levels, self.repeats = [[]], []
        remove(self.spark, self.root)

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def fresh(self, incoming: str) -> DataFrame:
        """The keys of a batch's table that no run holds yet."""
        runs = [self.spark.table(run).select(*KEY).hint("merge") for run in self.runs()]
        return reduce(lambda left, run: left.join(run, KEY, "left_anti"), runs, self.spark.table(incoming))

    def add(self, lines: DataFrame) -> None:
        """Indexes the occurrences (doc_id, h1, h2) of a batch. Batches must hold disjoint doc_ids."""
        batch = lines.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_rows"), F.max("doc_id").alias("max_doc"))
        incoming = self._write(batch)
        runs = self.runs()
        if not runs:
            self.levels[0].append(incoming)
            return
        self.levels[0].append(self._write(self.fresh(incoming)))
        rows = self.spark.table(incoming)
        known = [rows.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_semi") for run in runs]
        self.repeats.append(self._write(reduce(DataFrame.unionByName, known)))
        self._drop(incoming)
        self._compact()

    def _merged(self, tables: list[str]) -> DataFrame:
        """Runs share no key, so a full outer merge join of sorted runs is their union in order."""
        rest = ["n_docs", "n_rows", "max_doc"]

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            renamed = b.select(*KEY, *[F.col(c).alias(f"_{c}") for c in rest]).hint("merge")
            return a.join(renamed, KEY, "full").select(*KEY, *[F.coalesce(c, f"_{c}").alias(c) for c in rest])

        return reduce(two, [self.spark.table(t) for t in tables])

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(old)))
            for table in old:
                self._drop(table)
            level += 1

    def common_keys(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_rows, max_doc) of the keys that at least min_docs documents hold; n_rows counts their lines."""
        if not self.runs():
            return self.spark.createDataFrame([], T.StructType([T.StructField(n, T.LongType()) for n in (*KEY, "n_rows")] + [T.StructField("max_doc", self.id_type)]))
        base = reduce(DataFrame.unionByName, [self.spark.table(t) for t in self.runs()])
        if self.repeats:
            again = reduce(DataFrame.unionByName, [self.spark.table(t) for t in self.repeats])
            again = again.groupBy(*KEY).agg(F.sum("n_docs").alias("more_docs"), F.sum("n_rows").alias("more_rows"), F.max("max_doc").alias("later"))
            base = base.join(again, KEY, "left")
        else:
            base = base.withColumns({"more_docs": F.lit(0), "more_rows": F.lit(0), "later": F.col("max_doc")})
        total = lambda c: F.col(f"n_{c}") + F.coalesce(f"more_{c}", F.lit(0))
        return base.where(total("docs") >= min_docs).select(*KEY, total("rows").alias("n_rows"), F.greatest("max_doc", "later").alias("max_doc"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, n_batches: int = 4, fanout: int = 2) -> DataFrame:
    """All columns of docs, with n_lines, n_dropped and the kept text in text.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of min_chars code points or more
    that min_docs documents hold keeps its lines only in the documents with the largest doc_id that holds it. Ids may be
    of any ordered type. Null or empty text is one empty line, and its kept text is empty. A very long text is as any
    other: each of its lines is a row. Rows that share a doc_id count as one document. A row without doc_id keeps all its
    lines and counts for no key. Columns beside doc_id and text pass unchanged, but those named as an added one or with a
    leading underscore are dropped first. An empty table gives an empty one.

    Documents are dealt to the batches by hash of doc_id, so batches are even however ids are spread. Hashes of lines are
    written once and read by the index and by the last join; a line that stands in very many documents is broadcast there.
    """
    docs = without(docs, "n_lines", "n_dropped")
    spark = docs.sparkSession
    found = occurrences(docs.select("doc_id", "text"), min_chars)
    found = written(found.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int")), "line_hashes", ("batch",))
    store = LineRuns(spark, docs.schema["doc_id"].dataType, fanout)
    try:
        for i in range(n_batches):
            store.add(found.where(F.col("batch") == i).select("doc_id", *KEY))
        keys = written(store.common_keys(min_docs), "common_lines")
    finally:
        store.close()
    hits = heat_join(found.drop("batch"), keys, KEY, "n_rows").where("max_doc <> doc_id")
    drops = hits.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_drop"))
    joined = docs.withColumn("_key", F.xxhash64("text")).join(drops, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_th")), "left")
    joined = joined.withColumn("_lines", split_lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept_text = F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    out = joined.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.greatest(F.coalesce(F.size("_drop"), F.lit(0)), F.lit(0)).cast("long"),
        "text": F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept_text),
    })
    return out.select(*docs.columns, "n_lines", "n_dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line, translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
  LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), common AS (
  SELECT key, max(doc_id) AS max_doc FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL AND c.max_doc <> l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.key IS NULL OR c.max_doc = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key
GROUP BY l.doc_id
"""
