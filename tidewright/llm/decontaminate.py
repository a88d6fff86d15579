"""Benchmark decontamination: a prefix-filtered join of item windows with the shingles of whole documents.

A window is `window` consecutive words of an item, or the whole of a shorter item. A window's set is that of its word
shingles (five words; as many as it has, if fewer). A document holds a window exactly if all its shingles stand there in
order, so one shingle is a sufficient prefix: the rarest, by frequency over all documents. Only that shingle is joined.
The length bound is that the window must fit between the document's ends around the match, the positional bound that
the shingle stands at its own place in the window; what passes is verified word by word over the window.

What goes to every task is a bitmap of shingle hashes with a fixed largest size. It only thins out what is joined: its
false matches fall away in the join, so a larger benchmark costs shuffle, not memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch, heat_join, nullable, without, written

#: Bytes of words, A-Z lower-cased; every other byte becomes a blank. Bytes beyond ASCII belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHINGLE, WINDOW = 5, 10
BASE = 0x9E3779B97F4A7C15
MOST_BITS = 27
#: Words of a long text are hashed in blocks of so many; bytes of a bitmap's page; matches that a task hands on at once.
BLOCK, PAGE, FLUSH = 1 << 15, 1 << 16, 20_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class ShingleHashes:
    """64-bit hashes of the shingles that start at each word, from running polynomial sums over a text's bytes."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n > len(self.powers):
            size = 1 << n.bit_length()
            step = np.full(size, BASE, np.uint64)
            back = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.powers, self.inverse = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)

    def __call__(self, words: list[bytes], size: int) -> np.ndarray:
        n = len(words) - size + 1
        parts = [np.empty(0, np.uint64)]
        for at in range(0, n, BLOCK):
            block = np.frombuffer(b" ".join(words[at : min(at + BLOCK, n) + size - 1]) + b" ", np.uint8)
            self._reach(len(block))
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * self.powers[: len(block)], out=total[1:])
            ends = np.flatnonzero(block == 32)
            starts = np.concatenate([[0], ends[: len(ends) - size] + 1])
            out = (total[ends[size - 1 :]] - total[starts]) * self.inverse[starts]
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            parts.append(out ^ (out >> np.uint64(32)))
        return np.concatenate(parts)


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, win, size, off, hash): each distinct window text of the items with its shingles, win being its words."""

    def work(batches):
        hashes = ShingleHashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                k = min(shingle, size)
                prints = hashes(words, k).view(np.int64).tolist() if words else []
                for at in range(len(words) - size + 1 if words else 0):
                    win = b" ".join(words[at : at + size]).decode()
                    rows += [(item, win, size, k, off, prints[at + off]) for off in range(size - k + 1)]
            if rows:
                names = ("item_id", "win", "size", "k", "off", "hash")
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield arrow_batch(None, len(rows), types, **dict(zip(names, zip(*rows, strict=True), strict=True)))

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(work, "item_id string, win string, size int, k int, off int, hash long")


def bitmap(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap over the hashes' low bits, at least 1024 bits for each up to 2^MOST_BITS in all, and how many of those bits it has."""
    n = hashes.count()
    bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(max(1, n) * 1024)))))
    byte = F.shiftright(F.col("hash").bitwiseAND((1 << bits) - 1), 3).cast("int")
    mask = F.expr("shiftleft(1, cast(hash & 7 as int))")
    set_bytes = hashes.groupBy(byte.alias("byte")).agg(F.bit_or(mask).alias("mask"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        page = np.zeros(PAGE, np.uint8)
        page[pdf["byte"].to_numpy() % PAGE] = pdf["mask"].to_numpy().astype(np.uint8)
        return pd.DataFrame({"page": pdf["byte"].iloc[:1] // PAGE, "bytes": [page.tobytes()]})

    # Tasks pack pages, 2^(MOST_BITS - 3) / PAGE of them at most, and only those come to the driver.
    out = np.zeros(max(PAGE, 1 << bits - 3), np.uint8)
    for page, packed in set_bytes.groupBy(F.floor(F.col("byte") / PAGE)).applyInPandas(pack, "page int, bytes binary").collect():
        out[page * PAGE : (page + 1) * PAGE] = np.frombuffer(packed, np.uint8)
    return out, bits


def probe(hashes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    low = hashes & np.uint64((1 << bits) - 1)
    return np.flatnonzero(table[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to docs' columns but text.

    A document word inside any occurrence of a window is hit. Null or empty text has no words, and an item without words
    no windows. Very long texts are searched as a whole. Items with equal windows all count. Rows that repeat a doc_id are
    judged each by its own text, a null doc_id as any other; repeated item rows count as one item. An empty benchmark leaves
    every document clean, and an empty table gives an empty one.
    Columns of docs named as an added one, as rid, hash, pos, lead or around, or with a leading underscore are dropped first.
    """
    docs = without(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "rid", "hash", "pos", "lead", "around")
    spark = docs.sparkSession
    wins = written(item_windows(benchmark, window, shingle), "item_windows")
    items = wins.select("win", "item_id").distinct()
    shingles = wins.select("win", "size", "k", "off", "hash").distinct()
    # How many words beside a shingle of k words its windows can cover: none, where the window is the shingle itself.
    reach = {r["k"]: r["size"] - r["k"] for r in shingles.groupBy("k").agg(F.max("size").alias("size")).collect()}
    sizes = sorted(reach)
    table, bits = bitmap(shingles.select("hash").distinct())
    sent = spark.sparkContext.broadcast((table, bits))

    def count(batches):
        # Frequencies of shingles that the benchmark may hold, over every document.
        hashes, (table, bits) = ShingleHashes(), sent.value
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for text in batch["text"]:
                words = words_of(text)
                for k in sizes:
                    own = hashes(words, k)
                    found.append(own[probe(own, table, bits)])
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"hash": values.view(np.int64), "freq": counts})

    texts = docs.select("text").where("text is not null")
    frequency = texts.mapInPandas(count, "hash long, freq long").groupBy("hash").agg(F.sum("freq").alias("freq"))
    ranked = shingles.join(frequency, "hash", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    rarest = ranked.groupBy("win", "size").agg(F.min_by(F.struct("k", "off", "hash", "freq"), F.struct("freq", "hash", "off")).alias("s"))
    prefixes = written(rarest.select("win", "size", "s.*"), "prefixes")
    prefix_table, prefix_bits = bitmap(prefixes.select("hash").distinct())
    sent_prefix = spark.sparkContext.broadcast((prefix_table, prefix_bits))
    names = [c for c in docs.columns if c != "text"]

    def match(batches):
        # One row for each document and one for each match, with the words around it that a window could cover.
        hashes, (table, bits), rid = ShingleHashes(), sent_prefix.value, TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            kept, ids, totals, rows = batch.select(names), [], [], []

            def matches():
                rids, prints, places, leads, around = zip(*rows, strict=True)
                none = pa.RecordBatch.from_arrays([pa.nulls(len(rows), c.type) for c in kept.columns], names=names)
                return arrow_batch(none, len(rows), types, rid=rids, n_words=None, hash=prints, pos=places, lead=leads, around=around)

            for text in batch.column("text").to_pylist():
                words, rid = words_of(text), rid + 1
                ids.append(rid)
                totals.append(len(words))
                for k in sizes:
                    own = hashes(words, k)
                    for at in probe(own, table, bits).tolist():
                        low = max(0, at - reach[k])
                        around = b" ".join(words[low : at + k + reach[k]]).decode()
                        rows.append((rid, int(own[at].astype(np.int64)), at, at - low, around))
                        if len(rows) == FLUSH:
                            yield matches()
                            rows = []
            if rows:
                yield matches()
            yield arrow_batch(kept, len(ids), types, rid=ids, n_words=totals, hash=None, pos=None, lead=None, around=None)

    schema = nullable(docs, names, "rid long, n_words long, hash long, pos long, lead long, around string")
    probed = written(docs.select(*names, "text").mapInArrow(match, schema), "matches")
    # A passage that very many documents hold is one key: such keys are broadcast.
    hits = heat_join(probed.where("hash is not null").select("rid", "hash", "pos", "lead", "around"), prefixes, ["hash"], "freq")
    # Length and position: the window starts off words before the match and must lie within the words around it.
    hits = hits.where("lead >= off")
    held = F.array_join(F.slice(F.split("around", " "), (F.col("lead") - F.col("off") + 1).cast("int"), F.col("size")), " ")
    found = written(hits.where(held == F.col("win")).select("rid", (F.col("pos") - F.col("off")).alias("start"), "size", "win").distinct(), "occurrences")
    spans = found.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    reached = F.max("end").over(W.partitionBy("rid").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    covered = spans.select("rid", "start", "end", reached.alias("before"))
    covered = covered.groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))))).alias("n_hit"))
    meets = found.select("rid", "win").distinct()
    named = heat_join(meets, written(items.join(meets.groupBy("win").agg(F.count(F.lit(1)).alias("n_docs")), "win"), "met_items"), ["win"], "n_docs").select("rid", "item_id").distinct()
    named = named.groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = probed.where("n_words is not null").join(covered, "rid", "left").join(named, "rid", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        *names, "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[p0 + 1:p0 + size], ' ') AS win FROM (
    SELECT item_id, words, least(10, len(words)) AS size, unnest(range(len(words) - least(10, len(words)) + 1)) AS p0 FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, p0, array_to_string(words[p0 + 1:p0 + size], ' ') AS win FROM (
    SELECT doc_id, words, size, unnest(range(len(words) - size + 1)) AS p0 FROM d, sizes WHERE len(words) >= size)
), found AS (SELECT p.doc_id, p.p0, p.size, w.item_id FROM places p JOIN windows w USING (size, win)),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + size)) AS pos FROM (SELECT DISTINCT doc_id, p0, size FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
