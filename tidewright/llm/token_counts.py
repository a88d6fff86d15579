"""Token counts from pre-token frequencies, for a sentencepiece BPE model.

No piece of such a model crosses a pre-token boundary (checked when the model is loaded), so a text's token count is
the sum, over its distinct pre-tokens, of frequency times pieces; ids are never made. A pre-token is a run of blanks with
the run of other characters after it, or a line feed.

Each document gives the frequencies of its pre-tokens. The distinct ones form a table in which the pieces of each are
counted once; it is joined to the frequencies, and the products are summed by document. As a shortcut, a table of
frequent pre-tokens, of a fixed number of entries and bytes, goes to every task and settles most frequencies in place, so
only the others take part in the join. It changes no count.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, heat_join, nullable, without, written

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
PRE_TOKEN = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
LIMIT = 4096


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def load(model: str | None):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model or default_model())
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if BLANK in piece.lstrip(BLANK) or ("\n" in piece and piece != "\n"):
            raise ValueError(f"piece {i} crosses a pre-token boundary")
    return sp


def pre_tokens(text: str) -> Counter:
    """Frequencies of a text's pre-tokens as the model sees it: a blank in front of a text that isn't empty, blanks written as U+2581."""
    if not text:
        return Counter()
    if "  " in text or BLANK in text or text[0] == " ":
        return Counter(PRE_TOKEN.findall(BLANK + text.replace(" ", BLANK)))
    # Without runs of blanks, each blank starts a pre-token.
    counts = Counter((BLANK + text.replace(" ", " " + BLANK).replace("\n", " \n ")).split(" "))
    counts.pop("", None)
    return counts


def pieces_of(sp, pre: list[str]) -> list[int]:
    """Pieces of each pre-token. The model puts a blank in front of whatever it encodes, so each is encoded behind a line feed, whose two pieces are then left out."""
    return [len(ids) - 2 for ids in sp.encode(["\n" + p for p in pre], num_threads=1)]


def with_pieces(pres: DataFrame, model: str | None) -> DataFrame:
    """Adds pieces to the columns of a table of distinct pre-tokens (pre)."""
    names = pres.columns

    def count(batches):
        sp = load(model)
        for batch in batches:
            yield arrow_batch(batch.select(names), batch.num_rows, [pa.int64()], pieces=pieces_of(sp, batch.column("pre").to_pylist()))

    return pres.mapInArrow(count, nullable(pres, names, "pieces long"))


def frequent(docs: DataFrame, model: str | None, known: int, known_bytes: int, sample: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens in about `sample` documents."""

    def local(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(pre_tokens(text))
            yield arrow_batch(None, len(counts), [pa.string(), pa.int64()], pre=list(counts), freq=list(counts.values()))

    texts = docs.select("text").where("text is not null").sample(min(1.0, sample / max(1, docs.count())), seed=1)
    summed = texts.mapInArrow(local, "pre string, freq long").where(F.octet_length("pre") <= known_bytes).groupBy("pre").agg(F.sum("freq").alias("freq"))
    top = summed.where("freq > 1").orderBy(F.desc("freq"), "pre").limit(known).select("pre").repartition(8)
    return {r["pre"]: r["pieces"] for r in with_pieces(top, model).collect()}


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, known: int = 300_000, known_bytes: int = 64, sample: int = 20_000) -> DataFrame:
    """The columns of docs without text, and n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null text counts as empty, which has no tokens. Very long texts are counted as a whole. Each row is counted by its own
    text, so repeated rows and null ids are rows as any other; an empty table gives an empty one. known and known_bytes
    bound the table sent to every task (pre-tokens of at most so many bytes, from about `sample` documents); what is not
    in it is joined, so these parameters change no result. In the join a pre-token that stands in very many documents is
    broadcast with its pieces instead. Columns of docs named as an added one or with a leading underscore are dropped first.
    """
    docs = without(docs, "n_bytes", "n_tokens", "over_limit")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frequent(docs, model, known, known_bytes, sample))
    names = [c for c in docs.columns if c != "text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def settle(batches):
        # A row's id is its task's partition and its place there: the same in every run of that task.
        pieces, rid = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, rest = [], []
            for text in batch.column("text").to_pylist():
                text, n, rid = text or "", 0, rid + 1
                for pre, freq in pre_tokens(text).items():
                    k = pieces.get(pre)
                    if k is None:
                        rest.append((rid, pre, freq))
                    else:
                        n += k * freq
                rows.append((rid, len(text.encode()), n))
            kept = batch.select(names)
            if rows:
                rids, sizes, sums = zip(*rows, strict=True)
                yield arrow_batch(kept, len(rows), types, _rid=rids, n_bytes=sizes, _n=sums, _pre=None, _freq=None)
            for i in range(0, len(rest), 50_000):
                rids, pres, freqs = zip(*rest[i : i + 50_000], strict=True)
                none = pa.RecordBatch.from_arrays([pa.nulls(len(rids), f.type) for f in kept.schema], names=names) if names else None
                yield arrow_batch(none, len(rids), types, _rid=rids, n_bytes=None, _n=None, _pre=pres, _freq=freqs)

    settled = written(docs.select(*names, "text").mapInArrow(settle, nullable(docs, names, "_rid long, n_bytes long, _n long, _pre string, _freq long")), "settled_tokens")
    rest = settled.where("_pre is not null").select(F.col("_rid").alias("rid"), F.col("_pre").alias("pre"), F.col("_freq").alias("freq"))
    # Each distinct pre-token once, with the number of documents that hold it.
    table = with_pieces(rest.groupBy("pre").agg(F.count(F.lit(1)).alias("n_docs")), model)
    # Keys of the join are short: only the pre-token that is a line feed holds one, so no digest is taken for a pre-token.
    key = F.when(F.octet_length("pre") <= 256, F.col("pre")).otherwise(F.concat(F.lit("\n"), F.sha2(F.col("pre").cast("binary"), 256))).alias("key")
    table = written(table.select(key, "pieces", "n_docs"), "pre_token_pieces")
    more = heat_join(rest.select("rid", key, "freq"), table, ["key"], "n_docs").groupBy(F.col("rid").alias("_rid")).agg(F.sum(F.col("freq") * F.col("pieces")).alias("_more"))
    out = settled.where("_pre is null").join(more, "_rid", "left").withColumn("n_tokens", F.col("_n") + F.coalesce("_more", F.lit(0)))
    return out.select(*names, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs)


SQL = None
