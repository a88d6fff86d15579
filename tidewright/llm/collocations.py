"""Collocations: phrases of two or three words that stand together more often than their parts.

Frequent words get numbers (a word below the least count is in no candidate); pieces break at all others. The numbers of
adjacent words, each four bytes, are packed into keys of fixed width. Tasks sort the keys of a block by radix, count runs
of equal ones and deal what is left to ranges of keys, as packed blocks rather than rows; each range is merged by
the same radix sort and run-length count. A key is one entry of a block however often it stands there, so no key is heavy.

Trigrams are counted only where both their bigrams may be frequent, by a bitmap of a bounded size; what it lets
through in error is too rare when counted. Parts are looked up by joins of the candidates with the counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import cumulated
from .common import arrow_batch, heat_join, written
from .decontaminate import bitmap, probe

LEAST = 10
TOP = 2000
#: So many languages, with two numbers each, may be broadcast; more are joined by shuffle.
MOST_LANGUAGES = 10_000
#: A shorter phrase goes if one around it is at least so frequent, in per cent.
SHARE = 50
#: Of the numbered words so many of the most frequent ones, of at most so many bytes each, go to every task; others are joined.
MOST_SENT, MOST_BYTES = 600_000, 64
#: Distinct words, and places of words, that a task holds before it hands them on.
MOST_HELD, BLOCK = 400_000, 1_000_000
#: Places of words for each range of keys, and documents whose keys set the ranges' bounds.
RANGE, SAMPLE = 1_000_000, 1000

#: A-Z in lower case; what ends a piece is a line feed, a tab is a blank.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def parts_of(text: bytes) -> list[bytes]:
    """The words of a text in order, with a line feed wherever a piece ends."""
    return [w for w in text.translate(CLEAN).replace(b"\n", b" \n ").split(b" ") if w]


def texts(batch: pa.RecordBatch):
    return zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)


def strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all pieces."""

    def count(batches):
        counts: dict[str, Counter] = defaultdict(Counter)

        def told():
            for lang, own in counts.items():
                own.pop(b"\n", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), strings(list(own)), pa.array(own.values(), pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in texts(batch):
                counts[lang].update(parts_of(text))
                if sum(map(len, counts.values())) > MOST_HELD:
                    yield from told()
        yield from told()

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def encoded(docs: DataFrame, words: DataFrame, most_sent: int, most_bytes: int) -> DataFrame:
    """(ids): each text as packed numbers of its words, 0 where a piece breaks. words: (id, lang, word, n).

    Words that aren't sent to the tasks are told by place and joined; a bitmap keeps those back that have no number at all.
    """
    spark = docs.sparkSession
    near = (F.col("id") <= most_sent) & (F.octet_length("word") <= most_bytes)
    sent: dict[str, dict[bytes, int]] = defaultdict(dict)
    table = words.where(near).select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow()
    for lang, word, i in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
        sent[lang][word] = i
    far = words.where(~near).select("lang", "word", "id", "n")
    # The hash of a word beside its language, as a task computes it.
    marks = bitmap(far.select(F.xxhash64(F.concat("lang", F.lit("\n"), "word")).alias("hash"))) if not far.isEmpty() else None
    shared = spark.sparkContext.broadcast((dict(sent), marks))

    def work(batches):
        (known, marks), rid = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, open_words = [], []
            for lang, text in texts(batch):
                rid += 1
                parts = parts_of(text)
                get = known.get(lang, {}).get
                ids = np.array([get(w, 0) for w in parts], "<u4")
                rows.append((rid, ids.tobytes()))
                if marks:
                    places = defaultdict(list)
                    for i in np.flatnonzero(ids == 0).tolist():
                        if parts[i] != b"\n":
                            places[parts[i]].append(i)
                    if places:
                        left = list(places)
                        start = lang.encode() + b"\n"
                        hashes = np.array([xxhash.xxh64_intdigest(start + w, 42) for w in left], np.uint64)
                        open_words += [(rid, lang, left[i].decode(), places[left[i]]) for i in probe(hashes, *marks)]
            types = [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.list_(pa.int32())]
            if rows:
                rids, ids = zip(*rows, strict=True)
                yield arrow_batch(None, len(rows), types, rid=rids, ids=ids, lang=None, word=None, places=None)
            for k in range(0, len(open_words), 50_000):
                rids, langs, names, places = zip(*open_words[k : k + 50_000], strict=True)
                yield arrow_batch(None, len(rids), types, rid=rids, ids=None, lang=langs, word=names, places=places)

    out = written(docs.mapInArrow(work, "rid long, ids binary, lang string, word string, places array<int>"), "encoded_words")
    base = out.where("ids is not null").select("rid", "ids")
    if not marks:
        return base.select("ids")
    more = heat_join(out.where("word is not null").select("rid", "lang", "word", "places"), far, ["lang", "word"], "n")
    more = more.groupBy("rid").agg(F.collect_list(F.struct("id", "places")).alias("more"))

    def patch(batches):
        for batch in batches:
            done = []
            for ids, found in zip(batch.column("ids").to_pylist(), batch.column("more").to_pylist(), strict=True):
                ids = np.frombuffer(ids, "<u4").copy()
                for x in found or []:
                    ids[x["places"]] = x["id"]
                done.append(ids.tobytes())
            yield arrow_batch(None, len(done), [pa.binary()], ids=done)

    return written(base.join(more, "rid", "left").select("ids", "more").mapInArrow(patch, "ids binary"), "patched_words")


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of 32-bit columns, most significant first: stable counting sorts by digits of 16 bits, last digit first."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (0, 16):
            digit = (column >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows in order and the sum of each one's weights (1 where none are given)."""
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new)
    if weights is None:
        sums = np.diff(np.append(starts, len(order)))
    else:
        sums = np.add.reduceat(weights[order], starts) if len(starts) else np.empty(0, np.int64)
    return [c[starts] for c in columns], sums.astype(np.int64)


def packed(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of four bytes a column that order as bytes as their columns do as numbers."""
    return np.ascontiguousarray(np.stack(columns, 1).astype(">u4")).view(f"S{4 * len(columns)}").ravel()


def unpacked(keys: bytes, size: int) -> list[np.ndarray]:
    return list(np.frombuffer(keys, ">u4").reshape(-1, size).astype(np.uint32).T)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two numbers."""
    x = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def grams_of(ids: np.ndarray, size: int, marks) -> list[np.ndarray]:
    """The columns of all keys of `size` numbers without a break; of three, those whose two bigrams the bitmap holds."""
    columns = [ids[i : len(ids) - size + 1 + i] for i in range(size)]
    whole = np.logical_and.reduce([c > 0 for c in columns])
    if marks and size == 3:
        pairs = np.zeros(max(0, len(ids) - 1), bool)
        pairs[probe(mixed(ids[:-1], ids[1:]), *marks)] = True
        whole &= pairs[:-1] & pairs[1:]
    return [c[whole] for c in columns]


def gram_counts(ids: DataFrame, size: int, least: int, n_ranges: int, marks=None, sample: int = SAMPLE) -> DataFrame:
    """(i1, .., f) of the keys of `size` adjacent numbers that stand at least `least` times."""
    spark = ids.sparkSession
    names = [f"i{k + 1}" for k in range(size)]
    shared = spark.sparkContext.broadcast(marks)

    def blocks(df: DataFrame, bounds: np.ndarray, step: int = 1) -> DataFrame:
        def work(batches):
            marks, held, n = shared.value, [], 0

            def told():
                keys, sums = run_lengths(grams_of(np.concatenate([*held, np.zeros(1, np.uint32)]), size, marks))
                keys, sums = packed(keys)[::step], sums[::step]
                cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                full = [(k, keys[a:b].tobytes(), sums[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                if full:
                    ranges, blocks, counts = zip(*full, strict=True)
                    yield arrow_batch(None, len(full), [pa.int32(), pa.binary(), pa.binary()], range=ranges, keys=blocks, counts=counts)

            for batch in batches:
                for one in batch.column("ids").to_pylist():
                    held += [np.frombuffer(one, "<u4"), np.zeros(1, np.uint32)]
                    n += len(held[-2])
                    if n >= BLOCK:
                        yield from told()
                        held, n = [], 0
            if held:
                yield from told()

        return df.mapInArrow(work, "range int, keys binary, counts binary")

    bounds = np.empty(0, f"S{4 * size}")
    if n_ranges > 1:
        # Bounds decide where a key is counted, never whether, so those of a bounded sample do.
        some = blocks(ids.sample(min(1.0, sample / max(1, ids.count())), seed=1), bounds, 8).collect()
        seen = np.unique(np.concatenate([bounds, *[np.frombuffer(r["keys"], f"S{4 * size}") for r in some]]))
        bounds = np.unique(seen[np.linspace(0, len(seen) - 1, n_ranges + 1).astype(int)[1:-1]]) if len(seen) else bounds

    def merge(table: pa.Table) -> pa.Table:
        keys = unpacked(b"".join(table.column("keys").to_pylist()), size)
        keys, sums = run_lengths(keys, np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64))
        kept = sums >= least
        return pa.table([*(pa.array(c[kept].astype(np.int64)) for c in keys), pa.array(sums[kept])], names=[*names, "f"])

    return blocks(ids, bounds).groupBy("range").applyInArrow(merge, ", ".join(f"{n} long" for n in [*names, "f"]))


def pair_marks(bigrams: DataFrame):
    """A bitmap of bounded size over the bigrams' hashes."""

    def work(batches):
        for batch in batches:
            hashes = mixed(batch.column("i1").to_numpy(), batch.column("i2").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["hash"])

    return bitmap(bigrams.select("i1", "i2").mapInArrow(work, "hash long"))


def _score(left: str, right: str) -> str:
    """Exact: counts of up to sixteen digits fit decimals of 38."""
    return f"(cast(1000000 as decimal(7, 0)) * (cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)))) div (cast({left} as decimal(16, 0)) * cast({right} as decimal(16, 0)))"


def mine_collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, most_sent: int = MOST_SENT, most_bytes: int = MOST_BYTES, range_size: int = RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    Texts are cut into pieces at stops and line ends, pieces into words at blanks and tabs, A-Z in lower case. a is how often
    a phrase stands in pieces, overlaps included, l and r how often the two sides of its weakest cut do, n all words
    of the language, and score a * a / (l * r) in millionths, rounded down; of equal cuts the first counts. A phrase inside a
    longer candidate with at least `share` per cent of its count is left out. Ranks go by score, then a, then phrase by bytes.

    Null and empty texts have no words, a null language is `und`. Very long texts and words count as a whole, repeated
    rows each, ids play no part; an empty table gives an empty one, and further columns of docs don't matter. most_sent, most_bytes and
    range_size bound what tasks hold and change no result.
    """
    rows = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = written(word_counts(rows), "word_counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = cumulated(counted.where(F.col("n") >= least), [F.desc("n"), "lang", "word"], F.lit(1))
    words = written(words.select((F.col("before") + 1).alias("id"), "lang", "word", "n"), "numbered_words")
    ids = encoded(rows, words, most_sent, most_bytes)
    n_ranges = max(1, (counted.agg(F.sum("n")).first()[0] or 0) // range_size)
    two = written(gram_counts(ids, 2, least, n_ranges), "bigrams")
    three = written(gram_counts(ids, 3, least, n_ranges, pair_marks(two)), "trigrams")
    word = lambda k: words.select(F.col("id").alias(f"i{k}"), *([F.col("lang")] if k == 1 else []), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}"))
    around = three.select(F.inline(F.array(F.struct("i1", "i2", "f"), F.struct(F.col("i2").alias("i1"), F.col("i3").alias("i2"), "f")))).groupBy("i1", "i2").agg(F.max("f").alias("most"))
    pairs = two.join(around, ["i1", "i2"], "left").where(F.coalesce(F.col("most") * 100 < F.col("f") * share, F.lit(True))).join(word(1), "i1").join(word(2), "i2")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r")).withColumn("score", F.expr(_score("l", "r")))
    side = lambda a, b: two.select(F.col("i1").alias(f"i{a}"), F.col("i2").alias(f"i{b}"), F.col("f").alias(f"f{a}{b}"))
    longer = three.withColumnRenamed("f", "a").join(side(1, 2), ["i1", "i2"]).join(side(2, 3), ["i2", "i3"]).join(word(1), "i1").join(word(2), "i2").join(word(3), "i3")
    longer = longer.withColumns({"s1": F.expr(_score("n1", "f23")), "s2": F.expr(_score("f12", "n3"))})
    first = F.col("s1") <= F.col("s2")
    longer = longer.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("n1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"))
    placed = cumulated(pairs.unionByName(longer), ["lang", F.desc("score"), F.desc("a"), "phrase"], F.lit(1))
    starts = written(placed.groupBy("lang").agg(F.min("before").alias("start")).join(totals, "lang"), "languages")
    ranked = placed.join(F.broadcast(starts) if starts.count() <= MOST_LANGUAGES else starts, "lang").withColumn("rank", F.col("before") - F.col("start") + 1)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), one AS (
  SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM pieces) GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang
), two AS (
  SELECT lang, g.x AS x, g.y AS y, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {'x': w[i], 'y': w[i + 1]})) AS g FROM pieces) GROUP BY ALL HAVING count(*) >= 10
), three AS (
  SELECT lang, g.x AS x, g.y AS y, g.z AS z, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {'x': w[i], 'y': w[i + 1], 'z': w[i + 2]})) AS g FROM pieces) GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT t.lang, x || ' ' || y AS phrase, 1 AS k, t.f AS a, p.f AS l, q.f AS r FROM two t JOIN one p USING (lang, x) JOIN (SELECT lang, x AS y, f FROM one) q USING (lang, y)
  WHERE NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND (h.x = t.x AND h.y = t.y) AND 100 * h.f >= 50 * t.f) AND NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND (h.y = t.x AND h.z = t.y) AND 100 * h.f >= 50 * t.f)
  UNION ALL SELECT t.lang, x || ' ' || y || ' ' || z, 1, t.f, p.f, q.f FROM three t JOIN one p USING (lang, x) JOIN (SELECT lang, x AS y, y AS z, f FROM two) q USING (lang, y, z)
  UNION ALL SELECT t.lang, x || ' ' || y || ' ' || z, 2, t.f, p.f, q.f FROM three t JOIN two p USING (lang, x, y) JOIN (SELECT lang, x AS z, f FROM one) q USING (lang, z)
), scored AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), weakest AS (
  SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM scored) WHERE i = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT r.lang, rank, phrase, a, l, r.r AS r, n, score FROM ranked r JOIN totals USING (lang) WHERE rank <= 2000
"""
