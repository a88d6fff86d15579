"""Spelling variants: frequent words one letter apart, found by anagram keys.

A word's key is the sum of its letters' fifth powers, so words of the same letters share it, and words one letter apart
have keys that differ by one letter's power (added or removed) or by the difference of two (exchanged). Each word
lists its key less each of its letters. A reduced key that is itself the key of a word stands for a removal, one that two
keys share for an exchange; only words with such reduced keys go on. Their letter order is then verified by what is left
of the word at each place of that letter, so no two words are ever compared as a pair: words that leave the same at
the same place are an exchange group, of at most as many words as there are letters.

Words are numbered by count downwards, ties by code points, so a word's most frequent near word is the one with the least number.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import cumulated
from .common import arrow_batch, written

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as its variant.
TIMES = 5
#: A run loses a letter where this divides the checksum of its document and itself.
NOISE = 199
#: Keys are sums modulo this, which no word of usual length reaches.
MODULUS = 1 << 61
#: Of longer words a digest of what is left stands for it.
LONG_WORD = 64
#: Distinct words that a task counts before it hands them on.
MOST_HELD = 500_000

#: Latin-1 bytes: letters stay, A-Z in lower case, and all else is a blank.
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """The letter runs of a text as Latin-1, one byte a letter; other code points are no letters here."""
    return text.encode("latin-1", "replace").translate(KEEP).split()


def thinned(doc_id, run: bytes, start: int | None = None, noise: int = NOISE) -> bytes:
    """The run, less one letter where `noise` divides the checksum of `<doc_id>:<run>`. start: the checksum of the part before the run."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()) if start is None else start
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    at = h % len(run)
    return run if h % noise else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least: int, noise: int) -> DataFrame:
    """(word, n) over all documents, of words of at least `least` letters."""

    def count(batches):
        counts: Counter = Counter()

        def told():
            left = [(w.decode("latin-1"), n) for w, n in counts.items() if n > 0 and len(w) >= least]
            counts.clear()
            return arrow_batch(None, len(left), [pa.string(), pa.int64()], word=[w for w, _ in left], n=[n for _, n in left])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                # A letter can go but none can come, so shorter runs never become words.
                words = [w for w in runs_of(text or "") if len(w) >= least]
                counts.update(words)
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w in set(words):
                    if (less := thinned(doc_id, w, start, noise)) != w:
                        k = words.count(w)
                        counts[w] -= k
                        counts[less] += k
                if len(counts) > MOST_HELD:
                    yield told()
        yield told()

    return docs.select("doc_id", "text").where("text is not null").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def left_over(word: Column, at: Column) -> Column:
    """What is left of a word without its letter at a place (from 1); of long words a digest of it, behind a mark that no word holds."""
    rest = F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))
    return F.when(F.length(word) <= LONG_WORD, rest).otherwise(F.concat(F.lit("#"), F.sha2(rest.cast("binary"), 256)))


def whole(word: Column) -> Column:
    """A word as left_over() would give it, were it left of a word with one letter more."""
    return F.when(F.length(word) < LONG_WORD, word).otherwise(F.concat(F.lit("#"), F.sha2(word.cast("binary"), 256)))


def met_letters(words: DataFrame) -> DataFrame:
    """(id, word, letter, as_removal, as_exchange): the letters of words whose keys less that letter meet another word's key, or another key less a letter."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    key = F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: F.pmod(acc + power(c), F.lit(MODULUS)))
    keyed = words.select("id", "word", key.alias("key"), F.explode(F.array_distinct(letters)).alias("letter"))
    reduced = written(keyed.withColumn("less", F.pmod(F.col("key") - power(F.col("letter")), F.lit(MODULUS))), "reduced_keys")
    # Two letters of one key never leave the same, so rows of (less, key) stand for keys.
    shared = reduced.select("less", "key").distinct().groupBy("less").agg(F.count(F.lit(1)).alias("keys"))
    known = reduced.select(F.col("key").alias("less")).distinct().withColumn("is_key", F.lit(True))
    met = shared.join(known, "less", "left").select("less", F.col("is_key").isNotNull().alias("as_removal"), (F.col("keys") > 1).alias("as_exchange"))
    return reduced.join(met.where("as_removal or as_exchange"), "less").select("id", "word", "letter", "as_removal", "as_exchange")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words of a table (id, word) are one letter from each that has any, and the least id among them."""
    met = met_letters(words)
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.lit(1)) == F.col("letter"))
    spots = met.select("id", "word", "letter", "as_removal", "as_exchange", F.explode(places).alias("at"))
    # Of equal letters in a row any may go, with the same left over, so the first stands for all of them.
    first = F.col("as_removal") & ((F.col("at") == 1) | (F.substring(F.col("word"), F.col("at") - 1, F.lit(1)) != F.col("letter")))
    spots = written(spots.select("id", left_over(F.col("word"), F.col("at")).alias("rest"), "at", first.alias("as_removal"), "as_exchange"), "left_over")
    # At one place a group has one word for each letter at most.
    groups = spots.where("as_exchange").groupBy("rest", "at").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    exchanged = groups.select((F.size("ids") - 1).cast("long").alias("n_near"), F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b"), F.explode("ids").alias("id"))
    exchanged = exchanged.select("id", "n_near", F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("best"))
    pairs = spots.where("as_removal").select(F.col("id").alias("long_id"), "rest").join(words.select(F.col("id").alias("short_id"), whole(F.col("word")).alias("rest")), "rest")
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("long_id").alias("id"), F.lit(1).cast("long").alias("n_near"), F.col("short_id").alias("best")),
        F.struct(F.col("short_id").alias("id"), F.lit(1).cast("long").alias("n_near"), F.col("long_id").alias("best")))))
    return exchanged.unionByName(sides).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def with_roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(id, root) of a table (id, form) without cycles: forms followed to the last, twice as far each round."""
    for _ in range(rounds):
        onward = forms.select(F.col("id").alias("form"), F.col("form").alias("next"))
        forms = written(forms.join(onward, "form", "left").select("id", F.coalesce("next", "form").alias("form")), "roots")
    return forms.withColumnRenamed("form", "root")


def group_variants(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, times: int = TIMES, noise: int = NOISE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least `least` letters that stands `count` times or more.

    Words are runs of letters up to U+00FF, A-Z in lower case, less one letter where the noise says so. n_near counts words
    one insertion, removal or replacement away. A form is the most frequent of them, ties by code points, if it is at least
    `times` as frequent; forms are followed to the root, which for a word without form is itself.

    Null and empty texts have no words. Very long texts are read as a whole, and very long words are words; above LONG_WORD
    letters what is left of them is compared by SHA-256. Repeated rows count each, a null doc_id is an empty one in the
    checksum, an empty table gives an empty one, and further columns of docs play no part.
    """
    if times <= 1:
        raise ValueError("times must be over 1, as forms could go in circles")
    counted = written(word_counts(docs, least, noise).where(F.col("n") >= count), "frequent_words")
    words = written(cumulated(counted, [F.desc("n"), "word"], F.lit(1), "id"), "numbered_words")
    near = near_words(words.select("id", "word"))
    best = words.select(F.col("id").alias("best"), F.col("n").alias("best_n"))
    joined = words.join(near, "id", "left").join(best, "best", "left")
    is_form = F.col("best_n") >= F.col("n") * times
    joined = written(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form_id"), F.when(is_form, F.col("best_n")).alias("form_n")), "near_words")
    # Each step multiplies the count by `times`, which bounds the steps.
    most = words.agg(F.max("n")).first()[0] or count
    steps = math.ceil(math.log(max(most / count, times), times)) + 1
    roots = with_roots(joined.where("form_id is not null").select("id", F.col("form_id").alias("form")), math.ceil(math.log2(steps + 1)))
    names = words.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    out = joined.join(roots, "id", "left")
    for column, by in (("form", "form_id"), ("root", "root")):
        out = out.join(names.select(F.col("_id").alias(by), F.col("_word").alias(f"_{column}")), by, "left")
    return out.select("word", F.col("_form").alias("form"), F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), bits AS (
  SELECT doc_id, run, k, flatten(list_transform(flatten(list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)), lambda b: list_transform(range(8), lambda i: CAST((b >> CAST(i AS INT)) & 1 AS BIGINT)))) AS bits FROM runs
), sums AS (
  SELECT run, k, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384::BIGINT))) AS h FROM bits
), words AS (
  SELECT * FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM sums GROUP BY 1)
  WHERE length(word) >= 6 AND n >= 5
), spots AS (
  SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS place FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM spots a JOIN spots b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM spots s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM spots s JOIN words w ON s.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS place, form AS next FROM judged UNION ALL SELECT c.word, j.word, j.form FROM chain c JOIN judged j ON c.next = j.word
)
SELECT j.word, j.form, c.place AS root, j.n, CAST(j.n_near AS BIGINT) AS n_near, j.form_n FROM judged j JOIN chain c ON j.word = c.word AND c.next IS NULL
"""
