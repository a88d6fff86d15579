"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its character n-grams (hashed, with word ends marked), so a misspelling
or an inflection that was never seen shares most of its vector with the words it resembles. A window of words is the
mean of its words' vectors, and two linear outputs with a softmax turn it into a probability. A document is as toxic as
its most toxic window, so a few words count the same in a short text and in a very long one.

Averages and outputs are linear, so once trained a word's part in the difference of the two outputs is one number: the
mean of its n-grams' numbers. Only that table of one number for each n-gram bucket goes to the tasks.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, without

BUCKETS, DIM, NGRAMS = 1 << 20, 4, (3, 4, 5)
WINDOW, STEP = 8, 4
WORD, GAP = re.compile(r"\w+"), re.compile(r"\W")
#: A very long text is read in pieces of about so many characters, and scores are computed over about so many words at once. Neither changes a score.
PIECE, BLOCK = 1 << 20, 1 << 16
#: Words whose n-grams are found, and rows that are added up, at once in training. Neither changes a number.
WORDS_AT_ONCE, ROWS_AT_ONCE = 1 << 14, 1 << 17
#: Bounds of the training sample: documents of each label, and characters of a document, in excerpts of so many.
SAMPLE, SAMPLE_CHARS, EXCERPT = 1500, 16000, 1000
THRESHOLD = 0.5
#: Windows of a clean document that later rounds learn from, and the weight decay of the embeddings.
HARD, DECAY = 4, 1e-4
#: A window is averaged over WINDOW places, those past a short text's end being empty; the gain keeps embeddings small.
GAIN = np.float32(WINDOW)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (a power of two) of the n-grams of each word of `<word>`, all in one array, and the number of n-grams of each word (at least one)."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(chars))
    ids, owners = [], []
    rolling = np.zeros(len(chars), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        shifted = np.zeros(len(chars), np.uint64)
        shifted[: max(0, len(chars) - n + 1)] = chars[n - 1 :]
        rolling = (rolling ^ shifted) * MULTIPLIER
        if n in NGRAMS:
            # A mark alone with one character is the shortest word: its three characters are its only n-gram.
            inside = at + n <= ends
            ids.append((rolling[inside] ^ np.uint64(n)) >> np.uint64(64 - buckets.bit_length() + 1))
            owners.append(word[inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(ids)[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def all_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """ngram_buckets() of many words, block by block, as numbers of 32 bits."""
    parts = [ngram_buckets(words[k : k + WORDS_AT_ONCE]) for k in range(0, len(words), WORDS_AT_ONCE)]
    return tuple(np.concatenate([p[i].astype(np.int32) for p in parts]) for i in (0, 1))


def words_of(text: str) -> list[str]:
    """The words of a text, one for each run of equal words."""
    return runs_once(WORD.findall(text.lower()))


def runs_once(words: list[str]) -> list[str]:
    return [w for w, before in zip(words, [None, *words], strict=False) if w != before]


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over n words."""
    starts = np.arange(0, max(1, n - WINDOW + STEP), STEP)
    return starts, np.minimum(starts + WINDOW, n)


def train(texts: list[str], labels: np.ndarray, rounds: int = 10, steps: int = 20, rate: float = 0.1, seed: int = 7) -> tuple[np.ndarray, float]:
    """(number for each bucket, bias), trained by Adam on softmax cross-entropy.

    The first round takes all windows with their document's label, over the words that several documents hold. Later
    rounds take the window of each toxic document that scores highest so far, as the others need not be toxic, and the
    `HARD` highest of each clean one.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    tokens, doc_of, spans, base = array("i"), [], [], 0
    frequency: Counter = Counter()
    for d, text in enumerate(texts):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        if not ids:
            continue
        starts, ends = windows(len(ids))
        tokens.extend(ids)
        frequency.update(set(ids))
        spans.append(np.stack([starts, ends], axis=1) + base)
        doc_of.append(np.full(len(starts), d))
        base += len(ids)
    if not spans:
        return np.zeros(BUCKETS, np.float32), 0.0
    tokens, spans, doc_of = np.frombuffer(tokens, np.int32), np.concatenate(spans).astype(np.int32), np.concatenate(doc_of).astype(np.int32)
    common = np.fromiter((frequency[i] > 1 for i in range(len(vocabulary))), bool, len(vocabulary))
    grams, n_grams = all_buckets(list(vocabulary))
    gram_starts = np.cumsum(n_grams) - n_grams
    E = np.empty((BUCKETS, DIM), np.float32)
    for k in range(0, BUCKETS, ROWS_AT_ONCE):
        E[k : k + ROWS_AT_ONCE] = rng.normal(0, 0.1, E[k : k + ROWS_AT_ONCE].shape)
    seen = np.zeros(BUCKETS, bool)
    seen[grams] = True
    E[~seen] = 0
    W, b = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    y = labels[doc_of]

    def scores() -> np.ndarray:
        word = np.add.reduceat((E @ (W[:, 1] - W[:, 0]))[grams], gram_starts) / n_grams
        total = np.concatenate([[0.0], np.cumsum(word[tokens], dtype=np.float64)])
        return (total[spans[:, 1]] - total[spans[:, 0]]) * GAIN / WINDOW

    for r in range(rounds):
        if r:
            order = np.lexsort((-scores(), doc_of))
            first = np.flatnonzero(np.concatenate([[True], doc_of[order][1:] != doc_of[order][:-1]]))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            chosen = order[place < np.where(y[order] == 1, 1, HARD)]
        else:
            chosen = np.flatnonzero((spans[:, 0] - spans[np.searchsorted(doc_of, doc_of), 0]) % WINDOW == 0)
        lengths = spans[chosen, 1] - spans[chosen, 0]
        owner = np.repeat(np.arange(len(chosen), dtype=np.int32), lengths)
        word = tokens[_stretches(spans[chosen, 0], lengths)]
        if not r:
            owner, word = owner[common[word]], word[common[word]]
        # Windows as sparse rows of (window, word, share), words as sparse rows of n-grams.
        cell, count = np.unique(owner * np.int64(len(vocabulary)) + word, return_counts=True)
        win, word = (cell // len(vocabulary)).astype(np.int32), (cell % len(vocabulary)).astype(np.int32)
        share = (count / WINDOW).astype(np.float32)[:, None]
        del owner, cell, count
        there, word = _numbered(word, len(vocabulary))
        n = n_grams[there]
        used, mine = _numbered(grams[_stretches(gram_starts[there], n)], BUCKETS)
        part = (1 / n).astype(np.float32)[:, None]
        gram_word = np.repeat(np.arange(len(there), dtype=np.int32), n)
        in_window, in_word = _sums(win, len(chosen), word, share), _sums(gram_word, len(there), mine)
        to_word, to_gram = _sums(word, len(there), win, share), _sums(mine, len(used), gram_word)
        del win, word, mine, gram_word, share
        target = np.eye(2, dtype=np.float32)[y[chosen]]
        weight = (0.5 / np.maximum(1, np.bincount(y[chosen], minlength=2)))[y[chosen]].astype(np.float32)[:, None]
        params = [E[used], W, b]
        moments = [[np.zeros_like(v), np.zeros_like(v)] for v in params]
        for step in range(1, steps + 1):
            mean = in_window(in_word(params[0]) * part) * GAIN
            out = mean @ params[1] + params[2]
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d_out = (p - target) * weight
            d_word = to_word(d_out @ params[1].T) * part * GAIN
            grads = to_gram(d_word) + DECAY / len(used) * params[0], mean.T @ d_out, d_out.sum(axis=0)
            for k, (g, (m, v)) in enumerate(zip(grads, moments, strict=True)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[k] = params[k] - (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)).astype(np.float32)
        E[used], W, b = params
    table = E @ (W[:, 1] - W[:, 0])
    # The bias stands midway between what clean and toxic documents reach, each document by its highest window.
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, doc_of, scores())
    seen = np.isfinite(top)
    clean, toxic = top[seen & (labels == 0)], top[seen & (labels == 1)]
    if not len(clean) or not len(toxic):
        return table, float(b[1] - b[0])
    cuts = np.sort(np.concatenate([clean, toxic]))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    errors = (len(clean) - np.searchsorted(np.sort(clean), cuts)) / len(clean) + np.searchsorted(np.sort(toxic), cuts) / len(toxic)
    best = cuts[errors <= errors.min() + 1e-12]
    return table, float(-(best.min() + best.max()) / 2)


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of stretches one behind the other."""
    shift = (starts - (np.cumsum(lengths) - lengths)).astype(np.int32)
    return np.arange(lengths.sum(), dtype=np.int32) + np.repeat(shift, lengths)


def _numbered(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, all below `most`, in order, and the number of each value among them."""
    seen = np.zeros(most, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[values]


def _sums(index: np.ndarray, n: int, source: np.ndarray | None = None, times: np.ndarray | None = None) -> Callable:
    """A function that adds up, by index, to n rows, the rows that `source` names (all in turn without it), times a number each; a block of them at once."""
    if (index[1:] < index[:-1]).any():
        order = np.argsort(index, kind="stable").astype(np.int32)
        index, source, times = index[order], order if source is None else source[order], None if times is None else times[order]
    first = np.flatnonzero(np.concatenate([[len(index) > 0], index[1:] != index[:-1]])[: len(index)])
    there = index[first]
    # Blocks end where a sum does, so they change none.
    blocks = np.unique(np.searchsorted(first, np.arange(0, len(index), ROWS_AT_ONCE))).tolist() if len(first) else []
    spans = [(i, j, int(first[i]), int(first[j]) if j < len(first) else len(index)) for i, j in zip(blocks, [*blocks, len(first)][1:], strict=True) if i < j]

    def add(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((n, rows.shape[1]), np.float32)
        for i, j, a, b in spans:
            some = rows[a:b] if source is None else rows[source[a:b]]
            out[there[i:j]] = np.add.reduceat(some if times is None else some * times[a:b], first[i:j] - a)
        return out

    return add


class Scorer:
    """Scores texts with a trained table; remembers the numbers of words it has met, up to a bound."""

    def __init__(self, table: np.ndarray, bias: float, most: int = 500_000):
        self.table, self.bias, self.most, self.known = table, bias, most, {}

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        missing = [w for w in set(words) if w not in known]
        if missing:
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = list(set(words))
            grams, n = ngram_buckets(missing)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            known.update(zip(missing, (np.add.reduceat(self.table[grams], starts) / n).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def best(self, bags: list[list[str]]) -> np.ndarray:
        """The highest window of each bag of words; bags aren't empty."""
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        total = np.concatenate([[0.0], np.cumsum(self.numbers([w for bag in bags for w in bag]))])
        n_windows = np.maximum(1, -(-(sizes - WINDOW + STEP) // STEP))
        first = np.cumsum(n_windows) - n_windows
        owner = np.repeat(np.arange(len(bags)), n_windows)
        offsets = np.cumsum(sizes) - sizes
        starts = offsets[owner] + (np.arange(n_windows.sum()) - first[owner]) * STEP
        ends = np.minimum(starts + WINDOW, (offsets + sizes)[owner])
        return np.maximum.reduceat(total[ends] - total[starts], first) * GAIN / WINDOW

    def best_of_long(self, text: str) -> float:
        """The highest window of a text too long to be read at once: pieces end between words, and windows that a piece cuts short go on in the next."""
        text, at, best, carried = text.lower(), 0, -np.inf, []
        while at < len(text):
            gap = GAP.search(text, at + PIECE)
            end = gap.start() if gap else len(text)
            words = runs_once(carried[-1:] + WORD.findall(text, at, end))
            words = carried + words[1:] if carried else words
            at = end
            full = len(words) if at >= len(text) else max(0, (len(words) - WINDOW) // STEP + 1) * STEP + WINDOW - STEP
            # The last words are a window of their own only if no window ends with them.
            if full > WINDOW - STEP or (words and at >= len(text) and best == -np.inf):
                best = max(best, float(self.best([words[:full]])[0]))
                carried = words[full - (WINDOW - STEP) :]
            else:
                carried = words
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores to nine digits, so a text's score doesn't depend on those computed beside it."""
        best, bags, owners, size = np.full(len(texts), -np.inf), [], [], 0
        for i, text in enumerate(texts):
            if text and len(text) > PIECE:
                best[i] = self.best_of_long(text)
            elif text and (words := words_of(text)):
                bags.append(words)
                owners.append(i)
                size += len(words)
            if bags and (size >= BLOCK or i == len(texts) - 1):
                best[owners] = self.best(bags)
                bags, owners, size = [], [], 0
        return np.round(np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best + self.bias, -30, 30))), 0.0), 9)

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def excerpts(text: Column, chars: int) -> Column:
    """A text of at most `chars` characters as it is; of a longer one as many excerpts, picked by hash, in their order."""
    at = F.transform(F.sequence(F.lit(0), F.ceil(F.length(text) / EXCERPT).cast("int") - 1), lambda i: F.struct(F.xxhash64(F.length(text), i).alias("h"), i.alias("i")))
    picked = F.array_sort(F.transform(F.slice(F.array_sort(at), 1, max(1, chars // EXCERPT)), lambda x: x["i"]))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(F.transform(picked, lambda i: F.substring(text, i * EXCERPT + 1, F.lit(EXCERPT))), "\n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int) -> pd.DataFrame:
    """At most per_class labelled documents for each label, outside fold 0, with at most `chars` characters of each; doc_id, text and label.

    Taken by hash of doc_id, so every run takes the same ones; of label rows that disagree on a document the smaller label
    counts. Candidates come from labels alone, some more than needed as a few may lack a text, so texts are read once. Only
    if these don't suffice are labels first joined to the documents that have a text.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min(label).cast("long").alias("label"))
    order = [F.xxhash64("doc_id", F.lit("sample")), F.col("doc_id")]
    worded = docs.select("doc_id", "text").where(F.length("text") > 0)

    def drawn(known: DataFrame, most: int) -> tuple[list, pd.DataFrame]:
        """Two lists of at most `most` candidates, and the first per_class of each that have a text. Rows that share an id are one before they leave the tasks."""
        ids = [known.where(F.col("label") == v).orderBy(*order).limit(most).collect() for v in (0, 1)]
        chosen = docs.sparkSession.createDataFrame(sum(ids, []), known.schema)
        texts = worded.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(excerpts(F.col("text"), chars)).alias("text"), F.min("label").alias("label"))
        found = texts.withColumn("h", order[0]).toPandas().sort_values(["label", "h", "doc_id"])
        return ids, found.groupby("label", sort=False).head(per_class).drop(columns="h")

    ids, found = drawn(known, per_class + per_class // 4)
    if any((found["label"] == v).sum() < per_class < len(part) for v, part in enumerate(ids)):
        _, found = drawn(known.join(worded.select("doc_id"), "doc_id", "left_semi"), per_class)
    return found.sort_values("doc_id", ignore_index=True)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, chars: int = SAMPLE_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """Adds held_out, score and predicted to docs.

    The model is fitted on a bounded sample of the labelled rows outside fold 0 and scores every whole text; how a very
    long one is read in pieces changes no score. A text without words, null or empty, scores 0. Null ids are scored as any
    other and count as fold crc32('') mod 5. Equal texts have equal scores, so repeated rows do. Columns of docs named as
    an added one or with a leading underscore are replaced. An empty table gives an empty one. Without labelled rows every
    score is that of an untrained model, at most 0.5.
    """
    sample = labelled_sample(docs, labels, "toxic", per_class, chars)
    table, bias = train(sample["text"].tolist(), sample["label"].to_numpy(np.int64)) if len(sample) else (np.zeros(BUCKETS, np.float32), -1.0)
    sent = docs.sparkSession.sparkContext.broadcast((table, bias))
    return apply_scores(docs, lambda: Scorer(*sent.value), threshold)


def apply_scores(docs: DataFrame, scorer: Callable, threshold: float) -> DataFrame:
    """Adds held_out, score and predicted; scorer() makes what scores texts, once in each task."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer()
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()), dtype="float64")

    scored = F.pandas_udf(score, "double")
    out = without(docs, "held_out", "score", "predicted").withColumns({"held_out": crc_fold(F.col("doc_id")) == 0, "score": scored(F.col("text"))})
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).drop("text")


SQL = None
