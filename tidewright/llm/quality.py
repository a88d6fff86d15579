"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (64 words each, over the whole text). What is known of a passage is the mean of its
words' embeddings, each the mean of its hashed character n-grams', and the shares of its characters' kinds and its
words' repetition. A learned tanh layer encodes both; gated attention weights the passages, and the weighted mean of
their encodings is scored by a logistic output. Embeddings, encoder, attention and output are trained together in numpy
from document labels alone, so the attention learns which passages decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .toxicity import _sums, apply_scores, labelled_sample, ngram_buckets

PASSAGE = 64
HIDDEN, GATE = 24, 12
#: Buckets of n-grams and length of their embeddings; the gain keeps embeddings small.
BUCKETS, DIM, GAIN = 1 << 16, 8, np.float32(8)
#: Words that so many sampled documents hold are learned from.
COMMON = 3
#: Bounds of the training sample: documents of each label, and characters of a document.
SAMPLE, SAMPLE_CHARS = 1000, 12000
THRESHOLD = 0.3
#: A very long text is split in pieces of about so many characters, and about so many passages are encoded at once. Neither changes a score.
PIECE, BLOCK = 1 << 20, 2048
SPACE = re.compile(r"\s")

#: Kinds of characters: lower, upper, digit, blank, other white space, each ASCII mark by itself, other ASCII, then letters beyond ASCII by case.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KIND = np.full(128, 5 + len(MARKS), np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[32], KIND[[9, 10, 11, 12, 13]] = 0, 1, 2, 3, 4
KIND[[ord(c) for c in MARKS]] = 5 + np.arange(len(MARKS))
UPPER_BEYOND = KIND.max() + 1
N_KINDS = int(UPPER_BEYOND) + 2
N_SURFACE = N_KINDS + 5


def kinds(chars: np.ndarray) -> np.ndarray:
    """Kind of each code point. Upper case beyond ASCII is taken from the Latin-1, Greek and Cyrillic capitals' ranges."""
    upper = ((chars >= 0xC0) & (chars <= 0xDE)) | ((chars >= 0x391) & (chars <= 0x3A9)) | ((chars >= 0x400) & (chars <= 0x42F))
    return np.where(chars < 128, KIND[np.minimum(chars, 127)], np.where(upper, UPPER_BEYOND, UPPER_BEYOND + 1))


def passages(text: str) -> Iterator[list[list[str]]]:
    """The words of a text in passages of PASSAGE, some at a time."""
    at, carried = 0, []
    while at < len(text):
        space = SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = space.start() if space else len(text)
        words, at = carried + text[at:end].split(), end
        full = len(words) if at >= len(text) else len(words) // PASSAGE * PASSAGE
        carried = words[full:]
        yield [words[i : min(i + PASSAGE, full)] for i in range(0, full, PASSAGE)]


def surface(groups: list[list[str]]) -> np.ndarray:
    """(passages, N_SURFACE): roots of the shares of each kind of character, and figures of the words' repetition and length."""
    joined = [" ".join(g) for g in groups]
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    chars = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    cell = np.repeat(np.arange(len(joined)), lengths) * N_KINDS + kinds(chars)
    shares = np.bincount(cell, minlength=len(joined) * N_KINDS).reshape(-1, N_KINDS) / lengths[:, None]
    n = np.fromiter(map(len, groups), np.float64, len(groups))
    distinct = np.fromiter((len(set(g)) for g in groups), np.float64, len(groups))
    twice = np.fromiter((sum(map(str.__eq__, g, g[1:])) for g in groups), np.float64, len(groups))
    extra = np.stack([distinct / n, twice / n, np.log((lengths + 1) / n), n / PASSAGE, np.log(distinct)], axis=1)
    return np.concatenate([np.sqrt(shares), extra], axis=1)


def forward(p: dict, x: np.ndarray, words: np.ndarray, bags: np.ndarray, starts: np.ndarray) -> dict:
    """Encodings, attention and document scores; rows of x and words are passages, bags their documents, starts each document's first."""
    h = np.tanh(x @ p["enc"] + words @ p["enc_w"] + p["enc_b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["a"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bags])
    a = e / np.add.reduceat(e, starts)[bags]
    z = np.add.reduceat(a[:, None] * h, starts)
    out = z @ p["c"] + p["c_b"]
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(out, -30, 30)))}


def train(texts: list[str], labels: np.ndarray, steps: int = 120, rate: float = 0.02, seed: int = 7) -> dict:
    """Parameters, by full-batch Adam on cross-entropy in which both labels weigh the same. Texts hold a word each."""
    bags = [[g for part in passages(t) for g in part] for t in texts]
    groups = [g for bag in bags for g in bag]
    size = np.array([len(b) for b in bags])
    owner, starts = np.repeat(np.arange(len(bags)), size), np.cumsum(size) - size
    x = surface(groups).astype(np.float32)
    mean, std = x.mean(axis=0), x.std(axis=0) + 0.02
    x = (x - mean) / std
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    p = {"enc": draw(N_SURFACE, HIDDEN), "enc_w": draw(DIM, HIDDEN), "enc_b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "c_b": np.zeros(1, np.float32)}
    # Passages as sparse rows of (passage, word, share), words as sparse rows of n-grams.
    held = Counter(w for bag in bags for w in {w for g in bag for w in g})
    vocabulary = {w: i for i, w in enumerate(w for w, n in held.items() if n >= COMMON)}
    lengths = np.fromiter(map(len, groups), np.int64, len(groups))
    ids = np.fromiter((vocabulary.get(w, -1) for g in groups for w in g), np.int64, lengths.sum())
    at = np.repeat(np.arange(len(groups)), lengths)[ids >= 0]
    cell, count = np.unique(at * max(1, len(vocabulary)) + ids[ids >= 0], return_counts=True)
    passage, word = cell // max(1, len(vocabulary)), cell % max(1, len(vocabulary))
    share = (GAIN * count / lengths[passage]).astype(np.float32)[:, None]
    grams, n_grams = ngram_buckets(list(vocabulary), BUCKETS) if vocabulary else (np.empty(0, np.int64), np.empty(0, np.int64))
    used, mine = np.unique(grams, return_inverse=True)
    part = (1 / n_grams).astype(np.float32)[:, None]
    to_passage, to_word, in_word, to_gram = _sums(passage, len(groups)), _sums(word, len(vocabulary)), _sums(np.repeat(np.arange(len(vocabulary)), n_grams), len(vocabulary)), _sums(mine, len(used))
    p["E"] = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    for step in range(1, steps + 1):
        words = to_passage((in_word(p["E"][mine]) * part)[word] * share)
        s = forward(p, x, words, owner, starts)
        d = ((s["p"] - labels) * weight).astype(np.float32)
        dz = d[:, None] * p["c"]
        h, a = s["h"], s["a"]
        da = (dz[owner] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[owner])
        dtg = de[:, None] * p["a"]
        dt, dg = dtg * s["g"] * (1 - s["t"] ** 2), dtg * s["t"] * s["g"] * (1 - s["g"])
        dh = a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T
        dh *= 1 - h**2
        d_word = to_word((dh @ p["enc_w"].T)[passage] * share) * part
        grads = {
            "enc": x.T @ dh, "enc_w": words.T @ dh, "enc_b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ d, "c_b": d.sum(keepdims=True),
            "E": to_gram(np.repeat(d_word, n_grams, axis=0))}
        for k, g in grads.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[k] -= (rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + (0.02 if k == "E" else 1e-3) * p[k])).astype(np.float32)
    table = np.zeros((BUCKETS, DIM), np.float32)
    table[used] = p.pop("E")
    return p | {"mean": mean, "std": std, "table": table}


class Scorer:
    """Scores texts with a trained model; remembers the vectors of words it has met, up to a bound."""

    def __init__(self, model: dict | None, most: int = 200_000):
        self.model, self.most, self.known, self.vectors = model and {k: v.astype(np.float64) for k, v in model.items()}, most, {}, np.zeros((0, DIM))

    def words(self, groups: list[list[str]]) -> np.ndarray:
        """The mean vector of each passage's words."""
        flat = [w for g in groups for w in g]
        missing = [w for w in dict.fromkeys(flat) if w not in self.known]
        if missing:
            if len(self.known) + len(missing) > self.most:
                self.known, self.vectors, missing = {}, self.vectors[:0], list(dict.fromkeys(flat))
            grams, n = ngram_buckets(missing, BUCKETS)
            self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing)), strict=True))
            self.vectors = np.concatenate([self.vectors, np.add.reduceat(self.model["table"][grams], np.cumsum(n) - n) / n[:, None]])
        ids = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = np.fromiter(map(len, groups), np.int64, len(groups))
        return np.add.reduceat(self.vectors[ids], np.cumsum(lengths) - lengths) * GAIN / lengths[:, None]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores to nine digits, so a text's score doesn't depend on those computed beside it. A text without words is a bag of one passage of nothing."""
        out = np.full(len(texts), 0.5)
        if self.model is None:
            return out
        waiting, encoded, sizes, first = [], [], [], 0

        def encode() -> None:
            if waiting:
                encoded.append(np.concatenate([(surface(waiting) - self.model["mean"]) / self.model["std"], self.words(waiting)], axis=1))
                waiting.clear()

        for i, text in enumerate(texts):
            sizes.append(0)
            for part in passages(text or ""):
                sizes[-1] += len(part)
                for at in range(0, len(part), BLOCK):
                    waiting += part[at : at + BLOCK]
                    if len(waiting) >= BLOCK:
                        encode()
            if not sizes[-1]:
                encode()
                encoded.append(np.concatenate([-self.model["mean"] / self.model["std"], np.zeros(DIM)])[None])
                sizes[-1] = 1
            if sum(map(len, encoded)) >= BLOCK or i == len(texts) - 1:
                encode()
                both, size = np.concatenate(encoded), np.array(sizes)
                found = forward(self.model, both[:, :N_SURFACE], both[:, N_SURFACE:], np.repeat(np.arange(len(size)), size), np.cumsum(size) - size)
                out[first : i + 1] = found["p"]
                encoded, sizes, first = [], [], i + 1
        return np.round(out, 9)

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, chars: int = SAMPLE_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """Adds held_out, score (higher: quality 1 likelier) and predicted to docs.

    Fitted on a bounded sample of the labelled rows outside fold 0, and scores every whole text; how a very long one is
    read in pieces changes no score. A text without words, null or empty, is one passage of nothing and has that passage's
    score. Null ids are scored as any other and count as fold crc32('') mod 5. Equal texts have equal scores, so repeated
    rows do. Columns of docs named as an added one or with a leading underscore are replaced. An empty table gives an
    empty one. Without labelled rows every score is 0.5.
    """
    sample: pd.DataFrame = labelled_sample(docs, labels, "quality", per_class, chars)
    sample = sample[sample["text"].map(lambda t: bool(t.split()))]
    model = train(sample["text"].tolist(), sample["label"].to_numpy(np.int64)) if len(sample) else None
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return apply_scores(docs, lambda: Scorer(sent.value), threshold)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


SQL = None
