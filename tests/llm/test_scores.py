"""Scores don't depend on how texts are read: in pieces of any size, beside other texts, whatever separates their words."""

import numpy as np
import pytest

from tidewright.llm import quality, toxicity

SEPARATORS = [" ", "\n", "\t", "  ", "-"]


def texts():
    rng = np.random.default_rng(3)
    made = [SEPARATORS[i % 5].join(f"w{k}" for k in rng.integers(0, 60, n)) for i, n in enumerate((1, 5, 7, 8, 9, 11, 12, 13, 16, 17, 30, 101, 200, 403))]
    return [None, "", " \n", *made, "a a a " * 50, "été d'hiver " * 30, "x" * 3000, "ΑΣ'Σ ΑΣ " * 20, "\n".join(made)]


@pytest.fixture(scope="module")
def scorer():
    return toxicity.Scorer(np.random.default_rng(5).normal(0, 0.2, toxicity.BUCKETS).astype(np.float32), 0.0)


def by_hand(scorer, text):
    words = toxicity.words_of(text or "")
    if not words:
        return 0.0
    numbers = scorer.numbers(words)
    best = max(numbers[a:b].sum() for a, b in zip(*toxicity.windows(len(words)), strict=True))
    return 1 / (1 + np.exp(-best * toxicity.GAIN / toxicity.WINDOW))


@pytest.mark.parametrize("piece", [1, 5, 40, 64, 97, 500, 1 << 20])
@pytest.mark.parametrize("block", [1, 50, 1 << 16])
def test_toxicity_scores_as_by_hand(monkeypatch, scorer, piece, block):
    want = [by_hand(scorer, t) for t in texts()]
    monkeypatch.setattr(toxicity, "PIECE", piece)
    monkeypatch.setattr(toxicity, "BLOCK", block)
    assert scorer.scores(texts()) == pytest.approx(want, abs=1e-9)


def test_marked_words_astride_a_cut(monkeypatch, scorer):
    """Eight marked words in text without blanks, wherever a piece ends."""
    table = np.zeros(toxicity.BUCKETS, np.float32)
    table[toxicity.ngram_buckets(["grobian"])[0]] = 4.0
    mine = toxicity.Scorer(table, -2.0)
    text = "\n".join(["plain"] * 3 + ["grobian", "x"] * 4 + ["plain", "words"] * 30)
    whole = mine.score(text)
    assert whole > 0.5
    for piece in range(1, 80):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert mine.score(text) == whole


def test_one_letter_text_scores():
    assert 0 <= toxicity.Scorer(np.zeros(toxicity.BUCKETS, np.float32), 0.0).score("a") <= 1


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(80)]
    good = [" ".join(rng.choice(words, rng.integers(3, 300))) for _ in range(30)]
    return quality.train([*good, *[t.upper() + "!!" for t in good]], np.repeat([1, 0], 30), steps=20)


def quality_by_hand(model, text):
    """One document by itself: its words split as a whole, each vector from its n-grams, attention written out."""
    words = (text or "").split()
    groups = [words[i : i + quality.PASSAGE] for i in range(0, len(words), quality.PASSAGE)]
    x = (quality.surface(groups) if groups else np.zeros((1, quality.N_SURFACE))) - model["mean"]
    x = x / model["std"]
    vectors = np.zeros((max(1, len(groups)), quality.DIM))
    for i, g in enumerate(groups):
        vectors[i] = np.mean([model["table"][quality.ngram_buckets([w], quality.BUCKETS)[0]].astype(float).mean(axis=0) for w in g], axis=0) * quality.GAIN
    h = np.tanh(x @ model["enc"] + vectors @ model["enc_w"] + model["enc_b"])
    e = (np.tanh(h @ model["V"]) / (1 + np.exp(-(h @ model["U"])))) @ model["a"]
    a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return 1 / (1 + np.exp(-((a @ h) @ model["c"] + model["c_b"][0])))


@pytest.mark.parametrize("piece", [1, 40, 333, 1 << 20])
@pytest.mark.parametrize("block", [1, 3, 2048])
def test_quality_scores_as_by_hand(monkeypatch, model, piece, block):
    want = [quality_by_hand(model, t) for t in texts()]
    monkeypatch.setattr(quality, "PIECE", piece)
    monkeypatch.setattr(quality, "BLOCK", block)
    scorer = quality.Scorer(model)
    assert scorer.scores(texts()) == pytest.approx(want, abs=1e-6)
    assert (scorer.scores(texts() * 2).reshape(2, -1) == scorer.scores(texts())).all()
    assert quality.Scorer(model, most=5).scores(texts()) == pytest.approx(want, abs=1e-6)
