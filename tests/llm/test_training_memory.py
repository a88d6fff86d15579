"""What training takes of the driver's memory."""

import tracemalloc

import numpy as np
import pytest

from tidewright.llm import toxicity


def test_training_takes_little_memory():
    rng = np.random.default_rng(5)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(30_000)]
    texts = [" ".join(names[i] for i in rng.integers(0, len(names), 700)) for _ in range(600)]
    tracemalloc.start()
    toxicity.train(texts, np.arange(600) % 2, rounds=1, steps=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 110_000_000


@pytest.mark.parametrize("most", [7, 1 << 17])
def test_sums_in_blocks(monkeypatch, most):
    monkeypatch.setattr(toxicity, "ROWS_AT_ONCE", most)
    rng = np.random.default_rng(1)
    for index in (np.empty(0, np.int64), rng.integers(0, 9, 200), np.sort(rng.integers(0, 9, 200)), np.full(50, 3)):
        rows, source, times = rng.integers(0, 9, (40, 2)).astype(np.float32), rng.integers(0, 40, len(index)), rng.integers(0, 5, (len(index), 1)).astype(np.float32)
        want = np.zeros((12, 2), np.float32)
        np.add.at(want, index, rows[source] * times)
        assert np.array_equal(toxicity._sums(index, 12, source, times)(rows), want)
        want[:] = 0
        np.add.at(want, index, rows[source])
        assert np.array_equal(toxicity._sums(index, 12)(rows[source]), want)
