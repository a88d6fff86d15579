"""Few rows are fitted in one job, with the trees that rounds give."""

import pytest
from pyspark.sql import functions as F

from tests.test_boosting import table
from tidewright.operators import boosting


@pytest.mark.parametrize("train", ["t", "true"])
def test_one_job_gives_the_trees_of_rounds(spark, monkeypatch, train):
    df, *_ = table(spark, 300, 1)
    config = boosting.LeafWise(trees=7, leaves=5, least_rows=5, patience=3, bins=16, rate=0.5)
    rounds, asked = boosting.round_of, []
    monkeypatch.setattr(boosting, "round_of", lambda *a: asked.append(1) or rounds(*a))
    fit = lambda: boosting.fit(df, ["a", "b", "c", "d"], ["y0", "y1"], F.expr(train), config)
    here = fit()
    assert not asked and all(m.trees for m in here)
    monkeypatch.setattr(boosting, "TASK", 100)
    assert fit() == here and asked
