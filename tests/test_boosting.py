"""Leaf-wise boosting against a plain version on one machine, and its stops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import boosting
from tidewright.operators.boosting import LeafWise


def table(spark, n=900, parts=5):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 4)).round(2)
    y0 = np.where(x[:, 0] > 0.3, 4.0, -1.0) + x[:, 1] ** 2 + rng.normal(size=n) * 0.1
    y1 = 3 * x[:, 2] + np.where(x[:, 3] > 1, 5.0, 0.0)
    rows = [(*map(float, a), float(b), float(c), i % 4 != 0) for i, (a, b, c) in enumerate(zip(x, y0, y1, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y0 double, y1 double, t boolean").repartition(parts), x, np.stack([y0, y1]), np.arange(n) % 4 != 0


def plain(x, y, train, cuts, config):
    """Strictly the best leaf each time, every gain tried one by one."""
    bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
    pred = np.full(len(x), y[train].mean())
    curve = []
    for number in range(config.trees):
        columns = boosting.column_draws(config, x.shape[1], number)
        g = pred - y

        def best(rows):
            found = (-np.inf, 0, 0)
            for f in columns:
                for b in range(config.bins):
                    left = rows[bins[rows, f] <= b]
                    right = rows[bins[rows, f] > b]
                    if min(len(left), len(right)) < config.least_rows:
                        continue
                    part = lambda r: g[r].sum() ** 2 / (len(r) + config.l2)
                    gain = part(left) + part(right) - part(rows)
                    if gain > found[0] + 1e-9:
                        found = (gain, f, b)
            return found

        leaves = [np.flatnonzero(train)]
        everyone = [np.arange(len(x))]
        gains = [best(leaves[0])]
        while len(leaves) < config.leaves and max(gains)[0] > 0:
            i = max(range(len(leaves)), key=lambda i: gains[i][0])
            _, f, b = gains[i]
            halves = lambda r: [r[bins[r, f] <= b], r[bins[r, f] > b]]  # noqa: B023, E731
            leaves[i : i + 1], everyone[i : i + 1] = halves(leaves[i]), halves(everyone[i])
            gains[i : i + 1] = [best(r) for r in leaves[i : i + 2]]
        if len(leaves) == 1:
            break
        step = np.zeros(len(x))
        for fitted, all_rows in zip(leaves, everyone, strict=True):
            step[all_rows] = -config.rate * g[fitted].sum() / (len(fitted) + config.l2)
        pred = pred + step
        curve.append((np.abs(pred - y)[~train].mean(), pred))
    return curve


def test_equals_one_machine(spark):
    df, x, y, train = table(spark)
    config = LeafWise(trees=6, leaves=7, least_rows=20, bins=16, rate=0.3, patience=3, columns_share=0.8)
    models = boosting.fit(df, ["a", "b", "c", "d"], ["y0", "y1"], F.col("t"), config)
    cuts = boosting.bin_cuts(df.where("t"), ["a", "b", "c", "d"], config.bins)
    for k, model in enumerate(models):
        curve = plain(x, y[k], train, cuts, config)
        size = min(range(len(curve)), key=lambda i: curve[i][0]) + 1
        assert len(model.trees) == size and all(sum(f < 0 for f in t["feature"]) <= config.leaves for t in model.trees)
        np.testing.assert_allclose(model.predict(x), curve[size - 1][1], atol=1e-9)
        got = {(r["a"], r["b"], r["c"], r["d"]): r["prediction"] for r in model.transform(df).collect()}
        np.testing.assert_allclose([got[tuple(r)] for r in x], curve[size - 1][1], atol=1e-9)


def test_blocks_written_between_trees_change_nothing(spark, monkeypatch):
    df, x, _, _ = table(spark, 400)
    config = LeafWise(trees=5, leaves=5, least_rows=10, bins=16, rate=0.3)
    whole = boosting.fit(df, ["a", "b"], ["y0"], F.lit(True), config)[0]
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    monkeypatch.setattr(boosting, "BLOCK", 37)
    np.testing.assert_allclose(boosting.fit(df, ["a", "b"], ["y0"], F.lit(True), config)[0].predict(x[:, :2]), whole.predict(x[:, :2]), atol=1e-9)
    assert len(whole.trees) == 5


def test_patience_ends_a_target(spark):
    """A target of noise stops early while the other goes on."""
    df, _, _, _ = table(spark, 400)
    noisy = df.withColumn("y1", F.when(F.col("t"), F.col("a")).otherwise(-F.col("a")))
    one, two = boosting.fit(noisy, ["a", "b"], ["y0", "y1"], F.col("t"), LeafWise(trees=8, leaves=4, least_rows=10, bins=16, rate=0.3, patience=2))
    assert len(one.trees) > len(two.trees) == 1


def test_odd_tables(spark, tmp_path):
    df, x, y, _ = table(spark, 60)
    with pytest.raises(ValueError, match="rows to train on"):
        boosting.fit(df.limit(0), ["a"], ["y0"], F.lit(True))
    with pytest.raises(ValueError, match="nulls"):
        boosting.fit(df.withColumn("a", F.when(F.col("b") > 0, F.col("a"))), ["a"], ["y0"], F.lit(True))
    # Too few rows for any split: the mean. Equal values everywhere: the same.
    for inputs, frame in ((["a"], df), (["k"], df.withColumn("k", F.lit(1.0)))):
        model = boosting.fit(frame, inputs, ["y0"], F.lit(True), LeafWise(trees=3, least_rows=31))[0]
        assert model.trees == [] and model.predict(np.zeros((1, 1)))[0] == pytest.approx(y[0].mean())
    model = boosting.fit(df, ["a"], ["y0"], F.lit(True), LeafWise(trees=3, least_rows=5))[0]
    model.save(spark, f"{tmp_path}/m")
    again = boosting.BoostedTrees.load(spark, f"{tmp_path}/m")
    assert again == model
    assert model.transform(df.limit(0)).count() == 0
