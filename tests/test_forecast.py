"""The forecast query does the whole job: all horizons, series, features and the production settings."""

import os

import pytest
from pyspark.sql import functions as F

from tidewright.operators import boosting, features, forecast
from tidewright.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_every_horizon_over_all_series(spark, monkeypatch):
    asked, fit = [], boosting.fit

    def small(rows, inputs, targets, train, config=boosting.LeafWise()):
        asked.append((rows.where(train).count(), rows.where(~train).count(), tuple(inputs), tuple(targets), config))
        return fit(rows, inputs, targets, train, boosting.LeafWise(trees=2, leaves=4))

    monkeypatch.setattr(boosting, "fit", small)
    rows = catalog.split_rows(spark, SF)
    sizes = {r["split"]: r["n"] for r in rows.where("split <> 'none'").groupBy("split").agg(F.count("*").alias("n")).collect()}
    got = catalog.QUERIES["forecast_trees"](spark, SF).collect()
    names = features.feature_names(catalog.NAMES)
    assert asked == [(sizes["train"], sizes["val"], tuple(names["tabular"]), tuple(names["targets"]), boosting.LeafWise())]
    assert sorted((r["horizon"], r["split"], r["n"]) for r in got) == sorted((h, s, n) for h in features.HORIZONS for s, n in sizes.items())
    for r in got:
        part = rows.where(F.col("split") == r["split"])
        assert r["persistence_mae"] == pytest.approx(part.agg(F.avg(F.abs(F.col(f"`t2m_t+{r['horizon']}h`") - F.col("t2m")))).first()[0])


def test_no_validation_rows_keep_all_trees(spark):
    df = spark.range(80).selectExpr("cast(id as double) x", "cast(id as double) y")
    model = forecast.fit_horizon(df, df.where("x < 0"), ["x"], "y", forecast.Boosting(trees=3, depth=2, least_rows=5, patience=1))
    assert model.stages[-1].getNumTrees == 3
