"""Queries over the whole of their operator's purpose, on tables that have train rows."""

import os

import pytest

from tests.test_catalog import plain
from tidewright.operators import analytics, features
from tidewright.plans import catalog

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", ["pivot_year_month_flags", "feature_target_corr_train", "scaler_fit_train", "scaled_features_train"])
def test_equals_sql_with_train_rows(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine, theirs = got.select(*[f"`{c}`" for c in want.columns]).collect(), want.fetchall()
    assert plain(mine) == plain(theirs)
    sizes = {"pivot_year_month_flags": {"A", "N", "R"}, "feature_target_corr_train": 26 * 4, "scaler_fit_train": 2 * 22 + 2, "scaled_features_train": 2 + 22}
    assert sizes[name] == {"pivot_year_month_flags": lambda: {r["flag"] for r in got.collect()}, "feature_target_corr_train": lambda: len(mine)}.get(name, lambda: len(got.columns))()
    if name != "pivot_year_month_flags":
        assert any(v is not None and v == v for r in mine for v in r if isinstance(v, float))


def test_scaler_names_all_columns():
    assert features.feature_names(catalog.NAMES)["scaled"] == catalog._ALL_SCALED and len(catalog._ALL_SCALED) == 22


def test_pivot_keeps_keys_apart(spark):
    monthly = spark.sql("SELECT * FROM VALUES ('A', TIMESTAMP_NTZ'2024-02-01', 1.0D), ('R', TIMESTAMP_NTZ'2024-02-01', 2.0D) AS t(flag, month, top)")
    assert {(r["flag"], r["m2"]) for r in analytics.pivot_months(monthly, "top", keys=["flag"]).collect()} == {("A", 1.0), ("R", 2.0)}
