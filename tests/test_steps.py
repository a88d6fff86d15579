"""The steps after cleaning, file to file, and the exploratory tables."""

import json

import pytest

from tests.test_series import VARS, cleaned, raw_frame
from tidewright.operators.boosting import LeafWise
from tidewright.plans import pipeline
from tidewright.sources.journal import read_journal


def test_features_and_training_from_files(spark, tmp_path):
    result, _ = cleaned(spark, 480)
    pipeline.write_clean(result, f"{tmp_path}/clean", ["series"], least_rows=1)
    splits = {"train": ("2023-01-01", "2023-01-12 23:00"), "val": ("2023-01-13", "2023-01-16 23:00"), "test": ("2023-01-17", "2023-01-31 23:00")}
    pipeline.feature_step(spark, f"{tmp_path}/clean", f"{tmp_path}/ready", ["series"], splits, f"{tmp_path}/log")
    records = pipeline.train_step(spark, f"{tmp_path}/ready", f"{tmp_path}/out", f"{tmp_path}/log", LeafWise(trees=2, leaves=3, least_rows=10)).collect()
    assert sorted(r["horizon"] for r in records) == [1, 6, 12, 24] and all(r["trees"] >= 1 and r["test_mae"] is not None for r in records)
    told = {(r["step"], r["kind"]) for r in read_journal(spark, f"{tmp_path}/log").collect()}
    assert told == {(s, k) for s in ("features", "training") for k in ("STARTED", "INPUT", "TRANSFORMED", "WRITE_PLANNED", "OUTPUT", "SUCCEEDED")}
    # Nothing is written over, and the journal says why a second run ended.
    with pytest.raises(Exception, match="exists"):
        pipeline.feature_step(spark, f"{tmp_path}/clean", f"{tmp_path}/ready", ["series"], splits, f"{tmp_path}/log2")
    assert "FAILED" in {r["kind"] for r in read_journal(spark, f"{tmp_path}/log2").collect()}


def test_exploratory_tables(spark, tmp_path):
    def edit(d):
        for i in range(100, 105):
            d[i]["PS"] = ""
        for i in range(200, 215):
            d[i]["RH2M"] = "55.5"
        d[300]["T2M"] = "49"
        d[310]["T2M"] = ""

    raw = raw_frame(spark, 480, edit)
    tables = pipeline.report_tables(raw, pipeline.clean(raw, ["series"]), ["series"], floors=dict.fromkeys(VARS, 5.0))
    assert sorted(pipeline.write_reports(tables, f"{tmp_path}/r")) == sorted(tables) and len(tables) == 12
    read = lambda n: spark.read.option("header", True).csv(f"{tmp_path}/r/{n}").collect()
    assert [(r["variable"], r["hours"]) for r in read("missing_runs")] == [("PS", "5")]
    assert ("RH2M", "15") in {(r["variable"], r["hours"]) for r in read("flat_runs")}
    assert [(r["column"], r["before"]) for r in read("change_log")] == [("T2M", None)]
    assert "isolated_reversing_spike" in json.dumps([r["reasons"] for r in read("events")])
    assert {r["decision"] for r in read("review")} == {"pending"}
