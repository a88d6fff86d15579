"""Hand-built frames with known defects, one rule at a time."""

import datetime as dt
import hashlib
import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewright.functions.scalars import iso_time, six_digits, uuid5
from tidewright.operators import analytics, axis, features, forecast, impute, ingest, quality, ranks
from tidewright.plans import pipeline
from tidewright.sources import payload, shared
from tidewright.sources.journal import Journal, file_info, inside, read_journal

VARS = [v.name for v in ingest.WEATHER]
START = dt.datetime(2023, 1, 1)


def raw_frame(spark, rows=72, edit=None):
    data = []
    for i in range(rows):
        t = (START + dt.timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M:%SZ")
        data.append({"series": "s", "timestamp": t, "T2M": str(20 + math.sin(i / 24 * 2 * math.pi)), "PRECTOTCORR": "0", "RH2M": "70", "PS": "101", "WS2M": "2", "WD2M": "350", "ALLSKY_SFC_SW_DWN": "100"})
    if edit:
        data = edit(data) or data
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in ["series", "timestamp", *VARS]))


def cleaned(spark, rows=72, edit=None):
    result = pipeline.clean(raw_frame(spark, rows, edit), ["series"])
    return result, result.clean.orderBy("ts").collect()


def test_local_hours(spark):
    _, rows = cleaned(spark)
    assert rows[0]["ts"] == START + dt.timedelta(hours=7)
    assert all(b["ts"] - a["ts"] == dt.timedelta(hours=1) for a, b in zip(rows, rows[1:], strict=False))


def test_times_are_strict(spark):
    def bare(d):
        d[3]["timestamp"] = "2023-01-01T03:00:00"

    def off(d):
        d[3]["timestamp"] = "2023-01-01T03:30:00Z"

    with pytest.raises(ValueError, match="no offset"):
        cleaned(spark, edit=bare)
    with pytest.raises(ValueError, match="between two hours"):
        cleaned(spark, edit=off)


def test_invalid_cells_are_filled_and_recorded(spark):
    def edit(d):
        d[10]["T2M"], d[11]["RH2M"], d[12]["PS"] = "-999", "130", "abc"

    result, rows = cleaned(spark, edit=edit)
    assert rows[10]["T2M"] == pytest.approx((rows[9]["T2M"] + rows[11]["T2M"]) / 2)
    assert sum(r["is_imputed"] for r in rows) == 3
    assert rows[11]["imputed_columns"] == "RH2M"
    report = result.report.first()
    assert (report["filled_T2M"], report["filled_RH2M"], report["filled_PS"]) == (1, 1, 1)


def test_long_gaps_and_edges_stay(spark):
    def edit(d):
        for i in range(20, 26):
            d[i]["T2M"] = ""
        d[0]["T2M"] = ""

    _, rows = cleaned(spark, edit=edit)
    assert sum(r["T2M"] is None for r in rows) == 7


def test_missing_hour_is_inserted(spark):
    _, rows = cleaned(spark, edit=lambda d: d[:30] + d[31:])
    assert len(rows) == 72 and [r["is_inserted_hour"] for r in rows].index(1) == 30


def test_wind_passes_north(spark):
    def edit(d):
        d[5]["WD2M"], d[6]["WD2M"], d[7]["WD2M"], d[8]["WD2M"] = "350", "", "10", "360"

    _, rows = cleaned(spark, edit=edit)
    assert min(rows[6]["WD2M"], 360 - rows[6]["WD2M"]) < 0.05
    assert rows[8]["WD2M"] == 0


def test_copies_and_conflicts(spark):
    assert len(cleaned(spark, edit=lambda d: [*d, dict(d[4])])[1]) == 72
    with pytest.raises(ValueError, match="contradict"):
        cleaned(spark, edit=lambda d: [*d, d[4] | {"T2M": "35"}])


def test_flags_keep_values(spark):
    def edit(d):
        for i, row in enumerate(d):
            row["T2M"] = str(20 + 0.1 * (i % 7))
        d[500]["T2M"] = "38"

    result, rows = cleaned(spark, 960, edit)
    assert rows[500]["T2M"] == 38 and rows[500]["outlier_flags"] == "T2M"
    assert result.flags.where("ts = timestamp_ntz'2023-01-22 03:00:00'").count() >= 1


def test_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    assert payload.write_once(df, f"{tmp_path}/t") and not payload.write_once(df, f"{tmp_path}/t")
    with pytest.raises(FileExistsError):
        payload.write_once(df.withColumn("y", F.lit("b")), f"{tmp_path}/t")


def feature_frame(spark, n=528):
    start = dt.datetime(2018, 12, 20)
    rows = [("s", start + dt.timedelta(hours=i), float(i), 2.0 if i % 5 == 0 else 0.0, 80.0, 100 + i / 100, 2.0, 90.0, 50.0, 0, 0) for i in range(n)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, T2M double, PRECTOTCORR double, RH2M double, PS double, WS2M double, WD2M double, ALLSKY_SFC_SW_DWN double, is_inserted_hour int, is_imputed int")


SPLITS = {"train": ("2018-01-01", "2018-12-31 23:00"), "val": ("2019-01-01", "2019-12-31 23:00")}


def ready(spark, df=None):
    return pipeline.model_ready(df if df is not None else feature_frame(spark), ["series"], SPLITS, VARS)


def test_targets_wind_and_causality(spark):
    df = feature_frame(spark)
    base = features.add_features(df, ["series"]).orderBy("ts").collect()
    assert [base[100][f"T2M_t+{h}h"] for h in features.HORIZONS] == [100.0 + h for h in features.HORIZONS]
    assert base[100]["WIND_U"] == pytest.approx(-2) and base[100]["WIND_V"] == pytest.approx(0, abs=1e-12)
    later = features.add_features(df.withColumn("T2M", F.when(F.col("ts") > base[100]["ts"], F.col("T2M") + 50).otherwise(F.col("T2M"))), ["series"]).orderBy("ts").collect()
    for c in features.feature_names()["tabular"]:
        assert base[100][c] == later[100][c]


def test_split_is_purged(spark):
    rows = ready(spark)[0].orderBy("ts").collect()
    train = [i for i, r in enumerate(rows) if r["split"] == "train"]
    val = [i for i, r in enumerate(rows) if r["split"] == "val"]
    assert train[0] == 47 and rows[train[-1]]["ts"] + dt.timedelta(hours=24) <= dt.datetime(2018, 12, 31, 23)
    assert rows[val[0]]["ts"] == dt.datetime(2019, 1, 1) and all(r["split"] == "none" for r in rows[-24:])


def test_filled_hour_spoils_its_windows(spark):
    at = dt.datetime(2018, 12, 20) + dt.timedelta(hours=200)
    rows = ready(spark, feature_frame(spark).withColumn("is_imputed", F.when(F.col("ts") == F.lit(at).cast("timestamp_ntz"), 1).otherwise(0)))[0].orderBy("ts").collect()
    assert all(rows[i]["split"] == "none" for i in range(176, 248)) and rows[248]["split"] != "none" and rows[175]["split"] != "none"


def test_scaler_sees_train_only(spark):
    rows, scaler, made = ready(spark)
    train = rows.where("split = 'train'").agg(F.avg("T2M").alias("m"), F.stddev_pop("T2M").alias("s"), F.stddev_pop("RH2M").alias("c")).first()
    assert train["m"] == pytest.approx(0, abs=1e-9) and train["s"] == pytest.approx(1) and train["c"] == 0
    assert scaler.first()["std_RH2M"] == 1.0
    assert json.loads(pipeline.scaler_params(scaler, ["T2M"]))["T2M"]["mean"] == pytest.approx(made.where("split = 'train'").agg(F.avg("T2M")).first()[0])


def test_sequence_windows(spark):
    rows = ready(spark)[0]
    cols = features.feature_names()
    windows = features.sequence_windows(rows, "val", cols["sequence"], cols["targets"], ["series"]).orderBy("ts").collect()
    assert all(len(w["X"]) == 48 and len(w["X"][0]) == 13 and len(w["y"]) == 4 for w in windows)
    with pytest.raises(ValueError, match="without breaks"):
        features.sequence_windows(rows.where("ts <> timestamp_ntz'2018-12-25 00:00:00'"), "val", cols["sequence"], cols["targets"], ["series"])


def test_pieces_equal_the_whole(spark):
    df = feature_frame(spark)
    fn = lambda d, keys: d.withColumn("m", features.rolling("T2M", 24, axis.by_time(keys), F.avg)).withColumn("n", F.lead("T2M", 24).over(axis.by_time(keys)))
    whole = fn(df, ["series"]).select("ts", "m", "n")
    pieces = axis.chunked(df, fn, ["series"], 47, 24, hours=60).select("ts", "m", "n")
    assert whole.exceptAll(pieces).isEmpty() and pieces.exceptAll(whole).isEmpty()


def test_causal_fill(spark):
    df = feature_frame(spark, 20).withColumn("T2M", F.when(F.hour("ts").isin(3, 4, 8, 9, 10), None).otherwise(F.col("T2M")))
    rows = impute.carry_forward(df, ["T2M"], ["series"]).orderBy("ts").collect()
    assert [rows[i]["T2M"] for i in (3, 4, 8, 9)] == [2.0, 2.0, None, None]


def test_events_and_ids(spark):
    hour = lambda h: dt.datetime(2024, 1, 1, h)
    flags = spark.createDataFrame([("s", hour(h), "x", 1.0, float(h), 1, "r") for h in (1, 2, 5)] + [("s", hour(2), "x", 1.0, 9.0, 3, "q")], "series string, ts timestamp_ntz, variable string, value double, score double, severity int, rule string")
    rows = quality.ranked_events(quality.events(flags, ["series"]), ["series"]).orderBy("event_id").collect()
    assert [(r["event_id"], r["hours"], r["reasons"]) for r in rows] == [("E00001", 2, "q|r"), ("E00002", 1, "r")]
    name = spark.range(1).select(uuid5(uuid.NAMESPACE_DNS, F.lit("station|1"))).first()[0]
    assert name == str(uuid.uuid5(uuid.NAMESPACE_DNS, "station|1"))


def test_errors_and_persistence(spark):
    df = spark.createDataFrame([(20.0, p) for p in (19.0, 20.2, 21.0, 21.1)], "a double, p double")
    row = forecast.errors(df, "a", "p").first()
    assert row["within_1_pct"] == 75 and row["within_2_pct"] == 100
    with pytest.raises(ValueError):
        forecast.errors(df, "a", "p", tolerances=(0,))
    z = spark.createDataFrame([(-1.0,), (0.0,), (2.0,)], "z double").select(forecast.persistence(F.col("z"), 20, 3).alias("x")).collect()
    assert [r[0] for r in z] == [17, 20, 26]
    with pytest.raises(FileNotFoundError):
        forecast.load_model("/tmp/no-such-model")


def test_trees_beat_nothing(spark):
    df = feature_frame(spark, 300).withColumn("y", F.col("T2M") * 2)
    model = forecast.fit_horizon(df.where("T2M < 200"), df.where("T2M >= 200 and T2M < 240"), ["T2M", "PS"], "y", forecast.Boosting(trees=4, depth=3, least_rows=2, rate=0.5))
    assert forecast.score(model, df, "y").agg(F.avg("abs_error")).first()[0] < df.agg(F.avg(F.abs("y"))).first()[0]


def payload_text(**edit):
    hours = {f"20240101{h:02d}": 1.0 for h in range(24)}
    body = {"header": {"time_standard": "UTC", "fill_value": -999.0}, "geometry": {"coordinates": [105.8542, 21.0285, 12.0]}, "parameters": {"T2M": {"units": "C", "longname": "t"}}, "properties": {"parameter": {"T2M": hours}}}
    for k, v in edit.items():
        body[k] = v
    return json.dumps(body)


def test_payloads(spark):
    hours = {f"20240101{h:02d}": 1.0 for h in range(23)}
    texts = [("ok", payload_text()), ("lst", payload_text(header={"time_standard": "LST", "fill_value": -999.0})), ("short", payload_text(properties={"parameter": {"T2M": hours}})), ("bad", "{")]
    parsed = payload.parse_payloads(spark.createDataFrame(texts, "id string, json string"))
    faults = {r["id"]: r["f"] for r in parsed.select("id", payload.payload_faults(21.0285, 105.8542, ["T2M"]).alias("f")).collect()}
    assert faults["ok"] == [] and "time standard is not UTC" in faults["lst"] and faults["bad"]
    expected = payload.hour_keys(payload.month_ranges(spark, "2024-01-01", "2024-01-01"))
    gaps = {r["id"]: (r["missing"], r["unexpected"]) for r in payload.key_difference(payload.hour_values(parsed, ["id"]), expected, ["id"]).collect()}
    assert gaps["ok"] == (0, 0) and gaps["short"] == (1, 0)
    assert payload.payload_rows(parsed.where("id = 'ok'"), ["id"], ["T2M"]).count() == 24


def test_request_months(spark):
    rows = payload.month_ranges(spark, "2024-01-31", "2024-03-01").orderBy("first").collect()
    assert [(r["first"].isoformat(), r["last"].isoformat()) for r in rows] == [("2024-01-31", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-01")]
    with pytest.raises(ValueError):
        payload.check_request("2024-02-01", "2024-01-01", "2025-01-01", 1, 0)


def test_journal(spark, tmp_path):
    folder = f"{tmp_path}/journal"
    with Journal(spark, folder, "clean", {"x": 1}) as journal:
        journal.note("INPUT", **file_info(spark, __file__))
        journal.watch(spark.range(7), "rows", n=F.count(F.lit(1)), top=F.max("id")).write.format("noop").mode("overwrite").save()
        assert journal.tell("rows") == {"n": 7, "top": 6}
    with pytest.raises(RuntimeError), Journal(spark, folder, "clean") as other:
        raise RuntimeError("lost")
    rows = read_journal(spark, folder).orderBy("run", "n").collect()
    kinds = {run: [r["kind"] for r in rows if r["run"] == run] for run in (journal.run, other.run)}
    assert kinds == {journal.run: ["STARTED", "INPUT", "TRANSFORMED", "SUCCEEDED"], other.run: ["STARTED", "FAILED"]}
    assert "lost" in [r["details"] for r in rows if r["kind"] == "FAILED"][0]
    told = json.loads([r["details"] for r in rows if r["kind"] == "INPUT"][0])
    assert told["sha256"] == hashlib.sha256(open(__file__, "rb").read()).hexdigest() and not file_info(spark, f"{tmp_path}/none")["exists"]
    with pytest.raises(ValueError):
        journal.note("RENAMED")
    with pytest.raises(ValueError):
        Journal(spark, f"{tmp_path}/data/raw/logs", "clean")
    assert inside("/a/data/raw/x", "data/raw") and inside("data/raw", "data/raw") and not inside("/a/data/raw2/x", "data/raw") and not inside("/a/data", "data/raw")


def test_clean_files(spark, tmp_path):
    """From a text table to files and back: order, types, counts in the journal, and what is refused."""
    raw = f"{tmp_path}/raw"
    raw_frame(spark).withColumn("T2M", F.when(F.col("timestamp") == "2023-01-01T10:00:00Z", "").otherwise(F.col("T2M"))).write.option("header", True).csv(raw)
    assert payload.first_that_exists(spark, f"{tmp_path}/none", raw) == raw
    with pytest.raises(FileNotFoundError):
        payload.first_that_exists(spark, f"{tmp_path}/none")
    result = pipeline.clean_step(spark, raw, f"{tmp_path}/out", ["series"], f"{tmp_path}/journal", least_rows=1)
    back = pipeline.load_clean(spark, f"{tmp_path}/out", ["series"])
    assert dict(back.dtypes) == dict(result.clean.dtypes) and payload.same_rows(back, result.clean)
    assert back.where(pipeline.imputed("T2M")).count() == 1 and back.where(pipeline.imputed("PS")).count() == 0
    for i in range(back.rdd.getNumPartitions()):
        part = [r["ts"] for r in back.where(F.spark_partition_id() == i).collect()]
        assert part == sorted(part)
    assert spark.read.json(f"{tmp_path}/out/report").first()["filled_T2M"] == 1
    told = read_journal(spark, f"{tmp_path}/journal").where("kind = 'WRITTEN'").collect()
    assert sorted((json.loads(r["details"])["name"], json.loads(r["details"])["rows"]) for r in told) == [("clean", 72), ("outlier_flags", 0)]
    with pytest.raises(ValueError, match="complete"):
        pipeline.write_clean(result, f"{tmp_path}/other", ["series"])
    with pytest.raises(ValueError, match="sealed"):
        pipeline.write_clean(result, f"{tmp_path}/data/raw/clean", ["series"], 1)
    with pytest.raises(Exception):
        pipeline.clean_step(spark, f"{tmp_path}/none", f"{tmp_path}/out2", ["series"], f"{tmp_path}/journal2", least_rows=1)
    assert {r["kind"] for r in read_journal(spark, f"{tmp_path}/journal2").collect()} >= {"STARTED", "FAILED"}


def test_model_ready_files(spark, tmp_path):
    rows, scaler, _ = ready(spark)
    pipeline.write_model_ready(rows, scaler, str(tmp_path), ["T2M", "PS"])
    back = pipeline.load_model_ready(spark, str(tmp_path))
    assert payload.same_rows(back.select(*rows.columns), rows)
    val = pipeline.load_model_ready(spark, str(tmp_path), "val")
    assert val.count() == rows.where("split = 'val'").count() > 0 and "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().toString()
    first = scaler.first()
    assert pipeline.target_scaler(spark, str(tmp_path)) == (first["target_mean"], first["target_std"])
    assert json.loads(spark.read.text(f"{tmp_path}/scaler_params").first()[0])["PS"]["mean"] == first["mean_PS"]
    assert payload.read_metadata(spark, f"{tmp_path}/scaler").count() == 1
    text = spark.read.option("header", True).csv(f"{tmp_path}/model_ready_csv").where("ts = '2018-12-25T00:00:00'").first()
    exact = rows.where("ts = timestamp_ntz'2018-12-25 00:00:00'").first()
    assert text["PS"] == f"{exact['PS']:.6g}" and float(text["PS"]) == pytest.approx(exact["PS"], rel=1e-5)
    assert pipeline.write_reports({"summary": features.split_summary(rows)}, f"{tmp_path}/reports") == ["summary"]
    assert pipeline.write_reports({"summary": features.split_summary(rows)}, f"{tmp_path}/reports") == []


def test_forecast_flow(spark, tmp_path):
    """Models of four horizons are fitted, saved, scored and loaded again; records hold what validation and test rows say."""
    df = feature_frame(spark, 900)
    rows, scaler, _ = pipeline.model_ready(df, ["series"], {"train": ("2018-01-01", "2019-01-10 23:00"), "val": ("2019-01-11", "2019-01-16 23:00"), "test": ("2019-01-17", "2019-12-31")}, VARS)
    targets = dict(zip(features.HORIZONS, features.feature_names()["targets"], strict=True))
    mean, std = scaler.select("target_mean", "target_std").first()
    rows = rows.persist()
    inputs, config = ["T2M", "PS", "hour_sin"], forecast.Boosting(trees=4, depth=2, least_rows=3, rate=0.5, patience=2)
    scores = forecast.train_horizons(rows, inputs, targets, forecast.persistence(F.col("T2M"), mean, std), config, folder=f"{tmp_path}/models")
    records = forecast.horizon_records(scores, targets, f"{tmp_path}/models").orderBy("horizon").collect()
    assert [r["horizon"] for r in records] == [1, 6, 12, 24] and all(len(r) == 12 for r in records)
    of = lambda h, split: scores.where((F.col("horizon") == h) & (F.col("split") == split)).first()
    for r in records:
        assert (r["validation_mae"], r["test_rmse"], r["persistence_test_mae"]) == (of(r["horizon"], "val")["mae"], of(r["horizon"], "test")["rmse"], of(r["horizon"], "test")["persistence_mae"])
        assert r["persistence_test_mae"] == pytest.approx(r["horizon"]) and 1 <= r["trees"] <= 4
    forecast.write_report(forecast.horizon_records(scores, targets, f"{tmp_path}/models"), f"{tmp_path}/report", config)
    told = spark.read.json(f"{tmp_path}/report/metrics_json").first()
    assert len(told["results"]) == 4 and json.loads(told["settings"])["trees"] == 4
    assert spark.read.option("header", True).csv(f"{tmp_path}/report/metrics_csv").where("horizon = 6").first()["test_mae"] == f"{records[1]['test_mae']:.6f}"
    known = forecast.predict_row(forecast.select_row(rows, "2019-01-20T05:00:00", list(targets.values())), f"{tmp_path}/models", targets).collect()
    at = rows.where("ts = timestamp_ntz'2019-01-20 05:00:00'").first()
    for r in known:
        assert r["actual"] == at[targets[r["horizon"]]] and r["abs_error"] == pytest.approx(abs(r["prediction"] - r["actual"]))
    last = rows.orderBy(F.desc("ts")).limit(1)
    unknown = {r["horizon"]: r for r in forecast.predict_row(last, f"{tmp_path}/models", targets).collect()}
    assert all(r["actual"] is None and r["abs_error"] is None and r["prediction"] is not None for r in unknown.values())
    with pytest.raises(FileNotFoundError):
        forecast.predict_row(last, f"{tmp_path}/nothing", targets)


def test_rows_by_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), None if h > 3 else float(h)) for h in range(6)], "ts timestamp_ntz, y double")
    pick = lambda at: forecast.select_row(df, at, ["y"]).first()["ts"].hour
    assert pick(None) == 3 and pick("2024-01-01T02:00:00") == 2 and pick("2023-12-31T18:00:00Z") == 1 and pick("2024-01-01T06:00:00+09:00") == 4
    with pytest.raises(ValueError, match="no row at"):
        pick("2030-01-01T00:00:00")
    with pytest.raises(ValueError, match="targets"):
        forecast.select_row(df.where("y is null"), None, ["y"])
    pair = spark.createDataFrame([(20.0, 19.0), (20.0, 21.5)], "a double, p double")
    assert forecast.accuracy(pair, "a", "p", 1.0) == 50
    with pytest.raises(ValueError, match="measure"):
        forecast.accuracy(pair.limit(0), "a", "p", 1.0)


def test_trees_are_cut_not_refitted(spark):
    """Cutting keeps the first trees as they are: the cut model's error is the curve's."""
    df = feature_frame(spark, 300).selectExpr("T2M as x", "T2M * T2M as y")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    whole = GBTRegressor(labelCol="y", maxIter=6, maxDepth=2, seed=1).fit(rows)
    curve = whole.evaluateEachIteration(rows, "absolute")
    for n in (1, 3, 6):
        cut = forecast.first_trees(whole, n)
        assert cut.getNumTrees == n and cut.treeWeights == whole.treeWeights[:n]
        assert cut.transform(rows).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0] == pytest.approx(curve[n - 1])
    assert forecast.best_size([5, 4, 3, 3.5, 3.6, 1], 2) == 3 and forecast.best_size([5, 4, 3, 3.5, 3.6, 1], 9) == 6


def test_series_without_a_key(spark):
    """A null key is a series like any other: its values stay, and statistics come back to it."""
    hour = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(k, hour(h), float(h + (h == 9) * 50)) for k in (None, "s") for h in range(12) if h != 4], "series string, ts timestamp_ntz, x double")
    rows = axis.densify(df, ["series"])
    assert rows.count() == 24 and rows.where("is_inserted_hour = 1").count() == 2 and rows.where("series is null and x is not null").count() == 11
    filled = impute.fill(rows, ["x"], [], ["series"])
    assert sorted((r["series"] or "", r["x"]) for r in filled.where("filled_x").collect()) == [("", 4.0), ("s", 4.0)]
    flags = quality.flag_robust_z(quality.unpivot(filled, ["series"], ["x"]), ["series"], {"one": F.lit(1)})
    assert sorted((r["series"] or "", r["value"]) for r in flags.collect()) == [("", 59.0), ("s", 59.0)]
    assert quality.attach_flags(filled, flags, ["series"]).where("outlier_flags = 'x'").count() == 2
    assert axis.axis_difference(axis.calendar(df, ["series"]), df, ["series"]).count() == 2


def test_fill_reaches_over_pieces(spark):
    """Filling in pieces equals filling the whole, at every place of a cut."""
    df = feature_frame(spark, 400).withColumn("T2M", F.when(F.hash("ts") % 3 == 0, None).otherwise(F.col("T2M"))).withColumn("WD2M", F.when(F.hash("ts", "PS") % 4 == 0, None).otherwise(F.pmod(F.col("T2M") * 37, F.lit(360.0))))
    whole = impute.fill(df, ["T2M"], ["WD2M"], ["series"])
    at = impute.chunked
    try:
        impute.chunked = lambda *a, **k: at(*a, **{**k, "hours": 7})
        pieces = impute.fill(df, ["T2M"], ["WD2M"], ["series"])
        assert payload.same_rows(whole, pieces) and whole.where("filled_T2M").count() > 50
    finally:
        impute.chunked = at


def test_exact_quantiles_by_ranges(spark):
    rng = random.Random(4)
    values = [float(rng.choice([0, 0, 0, 0, 1, 2, rng.random() * 9])) for _ in range(501)]
    df = spark.createDataFrame([(v, None if i % 5 else v * v, None) for i, v in enumerate(values)], "a double, b double, c double")
    got = {r["variable"]: r["q"] for r in ranks.exact_quantiles(df, ["a", "b", "c"], (0.0, 0.1, 0.5, 0.937, 1.0)).collect()}
    for c in "ab":
        want = df.agg(F.percentile(c, F.array(*map(F.lit, (0.0, 0.1, 0.5, 0.937, 1.0))))).first()[0]
        assert got[c] == pytest.approx(want)
    assert got["c"] is None
    assert analytics.describe(df, ["a", "c"]).where("variable = 'c'").first()["p50"] is None


def test_payload_values_and_metadata(spark):
    hours = {f"20240101{h:02d}": 1.0 for h in range(24)}
    texts = [("ok", payload_text(properties={"parameter": {"T2M": hours | {"2024010103": None, "2024010104": -1e-7}}}))]
    for name, value in (("text", "1.0"), ("true", True), ("words", "cold"), ("huge", 10**400)):
        texts.append((name, payload_text(properties={"parameter": {"T2M": hours | {"2024010107": value}}})))
    raw = spark.createDataFrame(texts, "id string, json string")
    assert sorted((r["id"], r["key"]) for r in payload.value_faults(raw, ["id"]).collect()) == [(n, "2024010107") for n in ("huge", "text", "true", "words")]
    nan = payload.parse_payloads(spark.createDataFrame([("n", payload_text().replace(": 1.0", ": Infin", 1))], "id string, json string"))
    assert nan.select(payload.payload_faults(21.0285, 105.8542, ["T2M"]).alias("f")).first()["f"]
    same = payload.parse_payloads(spark.createDataFrame([("a", payload_text()), ("b", payload_text())], "id string, json string"))
    assert payload.metadata_drift(same).isEmpty()
    other = payload.parse_payloads(spark.createDataFrame([("a", payload_text()), ("b", payload_text(parameters={"T2M": {"units": "K", "longname": "t"}}))], "id string, json string"))
    assert [(r["parameter"], r["versions"]) for r in payload.metadata_drift(other).collect()] == [("T2M", 2)]


def test_retries():
    def run(answers, retries):
        asked, waits = [], []
        ask = lambda url: asked.append(url) or answers[min(len(asked), len(answers)) - 1]
        try:
            return payload.fetch(ask, "u", retries, waits.append), len(asked), waits
        except RuntimeError as e:
            return str(e), len(asked), waits

    assert run([(503, None), (None, None), (200, "body")], 2) == ("body", 3, [2.0, 4.0])
    assert run([(503, None)], 2)[1:] == (3, [2.0, 4.0]) and run([(422, None)], 5)[1:] == (1, [])
    assert run([(429, None)], 6)[2] == [2.0, 4.0, 8.0, 16.0, 30.0, 30.0] and [payload.is_transient(s) for s in (408, 404, 500, None)] == [True, False, True, True]


def test_cached_months_and_snapshots(spark, tmp_path):
    asked = []

    def load(missing):
        asked.append(sorted(r["first"].isoformat() for r in missing.collect()))
        return missing.select("first", F.concat(F.lit("{}"), F.col("first").cast("string")).alias("json"))

    folder = f"{tmp_path}/months"
    months = lambda a, b: payload.month_ranges(spark, a, b)
    assert payload.cached(spark, folder, months("2024-01-01", "2024-02-29"), load).count() == 2
    assert payload.cached(spark, folder, months("2024-01-01", "2024-02-29"), load).count() == 2
    assert payload.cached(spark, folder, months("2024-02-01", "2024-03-31"), load).count() == 2
    assert asked == [["2024-01-01", "2024-02-01"], ["2024-03-01"]]
    a, b = (payload.snapshot_path(folder, "20240301T000000Z") for _ in range(2))
    assert a != b and a.startswith(f"{folder}/snapshots/20240301T000000Z_")


def test_requests_are_checked(spark):
    for bad in (("2024-02-01", "2024-01-01", "2025-01-01", 1, 0), ("2000-12-31", "2024-01-01", "2025-01-01", 1, 0), ("2024-01-01", "2025-01-01", "2025-01-01", 1, 0), ("2024-01-01", "2024-01-02", "2025-01-01", 0, 0), ("2024-01-01", "2024-01-02", "2025-01-01", 1, -1)):
        with pytest.raises(ValueError):
            payload.check_request(*bad)
    payload.check_request("2024-01-01", "2024-01-02", "2025-01-01", 1, 0)


def test_required_columns_and_texts(spark):
    with pytest.raises(ValueError, match="lacks T2M, WD2M"):
        pipeline.clean(raw_frame(spark).drop("T2M", "WD2M"), ["series"])
    row = spark.sql("SELECT TIMESTAMP'2024-01-01 05:00:00Z' AS t, 1234567.891D AS x").select(iso_time(F.col("t")).alias("iso"), six_digits(F.col("x")).alias("six")).first()
    assert row["iso"].startswith("2024-01-01T05:00:00") and row["six"] in ("1.23457e+06", "1234570")


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(Cluster)
    path = shared.new_path(spark, "t")
    spark.range(3).write.parquet(path)
    shared.remove(spark, path)
    shared.remove(spark, path)
    with pytest.raises(FileNotFoundError):
        payload.first_that_exists(spark, path)
