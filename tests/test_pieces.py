"""Long series in pieces: the same for every piece size and session zone, and grouped quantiles by ranges."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import analytics, axis, features, impute, ingest, quality, ranks

START = dt.datetime(2016, 3, 1)


@pytest.fixture(params=["UTC", "Asia/Tehran", "America/New_York"])
def zone(spark, request):
    """Years with hours that the zone skips and repeats."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def hours_of(spark, n, values, key="s"):
    base = spark.range(n).selectExpr("id", "timestamp_ntz'2016-03-01' + make_interval(0, 0, 0, 0, cast(id as int)) as ts")
    cells = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    return base.join(cells, "id").select(F.lit(key).alias("k"), "ts", "x")


def some(n, share=0.3, kinds=3, seed=1):
    rng = random.Random(seed)
    return [None if rng.random() < share else float(rng.randrange(kinds)) for _ in range(n)]


def test_hours_are_the_calendars(spark, zone):
    """Differences and floors of local hours, through half a year with both changes of clocks."""
    df = hours_of(spark, 6000, some(6000))
    got = df.select("ts", axis.hour_number(F.col("ts")).alias("n"), axis.hour_of(F.col("ts") + F.expr("interval 59 minutes")).alias("h"), axis.floor_to("DAY", F.col("ts")).alias("d"), axis.floor_to("MONTH", F.col("ts")).alias("m")).collect()
    assert len({r["ts"] for r in got}) == 6000
    for r in got:
        t = r["ts"]
        assert r["n"] == (t - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=1) and r["h"] == t and r["d"] == dt.datetime(t.year, t.month, t.day) and r["m"] == dt.datetime(t.year, t.month, 1)


def test_instants_that_the_zone_repeats(spark, zone):
    texts = ["2016-11-06T05:30:00Z", "2016-11-06T06:30:00Z", "2016-09-20T19:30:00Z", "2016-09-20T20:30:00Z", "2016-03-13T07:30:00Z"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ingest.to_local(ingest.parse_time(F.col("t")), "Asia/Ho_Chi_Minh").alias("l")).collect()
    assert [r["l"] for r in got] == [dt.datetime.fromisoformat(t[:-1]) + dt.timedelta(hours=7) for t in texts]
    faults = spark.createDataFrame([("2016-01-01T00:00:00Z",), ("2016-01-01T00:30:00Z",)], "t string").agg(*[c.alias(k) for k, c in ingest.time_faults(F.col("t")).items()]).first()
    assert faults["off_hour"] == 1


def test_frames_in_pieces_are_the_wholes(spark, zone):
    """The case that went wrong: a 48-row mean across the edges of pieces."""
    df = hours_of(spark, 6000, [float(i % 7) for i in range(6000)])
    mean = lambda d, k: d.withColumn("m", features.rolling("x", 48, axis.by_time(k), F.avg))
    whole = {r["ts"]: r["m"] for r in mean(df, ["k"]).collect()}
    for hours in (96, 4096):
        got = {r["ts"]: r["m"] for r in axis.chunked(df, mean, ["k"], 47, 0, hours).collect()}
        assert got == whole and sum(v is None for v in got.values()) == 47


def runs_by_hand(values):
    out, run = [], 0
    for i, v in enumerate(values):
        run += i == 0 or v != values[i - 1]
        out.append(run)
    return out


@pytest.mark.parametrize("hours", [1, 2, 5, 24, 4096])
def test_scans_in_pieces(spark, hours):
    for seed, share in ((1, 0.5), (2, 0.97), (3, 0.0)):
        values = some(150, share, 2, seed)
        df = hours_of(spark, 150, values).unionByName(hours_of(spark, 150, values[::-1], None))
        flags = [v is None for v in values]
        ids = runs_by_hand(flags)
        got = {(r["k"], r["ts"]): r["run_id"] for r in axis.with_run(df, F.col("x").isNull(), ["k"], hours=hours).collect()}
        assert [got[("s", START + dt.timedelta(hours=i))] for i in range(150)] == ids
        assert [got[(None, START + dt.timedelta(hours=i))] for i in range(150)] == runs_by_hand(flags[::-1])
        gaps = {r["ts"]: r["gap_length"] for r in axis.gap_lengths(df.where("k = 's'"), "x", ["k"], hours=hours).collect()}
        assert [gaps[START + dt.timedelta(hours=i)] for i in range(150)] == [ids.count(ids[i]) if flags[i] else 0 for i in range(150)]
        want = sorted((START + dt.timedelta(hours=ids.index(r)), ids.count(r)) for r in set(ids) if flags[ids.index(r)])
        assert sorted((r["start"], r["hours"]) for r in axis.runs(df.where("k = 's'"), F.col("x").isNull(), ["k"], hours=hours).collect()) == want


@pytest.mark.parametrize("hours", [1, 3, 50, 4096])
def test_islands_on_a_sparse_axis(spark, hours):
    df = hours_of(spark, 200, some(200, 0.4, 9, 5)).where("x is not null")
    times = sorted(r["ts"] for r in df.collect())
    want, n = {}, 0
    for i, t in enumerate(times):
        n += i == 0 or t - times[i - 1] != dt.timedelta(hours=1)
        want[t] = n
    assert {r["ts"]: r["island"] for r in axis.islands(df, ["k"], hours=hours).collect()} == want
    assert axis.islands(df.limit(0), ["k"], hours=hours).count() == 0


def test_no_task_holds_a_series(spark):
    """Windows of a scan go by series and piece; over whole series they go over the pieces' few rows only."""
    df = hours_of(spark, 100, some(100)).withColumn("k", F.when(F.hour("ts") >= 0, "s"))
    plan = axis.with_run(df, F.col("x").isNull(), ["k"], hours=10)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(_series" in plan and "_piece" in plan


@pytest.mark.parametrize("most", [1, 2, 5])
def test_causal_fill_in_pieces(spark, most):
    values = [None, None, 1.0, None, None, 2.0, None, None, None, 3.0, *some(100, 0.6, 9, 4), 5.0, None, None]
    df = hours_of(spark, len(values), values)
    ids, flags = runs_by_hand([v is None for v in values]), [v is None for v in values]
    want, last = [], None
    for i, v in enumerate(values):
        last = v if v is not None else last
        want.append(last if flags[i] and ids.count(ids[i]) <= most else v)
    for hours in (1, 2, 7, 4096):
        rows = sorted((r["ts"], r["x"], r["filled_x"]) for r in impute.carry_forward(df, ["x"], ["k"], most=most, hours=hours).collect())
        assert [r[1] for r in rows] == want and [r[2] for r in rows] == [a is None and b is not None for a, b in zip(values, want, strict=True)]


def test_flat_runs_and_events_across_pieces(spark, monkeypatch):
    """Rules that have no parameter for the piece take the module's: a run over an edge stays one."""
    df = hours_of(spark, 9000, [1.0 if 4090 <= i < 4105 else float(i) for i in range(9000)])
    long = df.select("k", "ts", F.lit("v").alias("variable"), F.col("x").alias("value"))
    flat = quality.flag_flat(long, ["k"]).collect()
    assert len(flat) == 15 and {r["score"] for r in flat} == {15 / 12}
    found = quality.events(quality.flag_flat(long, ["k"]), ["k"]).collect()
    assert [(r["hours"], r["start"]) for r in found] == [(15, START + dt.timedelta(hours=4090))]


def test_group_quantiles(spark):
    rng = np.random.default_rng(5)
    groups = {
        "a": rng.normal(size=400), "ties": np.repeat([3.0, 7.0], 50), "one": np.array([2.5]), "near": 1e9 + rng.random(200) * 1e-3, "tiny": rng.random(99) * 1e-310,
        "mixed": np.array([-np.inf, -5, -0.0, 0.0, 0.0, 1e-300, 8, np.inf]), None: rng.integers(-5, 6, 101).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = (0.0, 0.01, 0.25, 0.5, 0.995, 1.0)
    got = {r["g"]: r for r in ranks.group_quantiles(df, ["g"], F.col("v"), shares).collect()}
    assert set(got) == {*groups, "none"} and got["none"]["n"] == 0 and set(got["none"]["q"]) == {None}
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        if g != "mixed":
            np.testing.assert_allclose(got[g]["q"], np.quantile(vs, shares), rtol=1e-12)
    assert got["mixed"]["q"][3] == 0.0 and got["mixed"]["q"][-1] == np.inf
    few = {r["g"]: r for r in ranks.group_quantiles(df, ["g"], F.col("v"), shares, most=ranks.largest_group(df, ["g"])).collect()}
    assert set(few) == set(got) and all(few[g]["n"] == got[g]["n"] for g in got)
    for g in groups:
        if g != "mixed":
            np.testing.assert_allclose(few[g]["q"], got[g]["q"], rtol=1e-12)
    whole = ranks.group_quantiles(df.where("g = 'a'"), [], F.col("v"), (0.5,)).collect()
    assert len(whole) == 1 and whole[0]["q"][0] == pytest.approx(np.median(groups["a"]))
    assert ranks.group_quantiles(df.limit(0), ["g"], F.col("v"), (0.5,)).count() == 0
    ordered = spark.createDataFrame([(float(v),) for v in sorted({*groups["a"], *groups["near"], -1e300, 1e300, 5e-324, -5e-324, 0.0, np.inf, -np.inf})], "v double").select("v", ranks.value_range(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in ordered] == sorted(r["r"] for r in ordered)


def test_spans_hold_points(spark):
    rng = random.Random(3)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    points = [(rng.choice(["a", None]), i, at(rng.randrange(-500, 20_000))) for i in range(400)] + [("a", 900, at(100)), ("a", 901, at(160)), ("a", 902, None)]
    spans = [(rng.choice(["a", None]), f"e{i}", (m := rng.randrange(15_000)), m + rng.choice([0, 5, 90, 9000])) for i in range(40)] + [("a", "edge", 100, 160), ("a", "back", 50, 40)]
    p = spark.createDataFrame(points, "k string, i int, ts timestamp_ntz")
    s = spark.createDataFrame([(k, e, at(a), at(b)) for k, e, a, b in spans] + [("a", "open", at(0), None)], "k string, e string, start timestamp_ntz, end timestamp_ntz")
    want = sorted((i, e) for k, i, t in points for q, e, a, b in spans if k == q and t is not None and at(a) <= t <= at(b))
    for minutes in (7, 1440):
        joined = axis.within(p, s, ["k"], minutes=minutes)
        assert sorted((r["i"], r["e"]) for r in joined.collect()) == want
    assert not {"NestedLoop", "Cartesian"} & {w for w in ("NestedLoop", "Cartesian") if w in joined._jdf.queryExecution().toString()}


@pytest.mark.parametrize("hours", [5, 40, 4096])
def test_autocorrelation_in_pieces(spark, hours):
    rng = np.random.default_rng(2)
    values = [None if rng.random() < 0.1 else float(v) for v in 1e6 + np.cumsum(rng.normal(size=300))]
    df = hours_of(spark, 300, values).unionByName(hours_of(spark, 60, [7.0] * 60, None))
    got = {(r["k"], r["lag"]): r["acf"] for r in analytics.autocorrelation(df, "x", [0, 1, 3, 24, 50], ["k"], hours=hours).collect()}
    x = np.array([np.nan if v is None else v for v in values])
    for k in (1, 3, 24, 50):
        a, b = x[k:], x[:-k]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert got[("s", k)] == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-9)
    assert got[("s", 0)] == 1.0 and got[(None, 1)] is None and len(got) == 10


def windowed(spark, n=130, edit=None):
    rows = [(START + dt.timedelta(hours=i), float(i), float(-i), 100.0 + i, "none" if i < 47 or i % 3 else ("train" if i < 90 else "test")) for i in range(n)]
    rows = edit(rows) if edit else rows
    return spark.createDataFrame([("s", *r) for r in rows], "k string, ts timestamp_ntz, a double, b double, y double, split string").repartition(3)


@pytest.mark.parametrize("hours", [10, 48, 4096])
def test_window_shards(spark, hours, zone):
    df = windowed(spark)
    shards = features.window_shards(df, ["a", "b"], ["y"], ["k"], hours=hours, target_scale=(100.0, 2.0))
    features.check_shards(shards, ["k"])
    got = {r["ts"]: r for r in features.read_windows(shards, ["k"], 2, 1, batch=7).collect()}
    assert len(got) == sum(i >= 47 and i % 3 == 0 for i in range(130))
    for i in range(48, 130, 3):
        r = got[START + dt.timedelta(hours=i)]
        assert np.array_equal(np.array(r["X"]).reshape(48, 2), [[j, -j] for j in range(i - 47, i + 1)]) and r["y"] == [i / 2] and r["split"] == ("train" if i < 90 else "test")
    assert features.read_windows(shards, ["k"], 2, 1, "test").count() == sum(i >= 90 and i % 3 == 0 for i in range(130))
    # Each row's features once but for the rows before a piece.
    size = shards.agg(F.sum(F.octet_length("x"))).first()[0]
    assert size <= (130 + 47 * (-(-130 // hours) + 1)) * 8


def test_window_shards_refuse(spark):
    def faults(edit, match):
        for hours in (10, 4096):
            with pytest.raises(ValueError, match=match):
                features.check_shards(features.window_shards(windowed(spark, edit=edit), ["a", "b"], ["y"], ["k"], hours=hours), ["k"])

    faults(lambda rows: rows[:60] + rows[61:], "without breaks")
    faults(lambda rows: rows[:50] + rows[120:], "without breaks")
    faults(lambda rows: rows[30:], "lack 48 hours")
    faults(lambda rows: [(t, None if i == 60 else a, *rest) for i, (t, a, *rest) in enumerate(rows)], "hold nulls")
    faults(lambda rows: [(t, a, b, None if i == 60 else y, s) for i, (t, a, b, y, s) in enumerate(rows)], "hold nulls")
    assert features.read_windows(features.window_shards(windowed(spark).limit(0), ["a"], ["y"], ["k"]), ["k"], 1, 1).count() == 0
