"""The collection step against a server on this machine, tables written once by several writers, values as VARIANT, and the cleaning step's counts."""

import calendar
import datetime as dt
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tests.test_series import raw_frame
from tidewright.plans import pipeline
from tidewright.sources import collect, payload
from tidewright.sources.journal import read_journal

NAMES = ("T2M", "PS")


def body_of(first, last, edit=None):
    hours = [(first + dt.timedelta(hours=i)).strftime("%Y%m%d%H") for i in range(((last - first).days + 1) * 24)]
    made = {
        "header": {"time_standard": "UTC", "fill_value": -999.0}, "geometry": {"type": "Point", "coordinates": [105.8542, 21.0285, 12.0]},
        "parameters": {n: {"units": "C", "longname": n} for n in NAMES}, "properties": {"parameter": {n: {h: (i % 24) + k for i, h in enumerate(hours)} for k, n in enumerate(NAMES)}}}
    if edit:
        edit(made, first)
    return json.dumps(made)


@pytest.fixture
def server():
    """Answers months; `plan` gives the statuses of the first answers for a first day, `edit` changes bodies."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            first, last = (dt.datetime.strptime(asked[k], "%Y%m%d") for k in ("start", "end"))
            with self.server.lock:
                self.server.asked[asked["start"]] += 1
                todo = self.server.plan.get(asked["start"], [])
                status = todo.pop(0) if todo else 200
            self.server.fields = asked
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body_of(first, last, self.server.edit).encode() if status == 200 else b"no")

        def log_message(self, *args):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    made.asked, made.plan, made.edit, made.lock = Counter(), {}, None, threading.Lock()
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()


def request(server, start="2024-01-30", end="2024-02-02", **more):
    return collect.Request(f"http://127.0.0.1:{server.server_port}/hourly", start, end, NAMES, 21.0285, 105.8542, **{"timeout": 5.0, "retries": 2, "patience": 0.0, **more})


def test_collects_months_and_retries(spark, server, tmp_path):
    server.plan = {"20240130": [429, 500], "20240201": [503]}
    table = collect.collect_hours(spark, request(server), f"{tmp_path}/raw", f"{tmp_path}/log", today="2024-03-01")
    assert server.asked == {"20240130": 3, "20240201": 2}
    assert server.fields["parameters"] == "T2M,PS" and server.fields["time-standard"] == "UTC" and server.fields["latitude"] == "21.0285"
    rows = payload.read_text_table(spark, table, ["timestamp", "latitude", "longitude", *NAMES]).orderBy("timestamp").collect()
    assert len(rows) == 96 and rows[0]["timestamp"] == "2024-01-30T00:00:00Z" and rows[-1]["timestamp"] == "2024-02-02T23:00:00Z" and (rows[5]["T2M"], rows[5]["PS"]) == ("5.0", "6.0")
    # Again: nothing is asked for, the table stays. A longer span asks for what is missing.
    assert collect.collect_hours(spark, request(server), f"{tmp_path}/raw", f"{tmp_path}/log", today="2024-03-01") == table and sum(server.asked.values()) == 5
    collect.collect_hours(spark, request(server, end="2024-02-29"), f"{tmp_path}/raw", f"{tmp_path}/log", today="2024-03-01")
    assert server.asked == {"20240130": 3, "20240201": 3}
    kinds = [r["kind"] for r in read_journal(spark, f"{tmp_path}/log").orderBy("run", "n").collect()]
    assert Counter(kinds) == {"STARTED": 3, "SOURCE": 3, "WRITE_PLANNED": 3, "OUTPUT": 3, "SUCCEEDED": 3}


def test_refresh_leaves_what_is_there(spark, server, tmp_path):
    first = collect.collect_hours(spark, request(server), f"{tmp_path}/raw", f"{tmp_path}/log", today="2024-03-01")
    server.edit = lambda made, day: made["properties"]["parameter"]["PS"].update({h: -999.0 for h in list(made["properties"]["parameter"]["PS"])[:2]})
    second = collect.collect_hours(spark, request(server), f"{tmp_path}/raw", f"{tmp_path}/log", refresh=True, today="2024-03-01")
    assert second != first and "/snapshots/" in second and sum(server.asked.values()) == 4
    fills = lambda t: spark.read.option("header", True).csv(t).where("PS = '-999.0'").count()
    assert (fills(first), fills(second)) == (0, 4)
    planned = [json.loads(r["details"]) for r in read_journal(spark, f"{tmp_path}/log").where("kind = 'WRITE_PLANNED'").collect()]
    assert sorted(p["missing_values"]["PS"] for p in planned) == [0, 4]


BROKEN = {
    "lacks 1 hours": lambda made, day: made["properties"]["parameter"]["PS"].pop(list(made["properties"]["parameter"]["PS"])[3]),
    "time standard": lambda made, day: made["header"].update(time_standard="LST"),
    "PS missing in data": lambda made, day: made["properties"]["parameter"].pop("PS"),
    "coordinates": lambda made, day: made["geometry"].update(coordinates=[1.0, 2.0]),
    "is true": lambda made, day: made["properties"]["parameter"]["PS"].update({list(made["properties"]["parameter"]["PS"])[0]: True}),
    "same in every month": lambda made, day: made["parameters"]["PS"].update(units=str(day.month)),
}


@pytest.mark.parametrize("fault", BROKEN)
def test_a_bad_payload_publishes_nothing(spark, server, tmp_path, fault):
    server.edit = BROKEN[fault]
    with pytest.raises(ValueError, match=fault):
        collect.collect_hours(spark, request(server), f"{tmp_path}/raw", f"{tmp_path}/log", today="2024-03-01")
    assert not list((tmp_path / "raw").glob("hours_*"))
    last = read_journal(spark, f"{tmp_path}/log").orderBy("n").collect()[-1]
    assert last["kind"] == "FAILED" and fault in last["details"]


def test_answers_that_stay_bad(spark, server, tmp_path):
    server.plan = {"20240130": [503] * 99}
    with pytest.raises(Exception, match="503 after 3 attempts"):
        collect.read_payloads(spark, request(server), payload.month_ranges(spark, "2024-01-30", "2024-01-31")).collect()
    asked = server.asked["20240130"]
    server.plan = {"20240130": [422] * 99}
    with pytest.raises(Exception, match="422 after 1 attempts"):
        collect.read_payloads(spark, request(server), payload.month_ranges(spark, "2024-01-30", "2024-01-31")).collect()
    assert asked % 3 == 0 and server.asked["20240130"] > asked
    quiet = server.asked.copy()
    with pytest.raises(ValueError, match="yesterday"):
        collect.collect_hours(spark, request(server), f"{tmp_path}/raw", f"{tmp_path}/log", today="2024-02-02")
    assert server.asked == quiet
    gone = collect.Request("http://127.0.0.1:9/none", "2024-01-30", "2024-01-30", NAMES, 0.0, 0.0, timeout=1.0, retries=0)
    with pytest.raises(Exception, match="None after 1 attempts"):
        collect.read_payloads(spark, gone, payload.month_ranges(spark, "2024-01-30", "2024-01-30")).collect()


def test_source_is_one_task_a_month(spark, server):
    months = payload.month_ranges(spark, "2024-01-15", "2024-04-02")
    rows = collect.read_payloads(spark, request(server), months)
    assert rows.rdd.getNumPartitions() == 4
    got = {(str(r["first"]), str(r["last"])) for r in rows.select("first", "last").collect()}
    assert got == {("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-31"), ("2024-04-01", "2024-04-02")}
    assert calendar.monthrange(2024, 2)[1] == 29


def test_values_keep_their_types(spark):
    cells = {"01": "1", "02": "1.5e3", "03": "null", "04": '"1"', "05": "true", "06": "[1]", "07": '{"a":{"b":2}}', "08": '"a \\"quoted\\" one"', "09": "12345678901234567890123", "10": "-0.0"}
    text = '{"properties":{"parameter":{"A":{' + ",".join(f'"{k}":{v}' for k, v in cells.items()) + '},"odd \\"key\\"":{"k \\"q\\"":false},"B":7,"C":[],"D":null}}}'
    rows = [(1, text), (2, '{"properties":{"parameter":{"A":{"01":1,"01":2}}}}'), (3, '{"properties":{"parameter":{"A":{"01":NaN}}}}'), (4, "nothing"), (5, "{}"), (6, None), (7, '{"properties":{"parameter":{"A":{"01":2}}}}')]
    got = {(r["i"], r["parameter"], r["key"]): r["value"] for r in payload.value_faults(spark.createDataFrame(rows, "i int, json string"), ["i"]).collect()}
    assert got == {
        (1, "A", "04"): '"1"', (1, "A", "05"): "true", (1, "A", "06"): "[1]", (1, "A", "07"): '{"a":{"b":2}}', (1, "A", "08"): '"a \\"quoted\\" one"', (1, 'odd "key"', 'k "q"'): "false",
        (1, "B", None): "7", (1, "C", None): "[]", (1, "D", None): "null", (2, None, None): None, (3, None, None): None, (4, None, None): None}


def test_two_writers_give_one_table(spark, tmp_path):
    """Both write at once: one wins, the other compares; with other rows the loser raises."""
    path, out = f"{tmp_path}/t", []
    slow = spark.range(20).repartition(2)

    def write(df):
        try:
            out.append(payload.write_once(df, path))
        except FileExistsError:
            out.append("other rows")

    def together(*tables):
        out.clear()
        threads = [threading.Thread(target=write, args=(df,)) for df in tables]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        return sorted(map(str, out))

    assert together(slow, slow, slow) == ["False", "False", "True"]
    assert spark.read.parquet(path).count() == 20
    assert together(spark.range(5), spark.range(20)) == ["False", "other rows"]
    path = f"{tmp_path}/u"
    assert together(spark.range(5), spark.range(6)) == ["True", "other rows"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t", "u"]


def test_a_killed_write_can_be_done_again(spark, tmp_path):
    """A claim with part of a table behind it keeps others waiting while it is fresh, and is cleared once it is stale."""
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(f"{path}.part-dead")
    (tmp_path / "t.claim").write_text(f"{path}.part-dead")
    with pytest.raises(TimeoutError, match="another writer"):
        payload.write_once(spark.range(4), path, wait=0.6)
    assert (tmp_path / "t.part-dead").exists()
    time.sleep(1.1)
    assert payload.write_once(spark.range(4), path, stale=1.0, wait=0.0) is True
    assert spark.read.parquet(path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["t"]
    # A write that fails leaves neither claim nor part.
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        payload.write_once(spark.range(4).selectExpr("1 div (id - id) as x"), f"{tmp_path}/v")
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_steps_of_cleaning(spark):
    def edit(d):
        d[10]["T2M"], d[11]["RH2M"], d[12]["PS"], d[5]["WD2M"], d[6]["WD2M"], d[20]["PS"] = "-999", "130", "abc", "360", "360", ""
        for i in (30, 31, 32, 33, 34):
            d[i]["WS2M"] = ""
        d.append(dict(d[40]))
        del d[50]
        d[60]["T2M"] = "45"

    steps = pipeline.clean(raw_frame(spark, 72, edit), ["series"]).steps
    assert steps["before"]["rows"] == 72 and steps["exact_duplicates_removed"]["rows"] == 1 and steps["inserted_hours"]["rows"] == 1 and steps["after"]["rows"] == 72
    assert steps["invalid_to_null"] | {} == {"T2M": 1, "PRECTOTCORR": 0, "RH2M": 1, "PS": 2, "WS2M": 5, "WD2M": 0, "ALLSKY_SFC_SW_DWN": 0}
    assert steps["blank"]["WS2M"] == 5 and steps["blank"]["PS"] == 1 and steps["folded_360_to_0"] == {"WD2M": 2}
    assert steps["missing_before_fill"]["PS"] == 3 and steps["filled"]["PS"] == 3 and steps["missing_after_fill"] == {n: 5 if n == "WS2M" else 0 for n in steps["filled"]}
    assert steps["flags_kept"]["hourly_jump"] == 2 and steps["max"]["T2M"] == 45 and steps["after"]["start"] == dt.datetime(2023, 1, 1, 7)


def test_steps_of_an_empty_table(spark):
    result = pipeline.clean(raw_frame(spark, 3).limit(0), ["series"], validate=False)
    assert result.clean.count() == 0 and result.steps["before"]["rows"] == 0 and result.steps["after"]["rows"] == 0


def test_directions_are_rounded_when_written(spark, tmp_path):
    result = pipeline.clean(raw_frame(spark, 72, lambda d: [r.update(WD2M=x) for r, x in zip(d, ["10.25", "10.35", "10.05", "10.15"], strict=False)] and None), ["series"])
    pipeline.write_clean(result, f"{tmp_path}/c", ["series"], least_rows=1)
    rows = pipeline.load_clean(spark, f"{tmp_path}/c", ["series"]).orderBy("ts").limit(4).collect()
    assert [r["WD2M"] for r in rows] == [10.2, 10.4, 10.0, 10.2]
    told = json.loads(spark.read.text(f"{tmp_path}/c/steps").first()["value"])
    assert told["after"]["rows"] == 72 and result.clean.where(F.col("WD2M") == 10.25).count() == 1
