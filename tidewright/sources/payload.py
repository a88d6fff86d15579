"""Hourly API payloads: request months, validation, and rows from maps of maps; and the text, JSON and write-once files around them."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.axis import join_on

PAYLOAD = (
    "header struct<time_standard: string, fill_value: double>, geometry struct<coordinates: array<double>>, "
    "parameters map<string, struct<units: string, longname: string>>, properties struct<parameter: map<string, map<string, double>>>"
)


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with every column as text; nothing is inferred, and a blank reads as null."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).csv(path)


def months_of(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The other columns of spans and (first, last): the inclusive days of a request for each month that a span of days touches."""
    a, b = F.col(start).cast("date"), F.col(end).cast("date")
    months = spans.withColumn("_month", F.explode(F.sequence(F.trunc(a, "MM"), b, F.expr("interval 1 month"))))
    return months.withColumns({"first": F.greatest(a, F.col("_month")), "last": F.least(b, F.last_day("_month"))}).drop(start, end, "_month")


def month_ranges(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(first, last) of months_of() for one span."""
    return months_of(spark.createDataFrame([(start, end)], "start string, end string"))


def hour_keys(days: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Adds key, YYYYMMDDHH, for every hour of inclusive day ranges."""
    a, b = F.col(first).cast("timestamp_ntz"), F.col(last).cast("timestamp_ntz") + F.expr("interval 23 hours")
    return days.select("*", F.explode(F.sequence(a, b, F.expr("interval 1 hour"))).alias("hour")).withColumn("key", F.date_format("hour", "yyyyMMddHH")).drop("hour")


def first_that_exists(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, as a raw table may stand at its place or at a fallback."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return path
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document that may take many lines, as one row."""
    return spark.read.option("multiLine", True).json(path)


#: The answers worth asking again, and the longest wait between two attempts, in seconds.
TRANSIENT, LONGEST_WAIT = (408, 429), 30.0


def is_transient(status: int | None) -> bool:
    """A status worth another attempt; none stands for a connection that failed or timed out."""
    return status is None or status in TRANSIENT or status >= 500


def fetch(ask, url: str, retries: int, wait) -> object:
    """What ask(url) answers, as (status, body), for a status below 400. Transient failures are asked for again, `retries` times
    at most, after wait(seconds) of 2, 4, 8 ... LONGEST_WAIT; others raise at once. ask and wait are the caller's, so this needs no network."""
    for attempt in range(retries + 1):
        status, body = ask(url)
        if status is not None and status < 400:
            return body
        if not is_transient(status) or attempt == retries:
            raise RuntimeError(f"{url} answered {status} after {attempt + 1} attempts")
        wait(min(2.0 ** (attempt + 1), LONGEST_WAIT))


def check_request(start: str, end: str, today: str, timeout: float, retries: int) -> None:
    """What a request must meet before anything is sent; dates as YYYY-MM-DD."""
    if start > end:
        raise ValueError("start is after end")
    if start < "2001-01-01" or end >= today:
        raise ValueError("dates must lie between 2001-01-01 and yesterday")
    if timeout <= 0 or retries < 0:
        raise ValueError("timeout must be positive and retries not negative")


def parse_payloads(raw: DataFrame, column: str = "json") -> DataFrame:
    """Adds payload, parsed; a malformed text gives null."""
    return raw.withColumn("payload", F.from_json(column, PAYLOAD))


def hour_values(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parameter, key, value): one row for each parameter and hour."""
    by_name = parsed.select(*keys, F.explode("payload.properties.parameter").alias("parameter", "hours"))
    return by_name.select(*keys, "parameter", F.explode("hours").alias("key", "value"))


def payload_rows(parsed: DataFrame, keys: list[str], parameters: list[str]) -> DataFrame:
    """(keys, ts, parameters): wide hourly rows in UTC; fill values stay."""
    wide = hour_values(parsed, keys).groupBy(*keys, "key").pivot("parameter", parameters).agg(F.first("value"))
    return wide.withColumn("ts", F.to_timestamp_ntz("key", F.lit("yyyyMMddHH"))).select(*keys, "ts", *parameters)


def key_difference(values: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parameter, missing, unexpected): how each parameter's hours differ from the expected ones."""
    names = values.select(*keys, "parameter").distinct()
    want = names.join(expected.select(*[k for k in keys if k in expected.columns], "key"), [k for k in keys if k in expected.columns]) if any(k in expected.columns for k in keys) else names.crossJoin(F.broadcast(expected.select("key")))
    on = [*keys, "parameter", "key"]
    both = join_on(want.withColumn("_w", F.lit(1)), values.select(*on).withColumn("_v", F.lit(1)), on, "full")
    return both.groupBy(*keys, "parameter").agg(F.count_if(F.col("_v").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("unexpected"))


def payload_faults(latitude: float, longitude: float, parameters: list[str], tolerance: float = 1e-3) -> Column:
    """An array of what is wrong with a payload, empty for a sound one; hours are checked by key_difference()."""
    p = F.col("payload")
    spot = p["geometry"]["coordinates"]
    far = (F.abs(F.get(spot, F.lit(0)) - longitude) > tolerance) | (F.abs(F.get(spot, F.lit(1)) - latitude) > tolerance)
    lacks = [F.when(~F.array_contains(F.map_keys(m), v), F.lit(f"{v} missing in {where}")) for v in parameters for where, m in (("data", p["properties"]["parameter"]), ("metadata", p["parameters"]))]
    faults = [
        F.when(p.isNull() | p["header"].isNull() | p["properties"]["parameter"].isNull() | p["parameters"].isNull(), F.lit("sections missing")),
        F.when(~p["header"]["time_standard"].eqNullSafe(F.lit("UTC")), F.lit("time standard is not UTC")),
        F.when(F.coalesce(far, F.lit(True)), F.lit("coordinates differ")),
        *lacks,
    ]
    return F.array_compact(F.array(*faults))


def value_faults(raw: DataFrame, keys: list[str], column: str = "json") -> DataFrame:
    """(keys, parameter, key, value): the hours whose value is neither null nor a finite number, as JSON.

    Values are read as VARIANT, which keeps each one's own type, so "1", true and nested values are faults where a cast to
    double would take or hide them. A parameter that isn't a map of hours is one fault without key. A text that isn't JSON, that names a
    key twice or holds a bare NaN is no VARIANT: one row of nulls. A text without parameters has none here; that is a
    fault of payload_faults().
    """
    kind = lambda v: F.schema_of_variant(v)
    as_map = lambda v: F.expr(f"try_variant_get({v}, '$', 'map<string, variant>')")
    read = raw.select(*keys, F.try_parse_json(column).alias("_v"), F.col(column).isNotNull().alias("_told"))
    broken = read.where("_v is null and _told").select(*keys, *[F.lit(None).cast("string").alias(c) for c in ("parameter", "key", "value")])
    by_name = read.select(*keys, F.explode(F.expr("try_variant_get(_v, '$.properties.parameter', 'map<string, variant>')")).alias("parameter", "_hours"))
    by_name = by_name.withColumn("_map", F.when(kind(F.col("_hours")).startswith("OBJECT"), as_map("_hours")))
    flat = by_name.where("_map is null").select(*keys, "parameter", F.lit(None).cast("string").alias("key"), F.to_json("_hours").alias("value"))
    cells = by_name.where("_map is not null").select(*keys, "parameter", F.explode("_map").alias("key", "_value"))
    number = F.expr("try_variant_get(_value, '$', 'double')")
    numeric = kind(F.col("_value")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & (F.abs(number) < float("inf"))
    sound = F.expr("is_variant_null(_value)") | F.coalesce(numeric, F.lit(False))
    bad = cells.where(~sound).select(*keys, "parameter", "key", F.to_json("_value").alias("value"))
    return bad.unionByName(flat).unionByName(broken)


def metadata_drift(parsed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, parameter, versions): parameters whose metadata isn't the same in every payload."""
    by = by or []
    entries = parsed.select(*by, F.explode("payload.parameters").alias("parameter", "meta"))
    return entries.groupBy(*by, "parameter").agg(F.count_distinct(F.to_json("meta")).alias("versions")).where("versions > 1")


def missing_values(fill: Column) -> Column:
    """Counts values that are null or the fill value."""
    return F.count_if(F.col("value").isNull() | (F.col("value") == fill))


def completeness(rows: DataFrame, keys: list[str], days: Column, ts: str = "ts") -> DataFrame:
    """(keys, rows, distinct_hours, expected, is_complete)."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(ts).alias("distinct_hours"), F.first(days).alias("days"))
    expected = F.col("days") * 24
    return out.withColumns({"expected": expected, "is_complete": (F.col("rows") == expected) & (F.col("distinct_hours") == expected)}).drop("days")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return sorted(a.columns) == sorted(b.columns) and a.select(*b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty()


def snapshot_path(folder: str, stamp: str) -> str:
    """A place of its own for a refreshed copy, so what is there already stays as it is."""
    return f"{folder.rstrip('/')}/snapshots/{stamp}_{uuid.uuid4().hex[:8]}"


def cached(spark: SparkSession, folder: str, months: DataFrame, load) -> DataFrame:
    """The payloads of the months (first, last), as (first, last, json): those that folder holds are read, the others come from load(months) and are added.

    load gets the months that are missing and returns (first, json), more columns or not. A month is a folder by its first and last day, so a
    month is asked for once, one that was asked for in part is another, and an earlier month is never written again.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    schema = "json string, first date, last date"
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    held = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
    on = ["first", "last"]
    missing = months.join(held.select(*on).distinct(), on, "left_anti")
    if not missing.isEmpty():
        load(missing).select("first", "json").join(missing, "first").select("json", *on).write.mode("append").partitionBy(*on).parquet(folder)
    return spark.read.schema(schema).parquet(folder).join(months.select(*on), on, "left_semi").select(*on, "json")


#: Seconds after which a claim without its table counts as left by a writer that died, and between two looks.
STALE, LOOK = 3600.0, 0.5


def write_once(df: DataFrame, path: str, form: str = "parquet", stale: float = STALE, wait: float = 60.0, **options) -> bool:
    """Writes to a new place. Writing the same rows again does nothing and returns False; other rows raise FileExistsError.

    A writer first makes a claim file beside the place, which only one can, writes to a folder of its own and renames that at the
    end; so readers never see a part, and of several writers one wins. The others look for its table for `wait` seconds, then
    compare theirs or raise TimeoutError. A claim older than `stale` seconds, by the store's clock, is taken over and what its
    writer left is removed, so a write that was killed can be done again.
    """
    spark = df.sparkSession
    fs, at = _store(spark, path)
    claim, mine = f"{path.rstrip('/')}.claim", f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    until = time.monotonic() + wait
    while not fs.exists(at(path)):
        if _claimed(fs, at, claim, mine):
            try:
                df.write.format(form).options(**options).mode("errorifexists").save(mine)
                if fs.exists(at(path)) or not fs.rename(at(mine), at(path)):
                    break
                return True
            finally:
                fs.delete(at(mine), True)
                fs.delete(at(claim), False)
        if not _given_up(fs, at, claim, stale):
            if time.monotonic() > until:
                raise TimeoutError(f"another writer holds {path}")
            time.sleep(LOOK)
    if same_rows(spark.read.format(form).options(**options).schema(df.schema).load(path), df):
        return False
    raise FileExistsError(f"{path} holds other rows")


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _claimed(fs, at, claim: str, part: str) -> bool:
    """Makes the claim, which names where its writer writes; False if there is one. Making a file that mustn't exist is atomic in the store."""
    try:
        stream = fs.create(at(claim), False)
    except Py4JJavaError as e:
        if fs.exists(at(claim)) or "AlreadyExists" in str(e.java_exception):
            return False
        raise
    stream.write(bytearray(part.encode()))
    stream.close()
    return True


def _given_up(fs, at, claim: str, stale: float) -> bool:
    """Removes a claim that is older than `stale` seconds, with what its writer left; True if the claim is gone. Renaming it first lets one only do so."""
    try:
        if time.time() * 1000 - fs.getFileStatus(at(claim)).getModificationTime() < stale * 1000:
            return False
        old = f"{claim}-{uuid.uuid4().hex}"
        if not fs.rename(at(claim), at(old)):
            return False
        stream = fs.open(at(old))
        left = bytes(stream.readAllBytes()).decode()
        stream.close()
        if left:
            fs.delete(at(left), True)
        fs.delete(at(old), False)
    except Py4JJavaError as e:
        if "FileNotFound" not in str(e.java_exception):
            raise
    return True
