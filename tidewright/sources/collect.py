"""Collecting hourly payloads over HTTP: a Spark data source with one task a month, and the step that checks and publishes them."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import payload
from .journal import Journal
from .shared import written


@dataclass(frozen=True)
class Request:
    """What is asked for: whole days from start to end (YYYY-MM-DD) at one place."""

    url: str
    start: str
    end: str
    parameters: tuple[str, ...]
    latitude: float
    longitude: float
    timeout: float = 90.0
    retries: int = 3
    #: Multiplies the waits between attempts.
    patience: float = 1.0

    def options(self, months: list[tuple[str, str]]) -> dict[str, str]:
        return {"url": self.url, "parameters": ",".join(self.parameters), "latitude": str(self.latitude), "longitude": str(self.longitude), "timeout": str(self.timeout), "retries": str(self.retries), "patience": str(self.patience), "months": json.dumps(months)}


def asked(options: dict, first: str, last: str) -> str:
    """The URL of a month's request. The names of the interface's fields."""
    day = lambda d: d.replace("-", "")
    fields = {"parameters": options["parameters"], "community": "RE", "latitude": options["latitude"], "longitude": options["longitude"], "start": day(first), "end": day(last), "format": "JSON", "time-standard": "UTC"}
    return f"{options['url']}?{urlencode(fields)}"


def answer(url: str, timeout: float) -> tuple[int | None, str]:
    """(status, body) of one attempt; no status where the connection failed or timed out."""
    try:
        with urlopen(url, timeout=timeout) as got:
            return got.status, got.read().decode("utf-8", "replace")
    except HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")
    except (URLError, TimeoutError, ConnectionError) as e:
        return None, str(e)


class Month(InputPartition):
    def __init__(self, first: str, last: str):
        self.first, self.last = first, last


class PayloadReader(DataSourceReader):
    """One partition a month. A task asks again while answers are transient; another attempt of the task asks anew."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Month(*m) for m in json.loads(self.options["months"])]

    def read(self, partition: Month):
        url = asked(self.options, partition.first, partition.last)
        patience, timeout = float(self.options.get("patience", 1)), float(self.options.get("timeout", 90))
        body = payload.fetch(lambda u: answer(u, timeout), url, int(self.options.get("retries", 3)), lambda s: time.sleep(s * patience))
        yield dt.date.fromisoformat(partition.first), dt.date.fromisoformat(partition.last), url, body


class HourlyPayloads(DataSource):
    """format("hourly_payload"): (first, last, url, json), a row for each of the option `months`, a JSON list of inclusive [first, last] days."""

    @classmethod
    def name(cls) -> str:
        return "hourly_payload"

    def schema(self) -> str:
        return "first date, last date, url string, json string"

    def reader(self, schema) -> DataSourceReader:
        missing = {"url", "parameters", "latitude", "longitude", "months"} - set(self.options)
        if missing:
            raise ValueError(f"options missing: {', '.join(sorted(missing))}")
        return PayloadReader(dict(self.options))


def read_payloads(spark: SparkSession, request: Request, months: DataFrame) -> DataFrame:
    """The payloads of some months (first, last), fetched by tasks. Only the list of months is the driver's."""
    spark.dataSource.register(HourlyPayloads)
    listed = [(str(r["first"]), str(r["last"])) for r in months.select("first", "last").orderBy("first").collect()]
    return spark.read.format("hourly_payload").options(**request.options(listed)).load()


def check_payloads(raw: DataFrame, request: Request) -> None:
    """Raises on the first kinds of faults that payloads (first, last, json) have: sections, place, values, hours."""
    cells = payload.value_faults(raw, ["first"]).where(F.col("parameter").isin(*request.parameters) | F.col("parameter").isNull()).orderBy("first").limit(5).collect()
    if cells:
        raise ValueError("; ".join(f"{r['first']}: {r['parameter']} at {r['key']} is {r['value']}" if r["parameter"] else f"{r['first']}: not JSON, or a name stands twice" for r in cells))
    parsed = payload.parse_payloads(raw)
    faults = parsed.select("first", F.explode(payload.payload_faults(request.latitude, request.longitude, list(request.parameters))).alias("fault")).orderBy("first").limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{r['first']}: {r['fault']}" for r in faults))
    hours = payload.hour_keys(raw.select("first", F.col("first").alias("from"), F.col("last").alias("to")), "from", "to").select("first", "key")
    values = payload.hour_values(parsed, ["first"]).where(F.col("parameter").isin(*request.parameters))
    gaps = payload.key_difference(values, hours, ["first"]).where("missing > 0 or unexpected > 0").orderBy("first").limit(5).collect()
    if gaps:
        raise ValueError("; ".join(f"{r['first']}: {r['parameter']} lacks {r['missing']} hours and has {r['unexpected']} others" for r in gaps))


def collect_hours(
    spark: SparkSession, request: Request, folder: str, journal_folder: str, refresh: bool = False, today: str | None = None, load: Callable[[DataFrame], DataFrame] | None = None
) -> str:
    """The collection step: fetches the months that the folder lacks, checks and keeps them, and writes the hours as one table. Returns its path.

    Dates are checked before anything is asked. What is fetched is written to the shared folder and kept beside the table
    only if all of it is sound, so a bad payload publishes nothing. Parameters' metadata must be the same in every month, and every
    hour must be there once. Months kept earlier aren't asked for again, and a table that is there already stays as it is;
    refresh asks for everything and goes to a snapshot folder of its own. Values are the payloads', fill values included. load stands
    in for read_payloads(), from (first, last) to (first, last, json). The step is told in a journal.
    """
    with Journal(spark, journal_folder, "collect", {"url": request.url, "start": request.start, "end": request.end, "folder": folder, "refresh": refresh}) as journal:
        payload.check_request(request.start, request.end, today or dt.datetime.now(dt.UTC).date().isoformat(), request.timeout, request.retries)
        place = payload.snapshot_path(folder, dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%SZ")) if refresh else folder.rstrip("/")
        months = payload.month_ranges(spark, request.start, request.end)
        fetched: list[str] = []

        def sound(missing: DataFrame) -> DataFrame:
            raw = written((load or (lambda m: read_payloads(spark, request, m)))(missing), "fetched_payloads")
            check_payloads(raw, request)
            fetched.extend(str(r["first"]) for r in raw.select("first").collect())
            return raw

        kept = payload.cached(spark, f"{place}/payloads", months, sound)
        journal.note("SOURCE", fetched=sorted(fetched), months=months.count(), place=f"{place}/payloads")
        parsed = payload.parse_payloads(kept)
        drift = [r["parameter"] for r in payload.metadata_drift(parsed).where(F.col("parameter").isin(*request.parameters)).collect()]
        if drift:
            raise ValueError(f"metadata of {', '.join(sorted(drift))} isn't the same in every month")
        rows = payload.payload_rows(parsed, ["first"], list(request.parameters)).drop("first")
        rows = rows.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(request.latitude).alias("latitude"), F.lit(request.longitude).alias("longitude"), *request.parameters)
        fill = parsed.agg(F.coalesce(F.max("payload.header.fill_value"), F.lit(-999.0))).first()[0]
        days = (dt.date.fromisoformat(request.end) - dt.date.fromisoformat(request.start)).days + 1
        facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("timestamp").alias("hours"), *[F.count_if(F.col(p).isNull() | (F.col(p) == fill)).alias(p) for p in request.parameters]).first().asDict()
        if not facts["rows"] == facts["hours"] == days * 24:
            raise ValueError(f"{facts['rows']} rows of {facts['hours']} hours, not {days * 24}")
        table = f"{place}/hours_{request.start.replace('-', '')}_{request.end.replace('-', '')}"
        journal.note("WRITE_PLANNED", path=table, rows=facts["rows"], missing_values={p: facts[p] for p in request.parameters})
        new = payload.write_once(rows.repartitionByRange("timestamp").sortWithinPartitions("timestamp"), table, "csv", header=True)
        journal.note("OUTPUT", path=table, new=new)
    return table
