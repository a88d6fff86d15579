"""A journal of a step's Spark work, kept as a table of JSON entries next to what the step writes.

Each entry is a file of its own, made by the session's Hadoop file system, so it lands in the store the data lands in and
can't overwrite an earlier one. A step's jobs run under a job group of the step's name, and the row counts it tells are
Spark observations, gathered while the data is written rather than by another pass.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: The kinds of entries.
KINDS = ("STARTED", "INPUT", "SOURCE", "TRANSFORMED", "WRITE_PLANNED", "WRITTEN", "OUTPUT", "SUCCEEDED", "FAILED")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def file_info(spark: SparkSession, path: str) -> dict:
    """Where a file or folder is, whether it exists, and the SHA-256 over its files' paths and contents, by Spark's tasks; null if it doesn't."""
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return {"path": path, "exists": False, "sha256": None}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).selectExpr("substring_index(path, '/', -1) as name", "sha2(content, 256) as digest")
    digests = files.selectExpr("count(*) n", "max(digest) one", "sha2(array_join(array_sort(collect_list(concat(name, digest))), ''), 256) as every").first()
    return {"path": path, "exists": True, "sha256": digests["one"] if fs.getFileStatus(target).isFile() else digests["every"]}


def inside(path: str, folder: str) -> bool:
    """Whether a path lies in a folder, compared name by name from the end of any prefix the folder has; data/raw2 isn't in data/raw."""
    names, within = ([n for n in p.split("/") if n not in ("", ".")] for p in (path, folder))
    return any(names[i : i + len(within)] == within for i in range(len(names) - len(within) + 1))


class Journal:
    """`with Journal(spark, folder, "clean", settings) as journal:` opens a step before any of its work; an end that is missing means a run that was cut off."""

    def __init__(self, spark: SparkSession, folder: str, step: str, settings: dict | None = None, sealed: tuple[str, ...] = ("data/raw",)):
        if any(inside(folder, s) for s in sealed):
            raise ValueError(f"{folder} is sealed: a journal goes elsewhere")
        self.spark, self.step, self.settings, self.n = spark, step, settings or {}, 0
        self.run = f"{step}-{time.strftime('%Y%m%d%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:10]}"
        self.folder = f"{folder.rstrip('/')}/{self.run}"
        self.watched: dict[str, Observation] = {}

    def note(self, kind: str, **details) -> None:
        if kind not in KINDS:
            raise ValueError(f"{kind} is no kind of entry")
        target, fs = _path(self.spark, f"{self.folder}/{self.n:05d}.json")
        entry = {"run": self.run, "step": self.step, "n": self.n, "at_ms": int(time.time() * 1000), "kind": kind, "details": json.dumps(details, default=str, sort_keys=True)}
        stream = fs.create(target, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        self.n += 1

    def watch(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """df with metrics that its next action gathers; tell(name) notes them."""
        self.watched[name] = Observation()
        return df.observe(self.watched[name], *[c.alias(k) for k, c in metrics.items()])

    def tell(self, name: str, kind: str = "TRANSFORMED") -> dict:
        found = self.watched[name].get
        self.note(kind, name=name, **found)
        return found

    def __enter__(self) -> Journal:
        self.note("STARTED", settings=self.settings, application=self.spark.sparkContext.applicationId)
        self.spark.sparkContext.setJobGroup(self.run, self.step)
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        self.spark.sparkContext.setLocalProperty("spark.job.description", None)
        if error is None:
            self.note("SUCCEEDED")
        else:
            self.note("FAILED", error=kind.__name__, reason=str(error)[:2000])


def read_journal(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of all runs: (run, step, n, at, kind, details)."""
    rows = spark.read.schema("run string, step string, n int, at_ms long, kind string, details string").option("recursiveFileLookup", True).json(folder)
    return rows.selectExpr("run", "step", "n", "timestamp_millis(at_ms) as at", "kind", "details")
