"""Runs that appear whole or not at all.

A run's tables and texts are written into a folder of their own; the manifest, a numbered file with every name, path, format, row
count and content hash, comes last, by a rename. Readers go through the newest manifest, so a run that stops half-way leaves the
runs before it readable; no table is overwritten or deleted. Two runs that end together get two numbers where a rename refuses a
target that exists (as HDFS does); on other file systems the writers of one folder have to take turns.

The hash of a table is the sum of its rows' 64-bit hashes, so it does not hang on the order of rows; of a text, rows are lines.
Defined results: no manifest raises ``FileNotFoundError``, an unknown name ``KeyError``; empty tables have no rows and hash 0.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factorseg.sources.tables import write_report, write_table

MANIFESTS = "_manifests"
DIGITS = 9    # manifests sort by number


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    p, fs = _path(spark, f"{folder}/{MANIFESTS}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def content(df: DataFrame) -> dict:
    """{rows, hash}: of any table, in one aggregate."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return {"rows": row["n"], "hash": str(row["h"] or 0)}


def publish(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], texts: Mapping[str, DataFrame] = {},
            fmt: str = "parquet") -> int:
    """Write a run and, when all of it is there, its manifest; returns the run's number."""
    both = set(tables) & set(texts)
    if both:
        raise ValueError(f"names of both a table and a text: {sorted(both)}")
    run, entries = f"run-{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        write_table(df, f"{folder}/{run}/{name}", fmt)
        entries[name] = {"path": f"{run}/{name}", "format": fmt, "schema": df.schema.json()}
    for name, lines in texts.items():
        write_report(lines, f"{folder}/{run}/{name}")
        entries[name] = {"path": f"{run}/{name}", "format": "text", "schema": None}
    # counts and hashes are of what can be read back
    for entry in entries.values():
        entry |= content(_load(spark, folder, entry))
    return _commit(spark, folder, {"run": run, "entries": entries})


def _commit(spark: SparkSession, folder: str, manifest: dict) -> int:
    staged, fs = _path(spark, f"{folder}/{MANIFESTS}/_staged-{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    try:
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    finally:
        out.close()
    number = max(_numbers(spark, folder), default=0)
    while True:
        number += 1
        target, _ = _path(spark, f"{folder}/{MANIFESTS}/{number:0{DIGITS}d}.json")
        if not fs.exists(target) and fs.rename(staged, target):
            return number
        if not fs.exists(target):
            raise OSError(f"the manifest cannot be written to {target}")


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """The manifest of a run, the newest by default."""
    numbers = _numbers(spark, folder)
    number = number if number is not None else max(numbers, default=None)
    if number not in numbers:
        raise FileNotFoundError(f"no finished run {number or ''} in {folder}")
    text = spark.read.text(f"{folder}/{MANIFESTS}/{number:0{DIGITS}d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _load(spark: SparkSession, folder: str, entry: dict) -> DataFrame:
    reader = spark.read.format(entry["format"])
    if entry["format"] == "csv":
        reader = reader.option("header", True)
    if entry["format"] == "text":
        return reader.load(f"{folder}/{entry['path']}")
    return reader.schema(T.StructType.fromJson(json.loads(entry["schema"]))).load(f"{folder}/{entry['path']}")


def table(spark: SparkSession, folder: str, name: str, number: int | None = None) -> DataFrame:
    """A table, or a text as rows of lines, of a finished run."""
    return _load(spark, folder, manifest(spark, folder, number)["entries"][name])


def damaged(spark: SparkSession, folder: str, number: int | None = None) -> list[str]:
    """Names whose rows or hash are no longer those of the manifest."""
    entries = manifest(spark, folder, number)["entries"]
    return [name for name, e in sorted(entries.items())
            if content(_load(spark, folder, e)) != {"rows": e["rows"], "hash": e["hash"]}]
