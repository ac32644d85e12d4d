"""Versioned tables: a new version is written whole, then a pointer is moved to it."""

from __future__ import annotations

import json
import re
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# File and version names.
POINTER = "map.current"
LEGACY = "map"
NAME_PATTERN = r"^map(_\d+)?$"


def _fs(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(base).getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish_snapshot(df: DataFrame, base: str, ts: int | None = None) -> str:
    """Write a version, count its rows file by file against what went in, and make it current.

    The pointer moves only if nobody else moves it: a lock file, which only one writer can create, is held meanwhile, and
    the pointer must still name the version that was current at the start. A failed, short or refused write leaves the
    old version to its readers. Superseded versions are removed afterwards; the legacy one is never touched.
    """
    spark = df.sparkSession
    fs, path = _fs(spark, base)
    name, before = f"{LEGACY}_{ts if ts is not None else int(time.time() * 1000)}", _pointed(spark, base)
    target = f"{base}/{name}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(target)
    rows = seen.get["rows"]
    files = spark.read.parquet(target).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    held = {r["file"]: r["rows"] for r in files.collect()}  # one row a file
    if not rows or sum(held.values()) != rows or not fs.exists(path(f"{target}/_SUCCESS")):
        fs.delete(path(target), True)
        raise ValueError(f"{rows} rows were to be published, {sum(held.values())} were written; an empty map is not published")
    _put(fs, path(f"{target}/_manifest.json"), json.dumps({"rows": rows, "files": held}), True)
    lock = path(f"{base}/{POINTER}.lock")
    try:
        _put(fs, lock, name, False)
    except Py4JJavaError as e:
        fs.delete(path(target), True)
        raise IOError(f"another writer holds {POINTER}.lock") from e
    try:
        if _pointed(spark, base) != before:
            fs.delete(path(target), True)
            raise IOError(f"{POINTER} was moved by another writer")
        tmp, ptr = path(f"{base}/{POINTER}.tmp"), path(f"{base}/{POINTER}")
        _put(fs, tmp, name, True)
        # FileContext.rename overwrites in one step: readers see the old or the new name
        ctx = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        option = spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        ctx.rename(fs.makeQualified(tmp), fs.makeQualified(ptr), options)
        for st in fs.listStatus(path(base)):
            old = st.getPath().getName()
            if st.isDirectory() and re.match(NAME_PATTERN, old) and old not in (name, LEGACY):
                fs.delete(st.getPath(), True)
    finally:
        fs.delete(lock, False)
    return name


def _put(fs, path, text: str, overwrite: bool) -> None:
    out = fs.create(path, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def _pointed(spark: SparkSession, base: str) -> str:
    fs, path = _fs(spark, base)
    if not fs.exists(path(f"{base}/{POINTER}")):
        return ""
    lines = spark.read.text(f"{base}/{POINTER}").take(1)
    return lines[0][0].strip() if lines else ""


def current_name(spark: SparkSession, base: str) -> str:
    """Name of the current version; the legacy one when the pointer is missing, odd or dangling."""
    fs, path = _fs(spark, base)
    name = _pointed(spark, base)
    return name if re.match(NAME_PATTERN, name) and fs.exists(path(f"{base}/{name}")) else LEGACY


def read_current(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{current_name(spark, base)}")
