"""Manifest of raw files: presence, size and SHA-256 per year."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prematch.sources import store


def manifest(spark: SparkSession, folder: str, start: int, end: int, extension: str = "xlsx", dataset: str = "matches", source_name: str = "", url: str = "", policy: str = "raw files are not kept in the repository", notes: str = "", paths: dict[int, str] | None = None) -> DataFrame:
    """One row per year of [start, end]: does its file exist, how long is it, what is its hash; paths names files that aren't {folder}/{year}.{extension}."""
    if start > end:
        raise ValueError("the first year must not be after the last")
    expected = [(y, (paths or {}).get(y, f"{folder}/{y}.{extension}")) for y in range(start, end + 1)]
    names = [p for _, p in expected if store.exists(p, spark)]
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")  # noqa: E731  Spark names files with their store
    if names:
        # hashed where the bytes are read; only digests move
        files = spark.read.format("binaryFile").load(names).select(plain("path").alias("_path"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256"))
    else:
        files = spark.createDataFrame([], "_path string, file_size_bytes long, sha256 string")
    expected = spark.createDataFrame(expected, "year int, local_path string").withColumn("_path", plain("local_path"))
    now = dt.datetime.now(dt.timezone.utc).isoformat()
    return expected.join(files, "_path", "left").select(
        F.lit(dataset).alias("dataset"),
        F.lit(source_name).alias("source_name"),
        F.regexp_replace(F.lit(url), r"\{year\}", F.col("year").cast("string")).alias("source_url"),
        "year",
        "local_path",
        F.lit(extension).alias("file_format"),
        F.col("sha256").isNotNull().alias("exists_locally"),
        "file_size_bytes",
        "sha256",
        F.lit(now).alias("created_at_utc"),
        F.lit(policy).alias("raw_data_policy"),
        F.lit(notes).alias("notes"),
    )
