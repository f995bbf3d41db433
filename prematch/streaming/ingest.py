"""Raw match files as a stream: the same cleaning, file by file as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from prematch import schema
from prematch.operators import clean
from prematch.sources import tables


def raw_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """CSV files of schema.RAW_COLUMNS that appear in a folder."""
    fields = T.StructType([T.StructField(c, T.StringType()) for c in schema.RAW_COLUMNS])
    return tables.present(spark.readStream.schema(fields).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder))


def clean_stream(raw: DataFrame) -> DataFrame:
    """Cleaned matches, as ``clean.normalize`` makes them of all files together, in whatever order and portions these come.

    Repeats of a raw row are dropped by a digest of it.  A match is as old as its day, and files
    of earlier years may come after later ones, so event time bounds nothing: the state keeps one digest of
    32 bytes for each distinct row ever seen.
    """
    names = sorted(raw.columns)
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)
    distinct = raw.withColumn("_digest", F.unhex(digest)).dropDuplicates(["_digest"]).drop("_digest")
    return clean.normalize_distinct(distinct)


def start(spark: SparkSession, folder: str, output: str, checkpoint: str, files_per_trigger: int = 16) -> StreamingQuery:
    """Clean what is there and what comes, once per call, into Parquet; the digests lie in RocksDB under the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return clean_stream(raw_stream(spark, folder, files_per_trigger)).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
