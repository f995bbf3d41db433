"""Tables in the folder that all executors share, and global row numbers made with them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prematch.sources import store


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _drop(spark: SparkSession, path: str) -> None:
    try:
        store.delete(path, spark)
    except Exception:  # the session has ended; the cluster owns what is left in its folder
        pass


def folder(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared one, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def forget(df: DataFrame) -> None:
    """Delete the table that ``written`` made of df, if it did; for a frame that nothing will read any more."""
    path = getattr(df, "_written_at", None)
    if path:
        _drop(df.sparkSession, path)


def numbered(rows: DataFrame, order: list[str | Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """rows with global numbers from 0 in the given total order (without a window over the whole table), and how many there are.

    The sorted rows are written once, so that the counts per part (as many as
    partitions; all that reaches the driver) and the numbers come from the same data.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ordered = ordered.withColumns({"_part": F.shiftrightunsigned("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    ordered = written(ordered, "numbered")
    before, starts = 0, []
    for row in sorted(ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((row["_part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    made = ordered.join(F.broadcast(offsets), "_part").select((F.col("_start") + F.col("_at")).alias(name), *rows.columns)
    return made, before
