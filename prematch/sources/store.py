"""Files in whatever store their paths name, through Hadoop's file systems: the driver's disk has no part in it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


def _of(path: str, spark: SparkSession | None = None):
    """(path, its file system)"""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("files are reached through a Spark session, and none is active")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _name(path, like: str) -> str:
    """A path as its parent was given: with its store only if that had one."""
    return path.toString() if "://" in str(like) or str(like).startswith("file:") else path.toUri().getPath()


def exists(path: str, spark: SparkSession | None = None) -> bool:
    where, store = _of(path, spark)
    return store.exists(where)


def head(path: str, n: int = 8192, spark: SparkSession | None = None) -> bytes:
    """The first bytes of a file; none if there is no such file."""
    where, store = _of(path, spark)
    if not store.exists(where) or store.getFileStatus(where).isDirectory():
        return b""
    stream = store.open(where)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def listed(folder: str, spark: SparkSession | None = None) -> list[tuple[str, bool]]:
    """(path, is it a folder) of what lies in a folder, by name; none if there is no such folder."""
    where, store = _of(folder, spark)
    if not store.exists(where):
        return []
    return sorted((_name(f.getPath(), folder), f.isDirectory()) for f in store.listStatus(where))


def walk(root: str, leave_out: set[str], spark: SparkSession | None = None) -> Iterator[str]:
    """All files below a folder but those in folders of the given names."""
    for path, is_folder in listed(root, spark):
        if not is_folder:
            yield path
        elif path.rstrip("/").rsplit("/", 1)[-1] not in leave_out:
            yield from walk(path, leave_out, spark)


def write(path: str, parts: Iterator[bytes], spark: SparkSession | None = None) -> None:
    """A file of the given parts, its folders made, in place of one that is there; a failed write leaves nothing."""
    where, store = _of(path, spark)
    stream = store.create(where, True)
    try:
        for part in parts:
            stream.write(bytearray(part))
    except BaseException:
        stream.close()
        store.delete(where, False)
        raise
    stream.close()


def read(path: str, spark: SparkSession | None = None) -> bytes:
    where, store = _of(path, spark)
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def move(source: str, target: str, spark: SparkSession | None = None) -> None:
    """Rename within a store, in place of what is there."""
    where, store = _of(source, spark)
    to, _ = _of(target, spark)
    store.delete(to, True)
    if to.getParent() is not None:
        store.mkdirs(to.getParent())
    if not store.rename(where, to):
        raise OSError(f"can't move {source} to {target}")


def delete(path: str, spark: SparkSession | None = None) -> None:
    where, store = _of(path, spark)
    store.delete(where, True)
