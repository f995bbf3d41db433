"""Delimited, Parquet, JSON and yearly files: scans, sniffing, alignment, paging, sinks."""

from __future__ import annotations

import csv
import json
import os
import re
import urllib.request
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prematch import schema
from prematch.sources import store

DELIMITED = (".csv", ".data", ".tsv", ".txt")
EXTENSIONS = (*DELIMITED, ".xlsx", ".xlsm", ".parquet")
#: Folders that a search for files leaves out.
HEAVY = {".git", ".venv", "venv", "__pycache__", "node_modules", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".ipynb_checkpoints"}
#: First lines of answers that are no data.
NOT_DATA = ("<!doctype html", "<html", "404: not found")


def first_existing(paths: Iterable[str]) -> str:
    for p in paths:
        if store.exists(p):
            return str(p)
    raise FileNotFoundError(f"none of {list(paths)} exists")


def present(df: DataFrame) -> DataFrame:
    """String columns with the usual tokens for missing values made null."""
    made = {f.name: F.when(~F.col(f"`{f.name}`").isin(schema.MISSING_TOKENS), F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(made) if made else df


def read_csv(spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """All columns as strings, missing tokens as null; numbers and dates are read by the operators, which never raise on a cell.

    With columns the header is trusted to name them and nothing is read ahead.  Large files are
    read in splits; cells with line ends inside need ``multiline``, which makes a file one task.
    """
    if not store.exists(path, spark):
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", multiline).option("escape", '"').option("enforceSchema", False)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return present(reader.csv(str(path)))


def _beginning(path: str, n: int = 8192) -> str:
    return store.head(path, n).decode("utf-8-sig", "replace")


def sniff_separator(path: str) -> str:
    """Of comma, semicolon, tab and pipe the one the first lines use; a tab for .tsv, else a comma if nothing tells."""
    if str(path).lower().endswith(".tsv"):
        return "\t"
    try:
        return csv.Sniffer().sniff(_beginning(path), delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def looks_like_data(path: str) -> bool:
    """False for a missing or empty file and for a web page in place of one."""
    first = _beginning(path).split("\n", 1)[0].strip().lower()
    return bool(first) and not first.startswith(NOT_DATA)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """df without columns that have no value at all, names trimmed; one aggregation."""
    df = df.toDF(*[c.strip() for c in df.columns])
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the given columns: absent ones null, others dropped."""
    return df.select(*[F.col(f"`{c}`").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns meet by name, absent ones are null."""
    if not frames:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def year_of(path: str) -> int | None:
    found = re.search(r"20\d{2}", os.path.basename(path))
    return int(found[0]) if found else None


def yearly_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """All yearly workbooks of a folder as one raw table in schema.RAW_COLUMNS, ``source_year`` from the file's name."""
    from prematch.sources.xlsx import read_xlsx

    books = [p for p, is_folder in store.listed(folder, spark) if not is_folder and re.search(r"\.xls[^/]*$", p) and year_of(p)]
    frames = []
    for p in sorted(books, key=lambda p: (year_of(p), os.path.basename(p))):
        frame = aligned(drop_empty_columns(read_xlsx(spark, p)), [c for c in schema.RAW_COLUMNS if c != "source_year"])
        frames.append(frame.select(F.lit(str(year_of(p))).alias("source_year"), "*"))
    if not frames:
        raise FileNotFoundError(f"no yearly workbook in {folder}")
    return union_by_name(frames)


def history_years(spark: SparkSession, folder: str, start: int, end: int, required: tuple[str, ...] = ("tourney_id", "match_num", "tourney_date", "winner_id", "loser_id")) -> tuple[DataFrame, list[str]]:
    """(matches of all usable yearly files, why others were skipped).

    Files are read one by one and meet by name: one read of several paths
    would align them by position.
    """
    frames, skipped = [], []
    for year in range(start, end + 1):
        path = f"{folder}/atp_matches_{year}.csv"
        if not looks_like_data(path):
            skipped.append(f"{path}: missing or not a table")
            continue
        frame = read_csv(spark, path)
        absent = [c for c in required if c not in frame.columns]
        if absent:
            skipped.append(f"{path}: lacks {absent}")
            continue
        frames.append(frame)
    if not frames:
        raise FileNotFoundError(f"no usable yearly file in {folder}: {skipped}")
    return union_by_name(frames), skipped


def history_range(clean: DataFrame, start: int | None = None, end: int | None = None) -> tuple[int, int]:
    """Years of history to read: from five before the first match (1968 at least) to the last one's."""
    row = clean.agg(F.min("source_year").alias("a"), F.max("source_year").alias("b")).first()
    return start if start is not None else max(1968, int(row["a"]) - 5), end if end is not None else int(row["b"])


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's extension."""
    low = str(path).lower()
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".xlsx", ".xlsm")):
        from prematch.sources.xlsx import read_xlsx

        return read_xlsx(spark, path)
    if low.endswith(DELIMITED):
        return read_csv(spark, path, sniff_separator(path))
    raise ValueError(f"no reader for {path}")


def find_files(root: str) -> list[str]:
    """All readable files below a folder, heavy folders left out, sorted without regard to case."""
    return sorted((p for p in store.walk(root, HEAVY) if p.lower().endswith(EXTENSIONS)), key=str.lower)


def ragged_rows(spark: SparkSession, path: str, width: int, sep: str = ",") -> DataFrame:
    """Lines of a delimited file as ``width`` fields: short ones padded with "", what is over joined into the last."""
    cells = F.split("value", re.escape(sep), -1)
    n = F.size(cells)
    fixed = F.when(n <= width, F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(width) - n, F.lit(0))))).otherwise(F.concat(F.slice(cells, 1, width - 1), F.array(F.array_join(F.slice(cells, width, F.greatest(n - width + 1, F.lit(1))), sep))))
    return spark.read.text(path).select(*[F.element_at(fixed, i + 1).alias(f"column_{i + 1}") for i in range(width)])


# --- paging ---------------------------------------------------------------------------


def page(df: DataFrame, offset: int, limit: int, order: list[str | Column], total: int | None = None) -> DataFrame:
    """Rows offset .. offset + limit of df in a total order; the offset is kept within the table."""
    n = df.count() if total is None else total
    return df.orderBy(*order).offset(min(max(offset, 0), max(n - 1, 0))).limit(limit)


def next_offset(offset: int, window: int, total: int) -> int:
    return min(offset + window, max(total - window, 0))


def previous_offset(offset: int, window: int) -> int:
    return max(offset - window, 0)


def line_offset(line: int, total: int) -> int:
    """Offset of a line numbered from 1, kept within the table."""
    return max(min(line, total), 1) - 1


def peek(df: DataFrame) -> dict:
    """Shape, columns and the first three rows."""
    return {"rows": df.count(), "columns": df.columns, "head": [r.asDict() for r in df.limit(3).collect()]}


# --- sinks ------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header and ISO dates: a folder of parts, or with single one file (edge-sized results only)."""
    if not single:
        df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
        return
    part = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(part)
    store.move(next(p for p, _ in store.listed(part) if os.path.basename(p).startswith("part-")), path)
    store.delete(part)


def write_json(data: dict, path: str) -> None:
    store.write(path, iter([json.dumps(data, indent=2, default=str).encode()]))


def read_json(path: str) -> dict:
    return json.loads(store.read(path).decode())


def download(url: str, path: str, chunk: int = 1 << 20) -> None:
    """Stream a URL to a file; an error status raises before anything is written."""
    with urllib.request.urlopen(url) as answer:  # noqa: S310
        store.write(path, iter(lambda: answer.read(chunk), b""))


def download_years(template: str, folder: str, start: int, end: int) -> list[str]:
    """One file per year; template has {year}."""
    if start > end:
        raise ValueError("the first year must not be after the last")
    paths = []
    for year in range(start, end + 1):
        url = template.format(year=year)
        paths.append(f"{folder}/{year}{os.path.splitext(url)[1]}")
        download(url, paths[-1])
    return paths
