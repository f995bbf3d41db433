"""The first sheet of XLSX workbooks as a frame, and a writer for tests; standard library only."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from prematch.sources import store

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_EPOCH = dt.datetime(1899, 12, 30)


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    target = root.find(f"{_NS}sheets")[0].get(f"{_REL}id")
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == target:
            path = rel.get("Target").lstrip("/")
            return path if path.startswith("xl/") else f"xl/{path}"
    raise ValueError("the workbook has no sheet")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt") if re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    formats = root.find(f"{_NS}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of a workbook as strings: computed values, dates in ISO form, empty cells None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        dates = _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str | None] = []
                for k, cell in enumerate(row.iter(f"{_NS}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = cell.get("t"), cell.find(f"{_NS}v")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    elif value is not None and value.text is not None:
                        raw = value.text
                        if kind == "s":
                            cells[at] = shared[int(raw)]
                        elif kind == "b":
                            cells[at] = "true" if raw == "1" else "false"
                        elif kind is None and int(cell.get("s", 0)) in dates:
                            when = _EPOCH + dt.timedelta(days=float(raw))
                            cells[at] = when.date().isoformat() if when.time() == dt.time() else when.isoformat(sep=" ")
                        else:
                            cells[at] = raw
                row.clear()
                yield cells


def header(content: bytes) -> list[str]:
    """Column names of the first row; column_{i} where a cell is empty."""
    first = next(sheet_rows(content), [])
    return [c if c else f"column_{i}" for i, c in enumerate(first)]


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([header(x) for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["names"])


def _reader(names: list[str], rows_at_once: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(held: list[list[str | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in held], pa.string()) for k in range(len(names))], names)

        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows, held = sheet_rows(content), []
                next(rows, None)
                for row in rows:
                    held.append(row)
                    if len(held) == rows_at_once:
                        yield table(held)
                        held = []
                if held:
                    yield table(held)

    return run


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A workbook's first sheet, all columns as strings, in any store; one task, as a compressed sheet can only be read from its start."""
    if not str(path).lower().endswith((".xlsx", ".xlsm")):
        raise ValueError(f"not an XLSX workbook: {path}")
    from prematch.sources.tables import present

    books = spark.read.format("binaryFile").load(str(path)).select("content")
    names = books.mapInArrow(_headers, "names array<string>").first()["names"]
    if not names:
        return spark.createDataFrame([], StructType([]))
    return present(books.mapInArrow(_reader(names), StructType([StructField(c, StringType()) for c in names])))


def write_xlsx(path: str, rows: list[list[object]]) -> None:
    """A small workbook with one sheet (numbers, strings and dates), in any store."""
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c) if c < 26 else chr(64 + c // 26) + chr(65 + c % 26)}{r}"
            if v is None:
                continue
            if isinstance(v, dt.date):
                cells.append(f'<c r="{ref}" s="1"><v>{(dt.datetime(v.year, v.month, v.day) - _EPOCH).days}</v></c>')
            elif isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            else:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    main, rel = _NS[1:-1], _REL[1:-1]
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as book:
        book.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    store.write(path, iter([made.getvalue()]))
