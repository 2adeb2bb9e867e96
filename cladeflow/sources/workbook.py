"""Spreadsheet workbooks (.xlsx) as a Spark source: ``spark.read.format("workbook").option("sheet", ...).load(path)``.

A workbook is a zip of XML files. Planning reads the list of sheets and, of each that is asked for, the first row, which gives the columns, all text, and the number of the
last row. A partition is a range of a sheet's rows: its task opens the workbook by its path (a folder that all machines share, or hdfs, s3, gs: what
pyarrow opens), streams the sheet's XML and keeps the cells of its own rows, ROWS at most; then the shared strings are streamed, and those that its rows
name are kept. Neither the driver nor a task holds a whole sheet.

Cells: texts as they are, numbers as written, booleans as TRUE or FALSE, empty and error cells null. A sheet is named, or numbered from 0. Sheets of "*" follow each
other, with a column ``sheet`` first, and must have the same header. A row without any value is left out. A sheet without rows gives no rows.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from xml.etree import ElementTree

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: rows of a partition
ROWS = 50_000
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@contextmanager
def opened(path: str) -> Iterator[zipfile.ZipFile]:
    """The workbook at a path, read where it is asked for."""
    system, place = FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
    with system.open_input_file(place) as raw, zipfile.ZipFile(raw) as book:
        yield book


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of each sheet, in order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return [(s.get("name"), t.lstrip("/") if (t := links[s.get(LINK)]).startswith("/") else f"xl/{t}") for s in found]


def chosen(book: zipfile.ZipFile, sheet: str | None) -> list[tuple[str, str]]:
    """The sheets that "sheet" asks for; ValueError where there is none."""
    found = sheets(book)
    if sheet == "*":
        return found
    named = [s for s in found if s[0] == sheet]
    if not named and (sheet is None or re.fullmatch(r"\d+", sheet)):
        named = found[int(sheet or 0) :][:1]
    if not named:
        raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in found]}")
    return named


def column_of(cell: str) -> int:
    """The column of a place such as AB12, from 0."""
    n = 0
    for c in cell:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def rows_of(book: zipfile.ZipFile, file: str, first: int, last: int | None) -> Iterator[tuple[int, dict[int, tuple[str, str | None]]]]:
    """(number from 1, column -> (kind, value)) of the rows first .. last - 1, one at a time."""
    number = 0
    with book.open(file) as raw:
        rows = None
        for event, e in ElementTree.iterparse(raw, ("start", "end")):
            if event == "start":
                if e.tag == f"{MAIN}sheetData":
                    rows = e
                continue
            if e.tag != f"{MAIN}row":
                continue
            number = int(e.get("r") or number + 1)
            if last is not None and number >= last:
                return
            if number >= first:
                cells, at = {}, -1
                for c in e.iter(f"{MAIN}c"):
                    at = column_of(c.get("r")) if c.get("r") else at + 1
                    kind = c.get("t") or "n"
                    value = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else c.findtext(f"{MAIN}v")
                    if value is not None and kind != "e":
                        cells[at] = (kind, value)
                yield number, cells
            rows.clear()


def shared_strings(book: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """The shared strings of these numbers."""
    found: dict[int, str] = {}
    if not wanted or "xl/sharedStrings.xml" not in book.namelist():
        return found
    i, top = 0, None
    with book.open("xl/sharedStrings.xml") as raw:
        for event, e in ElementTree.iterparse(raw, ("start", "end")):
            if event == "start":
                top = e if top is None else top
            elif e.tag == f"{MAIN}si":
                if i in wanted:
                    found[i] = "".join(t.text or "" for r in e if r.tag != f"{MAIN}rPh" for t in r.iter(f"{MAIN}t"))
                i += 1
                top.clear()
    return found


def texts(book: zipfile.ZipFile, rows: list[tuple[int, dict[int, tuple[str, str | None]]]]) -> Iterator[tuple[int, dict[int, str]]]:
    """Rows with their cells as text."""
    strings = shared_strings(book, {int(v) for _, cells in rows for kind, v in cells.values() if kind == "s"})
    for number, cells in rows:
        yield number, {at: strings.get(int(v), "") if kind == "s" else ("TRUE" if v == "1" else "FALSE") if kind == "b" else v for at, (kind, v) in cells.items()}


def header(book: zipfile.ZipFile, file: str) -> tuple[int, list[str]]:
    """(number of the first row that holds a value, its cells as column names: _c<i> for empty ones, _<n> added to repeated ones)."""
    for row in rows_of(book, file, 1, None):
        if row[1]:
            (number, cells), names = next(texts(book, [row])), []
            for i in range(max(cells) + 1):
                name = cells.get(i, "").strip() or f"_c{i}"
                names.append(f"{name}_{names.count(name)}" if name in names else name)
            return number, names
    return 0, []


class Rows(InputPartition):
    def __init__(self, name: str, file: str, first: int, last: int, width: int) -> None:
        self.name, self.file, self.first, self.last, self.width = name, file, first, last, width


class Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, rows: int) -> None:
        self.path, self.sheet, self.rows = path, sheet, rows

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        with opened(self.path) as book:
            for name, file in chosen(book, self.sheet):
                top, names = header(book, file)
                end = max((n for n, _ in rows_of(book, file, 1, None)), default=0) + 1
                out += [Rows(name, file, i, min(i + self.rows, end), len(names)) for i in range(top + 1, end, self.rows)]
        return out or [Rows("", "", 1, 1, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if partition.first >= partition.last:
            return
        with opened(self.path) as book:
            rows = list(rows_of(book, partition.file, partition.first, partition.last))
            for _, cells in texts(book, rows):
                values = [cells.get(i) for i in range(partition.width)]
                if any(v is not None for v in values):
                    yield tuple([partition.name, *values] if self.sheet == "*" else values)


class WorkbookSource(DataSource):
    """Options: path, sheet (a name, a number from 0 or "*"), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as book:
            found = [header(book, file)[1] for _, file in chosen(book, self.options.get("sheet"))]
        if any(names != found[0] for names in found):
            raise ValueError("the sheets differ in their headers")
        names = (["sheet"] if self.options.get("sheet") == "*" else []) + found[0]
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], self.options.get("sheet"), int(self.options.get("rows", ROWS)))


def read(spark: SparkSession, path: str, sheet: str | None = None, rows: int = ROWS) -> DataFrame:
    """A sheet of a workbook, all columns as text."""
    spark.dataSource.register(WorkbookSource)
    source = spark.read.format("workbook").option("rows", rows)
    return (source if sheet is None else source.option("sheet", sheet)).load(path)
