"""Spreadsheets as a data source: format("sheet").

Reading: the first sheet of a file, its first row the header, all columns text.
A task parses the sheet's stream as far as its own range of rows, and makes rows
of that range only. Writing: each task writes files of up to ROWS rows under
another name; they get their own names when the job commits, and go if it fails.

Paths are opened by PyArrow's file systems (a local or mounted path, hdfs, s3,
gs). Cells: numbers as they are written in the file (whole ones without a
point), dates therefore as day numbers, truth as TRUE or FALSE, empty ones null.
"""

from __future__ import annotations

import io
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of a task that reads, and of a file that is written (under the format's limit of 1,048,576).
RANGE, ROWS = 50_000, 1_000_000

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _book(path: str) -> zipfile.ZipFile:
    fs, where = _opened(path)
    return zipfile.ZipFile(fs.open_input_file(where))


def _texts(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, element in ElementTree.iterparse(f):
            if element.tag == f"{MAIN}si":
                out.append(_texts(element))
                element.clear()
    return out


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")).get(REL)
    for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if relation.get("Id") == sheet:
            return relation.get("Target").removeprefix("/xl/").removeprefix("xl/")
    raise ValueError("the first sheet is missing")


def column_of(reference: str) -> int:
    """The place (from 0) of a cell such as AB12."""
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def column_name(place: int) -> str:
    out, place = "", place + 1
    while place:
        place, rest = divmod(place - 1, 26)
        out = chr(65 + rest) + out
    return out


def _value(cell, shared: list[str]) -> str | None:
    kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        found = cell.find(f"{MAIN}is")
        return _texts(found) if found is not None else None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "TRUE" if v.text == "1" else "FALSE"
    return v.text.removesuffix(".0") if kind == "n" else v.text


def rows(path: str, first: int = 0, past: int | None = None) -> Iterator[list[str | None]]:
    """The sheet's rows from first to before past (from 0; those that the file leaves out are empty)."""
    with _book(path) as book:
        shared = _shared(book)
        number = -1
        with book.open(f"xl/{_first_sheet(book)}") as f:
            for _, element in ElementTree.iterparse(f):
                if element.tag != f"{MAIN}row":
                    continue
                at = int(element.get("r", number + 2)) - 1
                for gap in range(number + 1, at):
                    if first <= gap and (past is None or gap < past):
                        yield []
                number = at
                if past is not None and at >= past:
                    return
                if at >= first:
                    cells: list[str | None] = []
                    for cell in element.iter(f"{MAIN}c"):
                        place = column_of(cell.get("r", "")) if cell.get("r") else len(cells)
                        cells += [None] * (place + 1 - len(cells))
                        cells[place] = _value(cell, shared)
                    yield cells
                element.clear()


def n_rows(path: str) -> int:
    """By the sheet's stated dimension, else by counting."""
    with _book(path) as book, book.open(f"xl/{_first_sheet(book)}") as f:
        last = 0
        for _, element in ElementTree.iterparse(f):
            if element.tag == f"{MAIN}dimension" and ":" in element.get("ref", ""):
                return int("".join(ch for ch in element.get("ref").split(":")[1] if ch.isdigit()))
            if element.tag == f"{MAIN}row":
                last = int(element.get("r", last + 1))
                element.clear()
        return last


@dataclass
class Range(InputPartition):
    first: int
    past: int


class SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self):
        n = n_rows(self.path)
        return [Range(a, min(n, a + RANGE)) for a in range(1, n, RANGE)] or [Range(1, 1)]

    def read(self, partition):
        for cells in rows(self.path, partition.first, partition.past):
            if any(c is not None for c in cells):
                yield tuple((cells + [None] * self.width)[: self.width])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


_SHELL = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="result" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: What XML can't hold; written as the replacement character.
_UNFIT = {c: "�" for c in [*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF, *range(0xD800, 0xE000)]}


def _cell(row: int, place: int, value) -> str:
    if value is None:
        return ""
    at = f'{column_name(place)}{row}'
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value).translate(_UNFIT))}</t></is></c>'.replace("\r", "&#13;")


def write_book(target, names: list[str], records: Iterator) -> None:
    """One workbook with a sheet named result, into a binary file."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _SHELL.items():
            book.writestr(name, text)
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet, io.TextIOWrapper(sheet, "utf-8", newline="") as out:
            out.write('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for number, values in ((1, names),):
                out.write(f'<row r="{number}">{"".join(_cell(number, i, v) for i, v in enumerate(values))}</row>')
            for number, values in enumerate(records, 2):
                out.write(f'<row r="{number}">{"".join(_cell(number, i, v) for i, v in enumerate(values))}</row>')
            out.write("</sheetData></worksheet>")


class SheetWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path.rstrip("/"), names

    def write(self, iterator):
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, str]] = []
        record = next(iterator, None)
        while record is not None:
            count = 0

            def some():
                nonlocal record, count
                while record is not None and count < ROWS:  # noqa: B023
                    yield tuple(record)
                    record, count = next(iterator, None), count + 1

            name = f"part-{uuid.uuid4().hex}.xlsx"
            with fs.open_output_stream(f"{root}/_{name}") as target:
                write_book(target, self.names, some())
            files.append((f"{root}/_{name}", f"{root}/{name}"))
        return Written(files)

    def commit(self, messages):
        fs, root = _opened(self.path)
        for message in messages:
            for draft, name in message.files if message else ():
                fs.move(draft, name)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages):
        fs, _ = _opened(self.path)
        for message in messages:
            for draft, _name in message.files if message else ():
                fs.delete_file(draft)


class SheetSource(DataSource):
    @classmethod
    def name(cls):
        return "sheet"

    def schema(self):
        seen: dict[str, int] = {}
        names = []
        for i, name in enumerate(next(rows(self.options["path"], 0, 1), [])):
            name = name or f"_c{i}"
            seen[name] = seen.get(name, 0) + 1
            names.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
        return ", ".join(f"`{n.replace('`', '``')}` string" for n in names or ["_c0"])

    def reader(self, schema):
        return SheetReader(self.options["path"], len(schema.fields))

    def writer(self, schema, overwrite):
        return SheetWriter(self.options["path"], [f.name for f in schema.fields])


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers that plan may not find the package
    spark.dataSource.register(SheetSource)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("sheet").load(path)


def write_sheets(df: DataFrame, path: str) -> None:
    """Files of up to ROWS rows into a folder, a task's rows in its own ones; the folder gets _SUCCESS last."""
    register(df.sparkSession)
    df.write.format("sheet").mode("append").save(path)
