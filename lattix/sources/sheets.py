"""Spreadsheets: the first sheet of workbooks that are zipped XML.

A workbook cannot be split, so each is read by one task, as a stream of rows; a folder of them is
read in parallel. Texts come from the table of shared strings or stand in the cell.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed names of the format
WORKBOOK = "xl/workbook.xml"
RELATIONS = "xl/_rels/workbook.xml.rels"
STRINGS = "xl/sharedStrings.xml"
RELATION_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BATCH = 4096


def _name(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element: ElementTree.Element) -> str:
    """The runs of text of a string item; phonetic hints are not part of it."""
    out = []
    for child in element:
        if _name(child) == "t":
            out.append(child.text or "")
        elif _name(child) == "r":
            out += [t.text or "" for t in child if _name(t) == "t"]
    return "".join(out)


def _strings(book: zipfile.ZipFile) -> list[str]:
    if STRINGS not in book.namelist():
        return []
    out = []
    with book.open(STRINGS) as f:
        for _, e in ElementTree.iterparse(f):
            if _name(e) == "si":
                out.append(_text(e))
                e.clear()
    return out


def _first_sheet(book: zipfile.ZipFile) -> str:
    first = next(e for e in ElementTree.fromstring(book.read(WORKBOOK)).iter() if _name(e) == "sheet")
    target = next(e.get("Target") for e in ElementTree.fromstring(book.read(RELATIONS)) if e.get("Id") == first.get(RELATION_ID))
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))


def column_of(reference: str) -> int:
    """The number of a cell's column, from 0: A is 0, Z 25, AA 26."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_text(e) for e in cell if _name(e) == "is"), None)
    v = next((e.text for e in cell if _name(e) == "v"), None)
    if v is None or kind == "e":  # an error such as a division by zero is no value
        return None
    if kind == "s":
        return strings[int(v)]
    return {"0": "false", "1": "true"}.get(v, v) if kind == "b" else v


def sheet_rows(content: bytes) -> Iterator[dict[int, str]]:
    """The rows of the first sheet as {column: text}; empty cells are not in them."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _strings(book)
        with book.open(_first_sheet(book)) as f:
            for _, e in ElementTree.iterparse(f):
                if _name(e) == "row":
                    cells = ((column_of(c.get("r")) if c.get("r") else k, _value(c, strings)) for k, c in enumerate(e))
                    yield {k: v for k, v in cells if v is not None}
                    e.clear()


def sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema`` from the first sheet of a workbook, or of each in a folder; the first row has their names.

    Columns may stand in any order, others are passed over; one that is missing is an error, a
    value that is not of its column's type is null. Rows without a value are left out. Dates are
    the numbers that the sheet holds.
    """
    kinds = StructType.fromDDL(schema)
    names = kinds.names

    def rows(batches):
        def batch(got):
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.string()) for k in range(len(names))], names)

        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                all_rows = sheet_rows(content)
                head = {name: k for k, name in next(all_rows, {}).items()}
                if missing := [n for n in names if n not in head]:
                    raise ValueError(f"{file} has no column {', '.join(missing)}")
                got = []
                for row in all_rows:
                    if row:
                        got.append([row.get(head[n]) for n in names])
                    if len(got) == BATCH:
                        yield batch(got)
                        got = []
                if got:
                    yield batch(got)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    text = files.select("path", "content").mapInArrow(rows, ", ".join(f"`{n}` string" for n in names))
    number = lambda f: F.col(f"`{f.name}`").try_cast("double").try_cast(f.dataType) if f.dataType.typeName() in ("integer", "long", "short", "byte") else F.col(f"`{f.name}`").try_cast(f.dataType)
    return text.select(*(number(f).alias(f.name) for f in kinds.fields))
