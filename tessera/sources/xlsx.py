"""Sheets of XLSX workbooks as tables, read from their zipped XML as it streams: no workbook stands in memory as objects.

Workbooks come as Spark's binary files, so any store that Spark reads will do and the driver sees no content; each is
taken apart by one task, row by row, in Arrow batches. All cells are texts, as the sheet stores them: numbers keep their
digits, dates are day numbers, formulas give their last value. The first row names the columns.

Cases: empty cells and cells beyond the named columns are absent; a name that repeats is numbered from 2 on; blank rows
are skipped; an empty sheet gives no rows; a workbook without that sheet, or a file that is no workbook, is an error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Name spaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Rows of one Arrow batch.
BATCH = 1000


def _text(node) -> str:
    """All texts of a string item, those of its runs included, phonetic ones aside."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.iter(f"{MAIN}t") if child.tag == f"{MAIN}r" else []))


def _elements(book: zipfile.ZipFile, part: str, tag: str) -> Iterator:
    """Elements of a part as they are read; what has been used is dropped."""
    with book.open(part) as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag == tag:
                yield node
                node.clear()


def _part_of(book: zipfile.ZipFile, sheet: int | str) -> str:
    sheets = [(n.get("name"), n.get(f"{REL}id")) for n in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    found = [r for k, (name, r) in enumerate(sheets) if (k == sheet if isinstance(sheet, int) else name == sheet)]
    if not found:
        raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")
    targets = {n.get("Id"): n.get("Target") for n in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    target = targets[found[0]]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column(reference: str) -> int:
    """The number, from 0, of a cell's column: letters are digits of base 26."""
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: int | str = 0) -> Iterator[dict[int, str]]:
    """The cells of each row, by column from 0; rows without any are skipped."""
    book = zipfile.ZipFile(io.BytesIO(content))
    part = _part_of(book, sheet)
    strings = [_text(n) for n in _elements(book, "xl/sharedStrings.xml", f"{MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
    for row in _elements(book, part, f"{MAIN}row"):
        cells: dict[int, str] = {}
        at = -1
        for cell in row.iter(f"{MAIN}c"):
            at = _column(cell.get("r")) if cell.get("r") else at + 1
            value, inline = cell.find(f"{MAIN}v"), cell.find(f"{MAIN}is")
            text = _text(inline) if inline is not None else value.text if value is not None else None
            if text is not None and cell.get("t") == "s":
                text = strings[int(text)]
            if text:
                cells[at] = text
        if cells:
            yield cells


def _names(first: dict[int, str]) -> dict[int, str]:
    out: dict[int, str] = {}
    for k, name in sorted(first.items()):
        name, n = name.strip(), 1
        while (own := name if n == 1 else f"{name}_{n}") in out.values():
            n += 1
        out[k] = own
    return out


def read_sheet(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """(path, row, cells map of column name to text) of every row below the first, of every workbook at ``path``."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = sheet_rows(content.as_py(), sheet)
                names = _names(next(rows, {}))
                held: list[tuple[int, list]] = []
                for k, cells in enumerate(rows):
                    held.append((k, [(names[c], t) for c, t in sorted(cells.items()) if c in names]))
                    if len(held) == BATCH:
                        yield _batch(name, held)
                        held = []
                if held:
                    yield _batch(name, held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, cells map<string,string>")


def _batch(path: str, rows: list[tuple[int, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([k for k, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.map_(pa.string(), pa.string()))], names=["path", "row", "cells"])
