"""Excel exports: one workbook per task, unzipped and read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from towerlens.functions import text

SNIFF_ROWS = 12
#: Output of the workbook reader: data rows, and at the end of each file one row without a
#: ``source_row`` that has its header as keys of ``cells`` or, for a rejected file, ``error``.
SHEET_SCHEMA = "source_file string, source_row bigint, cells map<string,string>, error string"

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_ROW = f"{{{_NS['m']}}}row"
# Built-in number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_EPOCH = datetime(1899, 12, 30)
_BATCH = 5_000


def is_header(cells: list[str]) -> bool:
    """A header line names the severity and one of the usual alarm columns."""
    line = " ".join(c for c in cells if c)
    return "Severity" in line and any(word in line for word in ("Alarm ID", "Occurred", "MO Name"))


def _texts(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iterfind(".//m:t", _NS)) for item in root.iterfind("m:si", _NS)]


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    dated = set(_DATE_FORMATS)
    for fmt in root.iterfind(".//m:numFmt", _NS):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", fmt.get("formatCode", "")).lower()
        if re.search(r"[ydh]", code):
            dated.add(int(fmt.get("numFmtId")))
    styles = root.find("m:cellXfs", _NS)
    return {i for i, xf in enumerate(styles if styles is not None else []) if int(xf.get("numFmtId", 0)) in dated}


def _column(reference: str) -> int:
    place = 0
    for letter in reference:
        if not letter.isalpha():
            break
        place = place * 26 + ord(letter.upper()) - 64
    return place - 1


def _value(cell, texts: list[str], dated: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iterfind(".//m:t", _NS))
    node = cell.find("m:v", _NS)
    if node is None or node.text is None:
        return None
    if kind == "s":
        return texts[int(node.text)]
    if kind in (None, "n") and int(cell.get("s", 0)) in dated:
        seconds = round(float(node.text) * 86_400)
        return (_EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")
    return node.text


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cell texts of the first sheet, streamed row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        texts, dated = _texts(archive), _date_styles(archive)
        sheets = sorted(n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        if not sheets:
            raise ValueError("workbook has no sheet")
        with archive.open(sheets[0]) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != _ROW:
                    continue
                cells: list[str | None] = []
                for i, cell in enumerate(row.iterfind("m:c", _NS)):
                    place = _column(cell.get("r")) if cell.get("r") else i
                    cells.extend([None] * (place + 1 - len(cells)))
                    cells[place] = _value(cell, texts, dated)
                yield cells
                row.clear()


def _records(path: str, content: bytes, header_row: int | None) -> Iterator[tuple[str, int, dict | None, str | None]]:
    """Data rows below the header; the header is row ``header_row`` or found by sniffing."""
    names: list[str] | None = None
    for number, cells in enumerate(sheet_rows(content)):
        if names is None:
            found = number == header_row if header_row is not None else is_header([c or "" for c in cells])
            if found:
                names = text.header_names([c or "" for c in cells])
            elif header_row is None and number + 1 >= SNIFF_ROWS:
                break
            continue
        yield path, number, {n: c for n, c in zip(names, cells) if n and c is not None}, None
    if names is None:
        raise ValueError("no header row found")
    yield path, None, dict.fromkeys(filter(None, names)), None


def _frame(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["source_file", "source_row", "cells", "error"])
    return frame.astype({"source_row": "Int64"})


def parse(books: DataFrame, header_row: int | None = None) -> DataFrame:
    """Rows of every workbook (path, content) as (file, row, header -> text), streamed.

    A file can fail after some of its rows: readers leave out the rows of rejected files.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows: list = []
                try:
                    for record in _records(name, bytes(content), header_row):
                        rows.append(record)
                        if len(rows) >= _BATCH:
                            yield _frame(rows)
                            rows = []
                except Exception as error:  # noqa: BLE001 - a bad file is reported, not fatal
                    rows.append((name, None, None, f"{type(error).__name__}: {error}"))
                if rows:
                    yield _frame(rows)

    return books.mapInPandas(work, SHEET_SCHEMA)


def headers(sheets: DataFrame) -> list[str]:
    """Names in the headers of all accepted files."""
    ends = sheets.where(F.col("source_row").isNull() & F.col("error").isNull())
    return [r[0] for r in ends.select(F.explode(F.map_keys("cells"))).distinct().collect()]


def as_columns(sheets: DataFrame, names: list[str]) -> DataFrame:
    """One string column per header name, null where a file has no such column."""
    kept = sheets.where(F.col("source_row").isNotNull()).join(rejected(sheets), "source_file", "left_anti")
    return kept.select("source_file", "source_row", *[F.try_element_at("cells", F.lit(n)).alias(n) for n in names])


def rejected(sheets: DataFrame) -> DataFrame:
    return sheets.where(F.col("error").isNotNull()).select("source_file", "error")
