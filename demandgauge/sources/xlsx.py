"""Workbooks as a Spark source (A4): one workbook per row of a binary scan, first sheet to rows."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import basename
from .landing import RAW_COLUMNS, plan_headers, raw_rows

_ROWS_SCHEMA = "path string, row_no bigint, cells array<string>, error string"
_BATCH_ROWS = 5000

# Built-in workbook number formats that show a date, and those that show a clock time.
_DATE_FORMATS = [14, 15, 16, 17, 22]
_CLOCK_FORMATS = [18, 19, 20, 21, 45, 46, 47]
_EPOCH = datetime(1899, 12, 30)


def read_workbooks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, row_no, cells, error): rows of the first sheet, row 0 is the header.

    A workbook that cannot be read gives one row with ``error`` set; the others load.
    """
    return parse_workbooks(spark.read.format("binaryFile").load(paths))


def parse_workbooks(files: DataFrame) -> DataFrame:
    """The rows of workbooks given as (path, content)."""
    return files.select("path", "content").mapInPandas(_parse_batches, _ROWS_SCHEMA)


def workbook_plan(rows: DataFrame) -> DataFrame:
    """Header layout and quarantine reason per workbook, as for CSV files.

    A defect anywhere in a workbook makes all of it unusable, also rows read before it.
    """
    heads = rows.where("row_no = 0").groupBy("path").agg(
        F.max("error").alias("error"), F.max(F.when(F.col("error").isNull(), F.col("cells"))).alias("cells"),
    ).select(
        "path", "error",
        F.transform(F.coalesce("cells", F.array().cast("array<string>")),
                    lambda h: F.coalesce(h, F.lit(""))).alias("headers"),
    )
    return plan_headers(heads).withColumn("reason", F.coalesce("error", "reason")).drop("error")


def session_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Cells of the usable workbooks under their canonical names."""
    usable = plan.where("reason IS NULL").select("path", "columns")

    def cell(name: str) -> Column:
        at = F.array_position("columns", name)
        return F.when(at > 0, F.get("cells", (at - 1).cast("int"))).alias(name)

    named = rows.where("row_no > 0").join(usable, "path").select(
        *[cell(c) for c in RAW_COLUMNS],
        F.array_contains("columns", "end_time").alias("has_end_time"),
        basename(F.col("path")).alias("source_file"),
        F.struct("path", F.lit(0).cast("bigint").alias("start"), "row_no").alias("row_order"),
    )
    return raw_rows(named, RAW_COLUMNS, F.col("has_end_time"))


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows: list[tuple] = []
            try:
                for number, cells in enumerate(sheet_rows(bytes(content))):
                    rows.append((path, number, cells, None))
                    if len(rows) == _BATCH_ROWS:
                        yield _frame(rows)
                        rows = []
                if not rows and content is None:
                    raise ValueError("no content")
            except Exception as reason:  # any defect of one file must not stop the others
                rows = [(path, 0, None, f"{type(reason).__name__}: {reason}")]
            if rows:
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "row_no", "cells", "error"])


def sheet_rows(content: bytes) -> Iterator[list]:
    """Rows of the first sheet as text cells; dates in ISO form, clock times as HH:MM:SS."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = _shared_strings(book) if "xl/sharedStrings.xml" in names else []
        kinds = _cell_kinds(book) if "xl/styles.xml" in names else []
        with book.open(_first_sheet(book, names)) as sheet:
            yield from _read_rows(sheet, shared, kinds)


def _read_rows(sheet, shared: list[str], kinds: list[str]) -> Iterator[list]:
    """The rows of an open sheet, read in pieces; the parser's own events take half the time of a tree per row."""
    rows: list[list] = []
    row: list | None = None
    attrs: dict[str, str] = {}
    depth, seen, taken, value, texts = 0, False, None, [], []

    def start(name, its):
        nonlocal row, attrs, depth, seen, taken, value, texts
        if row is None:
            if _local(name) == "row":
                row, depth = [], 0
            return
        depth += 1
        taken = None  # text counts up to the first element in it
        if depth == 1:
            attrs, seen, value, texts = its, False, [], []
            return
        tag = _local(name)
        if tag == "t":
            taken = texts
        elif tag == "v" and depth == 2 and not seen:
            seen, taken = True, value

    def data(text):
        if taken is not None:
            taken.append(text)

    def end(name):
        nonlocal row, depth, taken
        if row is None:
            return
        if depth == 0:
            rows.append(row)
            row = None
            return
        taken = None
        if depth == 1:
            at = _column_index(ref) if (ref := attrs.get("r")) else len(row)
            if at > len(row):
                row.extend([None] * (at - len(row)))
            row.append(_cell_text(attrs, "".join(value) if value else None, texts, shared, kinds))
        depth -= 1

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, data, end
    try:
        while piece := sheet.read(1 << 16):
            parser.Parse(piece, False)
            yield from rows
            rows.clear()
        parser.Parse(b"", True)
    except expat.ExpatError as defect:
        yield from rows
        raise ElementTree.ParseError(str(defect)) from None
    yield from rows


@functools.lru_cache(maxsize=256)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _tag(node) -> str:
    return _local(node.tag)


def _column_index(ref: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", ref).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _first_sheet(book: zipfile.ZipFile, names: set[str]) -> str:
    """The sheet that the workbook itself lists first, else the one of the smallest number."""
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        listed = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"]
        targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter()}
        for entry in listed:
            wanted = next((v for k, v in entry.attrib.items() if k.rpartition("}")[2] == "id"), None)
            target = targets.get(wanted, "")
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if name in names:
                return name
    sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    if not sheets:
        raise ValueError("workbook has no sheet")
    return min(sheets, key=lambda n: int(re.findall(r"\d+", n)[-1]))


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter() if _tag(t) == "t") for item in root]


def _cell_kinds(book: zipfile.ZipFile) -> list[str]:
    """Per cell style: ``date``, ``clock`` or ``plain``."""
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter() if _tag(f) == "numFmt"}
    kinds: list[str] = []
    for block in root:
        if _tag(block) == "cellXfs":
            for style in block:
                number = int(style.get("numFmtId") or 0)
                code = re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", custom.get(number, "").lower())
                if number in _DATE_FORMATS or re.search(r"[yd]", code):
                    kinds.append("date")
                elif number in _CLOCK_FORMATS or re.search(r"h|s", code):
                    kinds.append("clock")
                else:
                    kinds.append("plain")
    return kinds


def _cell_text(attrs: dict[str, str], value: str | None, texts: list[str], shared: list[str], kinds: list[str]) -> str | None:
    kind = attrs.get("t")
    if kind == "inlineStr":
        return "".join(texts)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind in ("str", "d"):
        return value
    style = kinds[int(s)] if (s := attrs.get("s")) and int(s) < len(kinds) else "plain"
    if style == "plain":
        return value
    seconds = round(float(value) * 86400)
    if style == "date":
        at = _EPOCH + timedelta(seconds=seconds)
        return at.isoformat(" ") if at.year >= 1000 else at.strftime("%Y-%m-%d %H:%M:%S")
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
