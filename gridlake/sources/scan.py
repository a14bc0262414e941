"""Workbooks as Spark scans: one task parses the sheets of a file, or one of them, and streams its rows as Arrow batches.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reads will do, and workbooks in hand (bytes) take the same way. A sheet's XML cannot be
split, so parallelism comes from files; no file is shuffled. ``row_end`` stops the parser early, and only the columns asked for are built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import CELL
from ..session import ship_package
from .formats import Cell, Workbook, open_workbook, used_range

FLUSH_CELLS = 200_000
CELL_ARROW = pa.struct([("k", pa.int8()), ("s", pa.string()), ("d", pa.float64()), ("i", pa.int64())])
EMPTY: Cell = (0, None, None, None)


def _batch(rows: list[int], cells: list[Cell], width: int) -> pa.RecordBatch:
    k, s, d, i = zip(*cells) if cells else ((), (), (), ())
    flat = pa.StructArray.from_arrays([pa.array(k, pa.int8()), pa.array(s, pa.string()), pa.array(d, pa.float64()), pa.array(i, pa.int64())], fields=list(CELL_ARROW))
    offsets = pa.array(np.arange(0, width * len(rows) + 1, max(width, 1))[: len(rows) + 1] if width else np.zeros(len(rows) + 1), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["_row", "cells"])


def grid_batches(
    book: Workbook, sheet: str, col_start: int, width: int, row_start: int = 0, row_end: int | None = None, columns: frozenset[int] | None = None
) -> Iterator[pa.RecordBatch]:
    """Dense rows of a part of a sheet; rows without cells between others come as empty ones, and so do cells outside ``columns`` (counted from ``col_start``)."""
    if hasattr(book, "batches"):
        yield from book.batches(sheet, col_start, width, row_start, row_end, columns)
        return
    rows: list[int] = []
    cells: list[Cell] = []
    blank = [EMPTY] * width
    following = row_start
    for r, found in book.rows(sheet):
        if row_end is not None and r >= row_end:
            break
        if r < row_start:
            continue
        for gap in range(following, r):
            rows.append(gap)
            cells += blank
        following = r + 1
        line = blank.copy()
        for c, cell in found.items():
            if 0 <= c - col_start < width and (columns is None or c - col_start in columns):
                line[c - col_start] = cell
        rows.append(r)
        cells += line
        if len(cells) >= FLUSH_CELLS:
            yield _batch(rows, cells, width)
            rows, cells = [], []
    if rows:
        yield _batch(rows, cells, width)


def binary(spark: SparkSession, source: str | list[str] | bytes) -> DataFrame:
    """``path, content`` of workbooks; bytes in hand have an empty path."""
    ship_package(spark)
    if isinstance(source, bytes):
        return spark.createDataFrame([("", bytearray(source))], "path string, content binary")
    return spark.read.format("binaryFile").load(source).select("path", "content")


def scan_sheet(
    files: DataFrame, sheet: str, col_start: int, width: int, row_start: int = 0, row_end: int | None = None, columns: frozenset[int] | None = None
) -> DataFrame:
    """The grid of one sheet of one workbook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from grid_batches(open_workbook(content.as_py()), sheet, col_start, width, row_start, row_end, columns)

    return files.select("content").mapInArrow(run, f"_row bigint, cells array<{CELL}>")


def sheet_batches(path: str, book: Workbook, sheet: str, col_start: int = 0, width: int | None = None, row_start: int = 0, row_end: int | None = None) -> Iterator[pa.RecordBatch]:
    """``path, sheet, _row, cells`` of one sheet, up to its last used column if no width is given."""
    if width is None:
        used = used_range(book, sheet)
        width = max(0, used.col_start + used.width - col_start)
    for out in grid_batches(book, sheet, col_start, width, row_start, row_end):
        n = out.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([sheet] * n, pa.string()), *out.columns], ["path", "sheet", "_row", "cells"])


SHEETS = f"path string, sheet string, _row bigint, cells array<{CELL}>"


def scan_all(files: DataFrame, col_start: int = 0, width: int | None = None, sheet: str | None = None) -> DataFrame:
    """``path, sheet, _row, cells`` of all sheets (or those called ``sheet``) of all workbooks; works on streams of files too.

    Rows have cells from column ``col_start`` on, up to the sheet's last used one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                book = open_workbook(content.as_py())
                for name in [s.name for s in book.metadata.sheets if sheet in (None, s.name)]:
                    yield from sheet_batches(path.as_py(), book, name, col_start, width)

    return files.select("path", "content").mapInArrow(run, SHEETS)


def scan_metadata(files: DataFrame) -> DataFrame:
    """``path, sheet_idx, name, visible`` of all sheets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = open_workbook(content.as_py()).metadata.sheets
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([s.name for s in found], pa.string()), pa.array([s.visible for s in found], pa.string())],
                    ["path", "sheet_idx", "name", "visible"],
                )

    return files.mapInArrow(run, "path string, sheet_idx int, name string, visible string").orderBy("path", F.col("sheet_idx"))
