"""The workbook API: open, list, load."""

from __future__ import annotations

import os
import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ArrowError, InvalidParametersError, SheetNotFoundError, WorkbookError
from .functions.vectors import ARROW_TYPES, TypedColumn
from .operators.rows import Extent
from .plans.options import ColumnInfo, Dtype, LoadOptions, parse_idx_or_name
from .plans.plan import Grid, LoadPlan
from .sources.formats import DefinedName, Metadata, SheetMeta, TableMeta, Used, Workbook, open_workbook, used_range
from .sources.scan import binary, scan_sheet

class CellError:
    """A cell whose content its column's dtype cannot take."""

    def __init__(self, position: tuple[int, int], row_offset: int, detail: str):
        self.position, self.row_offset, self.detail = position, row_offset, detail

    @property
    def offset_position(self) -> tuple[int, int]:
        """The position among the data rows."""
        return self.position[0] - self.row_offset, self.position[1]

    def __repr__(self) -> str:
        return f"CellError(position={self.position}, offset_position={self.offset_position}, row_offset={self.row_offset}, detail={self.detail!r})"


class CellErrors:
    def __init__(self, errors: list[CellError]):
        self.errors = errors

    def __repr__(self) -> str:
        return f"CellErrors(errors=[{', '.join(map(repr, self.errors))}])"


class _Loaded:
    """What sheets and tables share: a plan, its metadata and its exports."""

    kind = ""

    def __init__(self, plan: LoadPlan, name: str):
        self._plan, self.name, self._kept = plan, name, None

    @property
    def width(self) -> int:
        """Width of the used range, not of the selection."""
        return self._plan.found.width

    @property
    def offset(self) -> int:
        return self._plan.rows.offset

    @property
    def limit(self) -> int:
        return self._plan.rows.limit

    @property
    def height(self) -> int:
        """Number of rows that loading gives."""
        return self._plan.rows.rows - self._plan.rows.n_skipped

    @property
    def total_height(self) -> int:
        """Number of data rows of the range, before any are skipped."""
        return max(0, self._plan.rows.height - (self._plan.rows.header is not None))

    @property
    def selected_columns(self) -> list[ColumnInfo]:
        return self._plan.selected

    def available_columns(self) -> list[ColumnInfo]:
        return self._available

    @cached_property
    def _available(self) -> list[ColumnInfo]:
        return self._plan.column_infos()

    @property
    def specified_dtypes(self) -> str | dict[str | int, str] | None:
        d = self._plan.options.dtypes
        return {k: v.value for k, v in d.items()} if isinstance(d, dict) else d.value if d else None

    def keep(self):
        """Load the typed rows into Spark's cache now."""
        self._kept = self._plan.dataframe(keep_row=True).persist()
        self._kept.count()
        return self

    def release(self) -> None:
        """Let go of what ``keep`` holds."""
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def to_spark(self, keep_row: bool = False) -> DataFrame:
        """A lazy DataFrame; its rows have no order unless sorted by ``_row`` (``keep_row``)."""
        if self._kept is None:
            return self._plan.dataframe(keep_row)
        return self._kept if keep_row else self._kept.drop("_row")

    def to_columns(self) -> list[TypedColumn]:
        """The columns as typed vectors, on the driver."""
        table = self.to_arrow()
        return [TypedColumn(c.name, c.dtype, table.column(i).combine_chunks(), table.num_rows) for i, c in enumerate(self.selected_columns)]

    def to_arrow(self) -> pa.Table:
        """All rows in order, on the driver; types as the column dtypes say, all nullable."""
        schema = pa.schema([pa.field(c.name, ARROW_TYPES[Dtype(c.dtype)]) for c in self.selected_columns])
        if not self.selected_columns:
            return schema.empty_table()
        df = self.to_spark(keep_row=True)
        nulls = {c.name for c in self.selected_columns if c.dtype == Dtype.NULL.value}
        try:
            got = df.select("_row", *(df[f"`{c.name}`"] for c in self.selected_columns if c.name not in nulls)).orderBy("_row").toArrow()
            cols = [pa.nulls(got.num_rows) if f.name in nulls else got.column(f.name).cast(f.type, safe=False) for f in schema]
            return pa.Table.from_arrays(cols, schema=schema)
        except pa.ArrowException as e:
            raise ArrowError(str(e)) from e

    def to_pandas(self):
        return self.to_arrow().to_pandas()

    def to_polars(self):
        try:
            import polars as pl
        except ImportError as e:
            raise ImportError("to_polars needs the polars package") from e
        return pl.from_arrow(self.to_arrow())

    def _record_batch(self) -> pa.RecordBatch:
        table = self.to_arrow().combine_chunks()
        batches = table.to_batches()
        return batches[0] if batches else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)

    def __arrow_c_schema__(self):
        return pa.schema([pa.field(c.name, ARROW_TYPES[Dtype(c.dtype)]) for c in self.selected_columns]).__arrow_c_schema__()

    def __arrow_c_array__(self, requested_schema=None):
        return self._record_batch().__arrow_c_array__(requested_schema)


class Sheet(_Loaded):
    def __init__(self, plan: LoadPlan, meta: SheetMeta):
        super().__init__(plan, meta.name)
        self.visible = meta.visible

    def errors(self) -> DataFrame:
        return self._plan.errors()

    def to_arrow_with_errors(self) -> tuple[pa.Table, CellErrors | None]:
        found = [CellError((r["row"], r["col"]), r["row_offset"], r["detail"]) for r in self._plan.errors().orderBy("col", "row").collect()]
        return self.to_arrow(), CellErrors(found) if found else None

    def __repr__(self) -> str:
        return f"Sheet<{self.name}>"


class Table(_Loaded):
    def __init__(self, plan: LoadPlan, meta: TableMeta):
        super().__init__(plan, meta.name)
        self.sheet_name = meta.sheet

    def __repr__(self) -> str:
        return f"Table<{self.name}>"


class SheetGrid(Grid):
    """A sheet of which parts are parsed as they are asked for: nothing is kept, and rows and columns bound what the parser builds."""

    def __init__(self, files: DataFrame, sheet: str, col_start: int, width: int):
        self.files, self.sheet, self.col_start, self.width = files, sheet, col_start, width

    def part(self, start: int = 0, end: int | None = None, columns: Sequence[int] | None = None) -> DataFrame:
        wanted = None if columns is None else frozenset(columns)
        return scan_sheet(self.files, self.sheet, self.col_start, self.width, start, end, wanted)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession


class WorkbookHandle:
    """An open workbook: metadata on the driver, sheets as lazy scans. The file itself is opened by tasks; only bytes in hand are opened here."""

    def __init__(self, spark: SparkSession, source: str | bytes):
        self.spark, self.source = spark, source
        self._files = binary(spark, source)
        self._book = open_workbook(source) if isinstance(source, bytes) else None
        self._metadata: Metadata = self._ask(lambda book: book.metadata)
        self._used: dict[str, Used] = {}

    def _ask(self, question: Callable[[Workbook], Any]) -> Any:
        """What ``question`` finds in the workbook."""
        if self._book is not None:
            return question(self._book)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content"):
                    try:
                        out = (question(open_workbook(content.as_py())), None)
                    except WorkbookError as e:
                        out = (None, e)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["found"])

        rows = self._files.select("content").mapInArrow(run, "found binary").take(2)
        if len(rows) != 1:
            raise InvalidParametersError(f"{self.source} is not one workbook")
        found, error = pickle.loads(rows[0]["found"])
        if error is not None:
            raise error
        return found

    @property
    def sheet_names(self) -> list[str]:
        return [s.name for s in self._metadata.sheets]

    def table_names(self, sheet_name: str | None = None) -> list[str]:
        return [t.name for t in self._tables if sheet_name in (None, t.sheet)]

    @cached_property
    def _tables(self) -> list[TableMeta]:
        return self._ask(lambda book: book.tables())

    def defined_names(self) -> list[DefinedName]:
        return self._metadata.names

    def sheets_dataframe(self) -> DataFrame:
        rows = [(i, s.name, s.visible) for i, s in enumerate(self._metadata.sheets)]
        return self.spark.createDataFrame(rows, "sheet_idx int, name string, visible string")

    def tables_dataframe(self) -> DataFrame:
        rows = [(t.name, t.sheet, list(t.columns), t.n_rows) for t in self._tables]
        return self.spark.createDataFrame(rows, "name string, sheet string, columns array<string>, n_rows int")

    def defined_names_dataframe(self) -> DataFrame:
        return self.spark.createDataFrame([(n.name, n.formula) for n in self.defined_names()], "name string, formula string")

    def _find(self, idx_or_name: int | str) -> SheetMeta:
        sheets = self._metadata.sheets
        key = parse_idx_or_name(idx_or_name)
        if isinstance(key, int):
            if key < len(sheets):
                return sheets[key]
            raise SheetNotFoundError(f"sheet at index {key} not found").with_context(f"Sheet index {key} is out of range. File has {len(sheets)} sheets.")
        for s in sheets:
            if s.name == key:
                return s
        known = ", ".join(f'"{s.name}"' for s in sheets)
        raise SheetNotFoundError(f'sheet with name "{key}" not found').with_context(f'Sheet "{key}" not found in file. Available sheets: {known}.')

    def load_sheet(self, idx_or_name: int | str, *, eager: bool = False, **options: Any) -> Sheet:
        """A sheet, lazily; ``eager`` keeps its typed rows in Spark's cache until ``release`` is called."""
        meta = self._find(idx_or_name)
        plan_options = LoadOptions.for_sheet(**options)
        name = meta.name
        if name not in self._used:
            self._used[name] = self._ask(lambda book: used_range(book, name))
        used = self._used[name]
        found = Extent(used.first, used.last, used.width)
        sheet = Sheet(LoadPlan.build(SheetGrid(self._files, name, used.col_start, used.width), plan_options, used.col_start, found=found), meta)
        return sheet.keep() if eager else sheet

    def load_sheet_eager(self, idx_or_name: int | str, **options: Any) -> pa.Table:
        return self.load_sheet(idx_or_name, **options).to_arrow()

    def load_sheet_by_name(self, name: str, **options: Any) -> Sheet:
        return self.load_sheet(name, **options)

    def load_sheet_by_idx(self, idx: int, **options: Any) -> Sheet:
        return self.load_sheet(idx, **options)

    def load_table(self, name: str, *, eager: bool = False, **options: Any) -> Table:
        meta = next((t for t in self._tables if t.name == name), None)
        if meta is None:
            raise InvalidParametersError(f'table "{name}" not found').with_context(f"available tables are: {self.table_names()}")
        plan_options = LoadOptions.for_table(**options)
        end = meta.first_row + meta.n_rows
        cells = scan_sheet(self._files, meta.sheet, meta.first_col, len(meta.columns), meta.first_row, end)
        here = cells.select((F.col("_row") - meta.first_row).alias("_row"), "cells")
        # Rows without a cell at the table's end are rows of the table too.
        blank = F.transform(F.sequence(F.lit(1), F.lit(len(meta.columns))), lambda _: F.struct(F.lit(0).cast("tinyint").alias("k"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("bigint").alias("i")))
        every = self.spark.range(meta.n_rows).select(F.col("id").alias("_row"))
        grid = every.join(here, "_row", "left").select("_row", F.coalesce("cells", blank).alias("cells"))
        found = Extent(0 if meta.n_rows else None, meta.n_rows - 1 if meta.n_rows else None, len(meta.columns))
        table = Table(LoadPlan.build(grid, plan_options, meta.first_col, meta.columns, found), meta)
        return table.keep() if eager else table

    def __repr__(self) -> str:
        shown = "bytes" if isinstance(self.source, bytes) else self.source
        return f"WorkbookHandle<{shown}>"


def read_workbook(source: str | Path | bytes, spark: SparkSession | None = None) -> WorkbookHandle:
    """Open a workbook (.xlsx, .xlsm, .ods, .xls; found out from the content) from a path or from bytes."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if isinstance(source, (str, Path)):
        text = str(source)
        return WorkbookHandle(spark, os.path.expanduser(text) if text.startswith("~") else text)
    if isinstance(source, (bytes, bytearray)):
        return WorkbookHandle(spark, bytes(source))
    raise InvalidParametersError("source must be a string or bytes")


read_excel = read_workbook
