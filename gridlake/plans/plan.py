"""The load plan: what the driver settles about a grid, and the Catalyst plan that follows from it."""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..operators.columns import check_selection, name_columns, select_columns
from ..operators.infer import lattice, masks
from ..operators.rows import Extent, Window, extent, last_filled, window
from .options import ColumnInfo, ColumnInfoNoDtype, Dtype, DtypeFrom, LoadOptions


def cell_text(cell) -> str | None:
    """A header cell as text; None if empty."""
    if cell is None or cell["k"] == C.EMPTY:
        return None
    k = cell["k"]
    if k in (C.FLOAT, C.ELAPSED):
        return ("%.9f" % cell["d"]).rstrip("0").rstrip(".")
    if k == C.INT:
        return str(cell["i"])
    if k == C.BOOL:
        return "true" if cell["i"] else "false"
    if k == C.SERIAL:
        ms = round(cell["d"] * 86_400_000) - (86_400_000 if cell["d"] >= 60 else 0)
        at = datetime.datetime(1899, 12, 31) + datetime.timedelta(milliseconds=ms)
        return at.strftime("%Y-%m-%d %H:%M:%S") + (f".{at.microsecond // 1000:03d}" if at.microsecond else "")
    return cell["s"]


class Grid:
    """``_row, cells`` of a sheet, of which a part can be asked for: some rows, and the cells of some columns (others may come empty)."""

    def __init__(self, whole: DataFrame):
        self.whole = whole

    def part(self, start: int = 0, end: int | None = None, columns: Sequence[int] | None = None) -> DataFrame:
        row = F.col("_row")
        return self.whole.filter(row >= start if end is None else (row >= start) & (row < end))

    def rows(self, start: int, end: int, left_out: Sequence[int] = (), columns: Sequence[int] | None = None, numbers: bool = True) -> DataFrame:
        """Exactly the rows from ``start`` to before ``end``, without those listed. A grid may leave out ``_row`` unless ``numbers`` are asked for."""
        row = F.col("_row")
        inside = (row >= start) & (row < end)
        return self.part(start, end, columns).filter(inside & ~row.isin(list(left_out)) if left_out else inside)

    def extent(self) -> Extent:
        return extent(self.part())

    def last_filled(self, start: int) -> int | None:
        """The last row from ``start`` on that holds more than white space."""
        return last_filled(self.part(start))

    def kinds(self, column: int, start: int) -> frozenset[int] | None:
        """The kinds, besides empty, that a column's cells from ``start`` on can have; None for any."""
        return None

    @property
    def spark(self) -> SparkSession:
        return self.whole.sparkSession


@dataclass(frozen=True)
class LoadPlan:
    grid: Grid
    options: LoadOptions
    found: Extent
    rows: Window
    available: list[ColumnInfoNoDtype]
    selected: list[ColumnInfo]

    @classmethod
    def build(cls, grid: DataFrame | Grid, options: LoadOptions, start_col: int = 0, table_columns: Sequence[str] | None = None, found: Extent | None = None) -> LoadPlan:
        """``grid`` has ``_row, cells``; ``start_col`` is the sheet's column of the first cell. A table brings its own names and starts at row 0."""
        check_selection(options.use_columns)
        grid = grid if isinstance(grid, Grid) else Grid(grid)
        found = found or grid.extent()
        own = options
        if table_columns is not None:
            found = Extent(0, found.last if found.last is not None else -1, len(table_columns)) if not found.empty else Extent(None, None, len(table_columns))
            # A table's own range has no leading empty rows to jump.
            own = replace(options, skip_rows=0 if options.skip_rows is None else options.skip_rows)
        if table_columns is not None and options.header_row is None and options.column_names is None:
            rows = window(grid, found, own)
            names = name_columns(found.width, start_col, None, table_columns, None)
        else:
            rows = window(grid, found, own)
            header = None
            if rows.header is not None:
                line = grid.rows(rows.header, rows.header + 1, numbers=False).select("cells").first()
                header = [cell_text(c) for c in line["cells"]] if line is not None else []
            names = name_columns(found.width, start_col, header, options.column_names, options.use_columns)
        typed = _typed(grid, rows, options, select_columns(names, options.use_columns))
        return cls(grid, options, found, rows, names, typed)

    def column_infos(self) -> list[ColumnInfo]:
        """All columns of the range with their dtypes, guessed from the same sample as the selected ones'."""
        return _typed(self.grid, self.rows, self.options, self.available)

    def _inside(self, numbers: bool = True) -> DataFrame:
        r = self.rows
        inside = self.grid.rows(r.start + r.offset, r.start + r.limit, r.left_out_rows(), [c.index for c in self.selected], numbers or r.skip is not None)
        if r.skip is None:
            return inside

        def skipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not r.left_out(i) for i in b.column("_row").to_pylist()], pa.bool_()))

        return inside.mapInArrow(skipped, inside.schema)

    def dataframe(self, keep_row: bool = False) -> DataFrame:
        """The selected columns, typed; rows in no order, so ``keep_row`` adds ``_row`` to sort by."""
        cols = []
        for c in self.selected:
            value = self._value(c)
            cols.append(value.alias(c.name, metadata={"index": c.absolute_index, "column_name_from": c.column_name_from, "dtype_from": c.dtype_from}))
        return self._inside(keep_row).select(*(["_row"] if keep_row else []), *cols)

    def _value(self, c: ColumnInfo) -> Column:
        kinds = self.grid.kinds(c.index, self.rows.start + self.rows.offset)
        return C.coerce(F.get("cells", F.lit(c.index)), Dtype(c.dtype), self.options.whitespace_as_null, kinds)

    def errors(self) -> DataFrame:
        """``row, col, row_offset, detail`` of each selected cell that holds something its dtype cannot take."""
        found = []
        for c in self.selected:
            cell = F.get("cells", F.lit(c.index))
            held = F.coalesce(cell["k"] != C.EMPTY, F.lit(False))
            if self.options.whitespace_as_null:
                held = held & ~C.is_blank(cell)
            value = self._value(c)
            # A boolean's report lacks the closing quote, as callers may match on it.
            end = "" if c.dtype == Dtype.BOOL.value else "'"
            detail = F.concat(F.lit(f"Expected {c.dtype} but got '"), C.shown(cell), F.lit(end))
            found.append(F.when(held & value.isNull(), F.struct(F.lit(c.index).alias("col"), detail.alias("detail"))))
        if not found:
            return self._inside().sparkSession.createDataFrame([], "row bigint, col int, row_offset bigint, detail string")
        bad = self._inside().select("_row", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("e"))
        return bad.select(
            (F.col("_row") - self.rows.start).alias("row"), F.col("e.col").alias("col"), F.lit(self.rows.offset).cast("bigint").alias("row_offset"), F.col("e.detail").alias("detail")
        )


def _typed(grid: Grid, rows: Window, options: LoadOptions, columns: list[ColumnInfoNoDtype]) -> list[ColumnInfo]:
    given: dict[int, tuple[Dtype, DtypeFrom]] = {}
    d = options.dtypes
    for c in columns:
        if isinstance(d, Dtype):
            given[c.index] = (d, DtypeFrom.PROVIDED_FOR_ALL)
        elif isinstance(d, dict) and c.absolute_index in d:
            given[c.index] = (d[c.absolute_index], DtypeFrom.PROVIDED_BY_INDEX)
        elif isinstance(d, dict) and c.name in d:
            given[c.index] = (d[c.name], DtypeFrom.PROVIDED_BY_NAME)
    guess = [c for c in columns if c.index not in given]
    if guess:
        # Skipped rows inside the sample still vote: the sample is contiguous.
        end = rows.start + (rows.limit if options.schema_sample_rows is None else min(rows.limit, rows.offset + options.schema_sample_rows))
        sample = grid.rows(rows.start + rows.offset, end, columns=[c.index for c in guess], numbers=False)
        n, found = masks(sample, [c.index for c in guess], options.whitespace_as_null)
        for c, mask in zip(guess, found):
            given[c.index] = (lattice(mask, n, options.coercion, c.index), DtypeFrom.GUESSED)
    return [ColumnInfo(c.name, c.index, c.absolute_index, given[c.index][0].value, c.column_name_from, given[c.index][1].value) for c in columns]
