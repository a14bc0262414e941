"""Row windows: which rows of a grid hold the header and the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParametersError
from ..functions.coerce import is_blank
from ..plans.options import LoadOptions

if TYPE_CHECKING:
    from ..plans.plan import Grid


@dataclass(frozen=True)
class Extent:
    """What one aggregation finds about a grid: used rows and the widest row; ``last_filled`` ignores blank text."""

    first: int | None
    last: int | None
    width: int

    @property
    def empty(self) -> bool:
        return self.first is None


def extent(grid: DataFrame) -> Extent:
    filled = F.exists("cells", lambda c: c["k"] != 0)
    row = grid.agg(
        F.min(F.when(filled, F.col("_row"))).alias("first"), F.max(F.when(filled, F.col("_row"))).alias("last"), F.max(F.size("cells")).alias("width")
    ).first()
    return Extent(row["first"], row["last"], row["width"] if row["first"] is not None else 0)


@dataclass(frozen=True)
class Window:
    """Rows ``start`` (of the range), ``offset`` and ``limit`` (of the data, counted from ``start``) in the sheet."""

    start: int
    height: int
    offset: int
    limit: int
    skipped: frozenset[int]
    header: int | None
    #: A callable that tells which data rows to leave out, and how many it does; evaluated by tasks, never row by row on the driver.
    skip: Callable[[int], bool] | None = None
    n_skipped: int = 0

    @property
    def rows(self) -> int:
        return max(0, self.limit - self.offset)

    def left_out(self, row: int) -> bool:
        return self.skip(row - self.start - self.offset)

    def left_out_rows(self) -> list[int]:
        """The listed rows in the sheet."""
        return sorted(self.start + self.offset + i for i in self.skipped)


def range_start(options: LoadOptions, first_filled: int) -> int:
    """Leading empty rows are jumped only by default: without a stated skip, and with the header in the first row or nowhere."""
    if options.header_row in (None, 0) and options.skip_rows is None:
        return first_filled
    return options.header_row or 0


def last_filled(rows: DataFrame) -> int | None:
    """The last row that holds more than white space."""
    some = F.exists("cells", lambda c: ~is_blank(c))
    return rows.agg(F.max(F.when(some, F.col("_row")))).first()[0]


def _count_skipped(spark: SparkSession, skip: Callable[[int], bool], rows: int) -> int:
    """How many of ``rows`` a callable leaves out; an error if it raises, or returns anything but a bool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, wrong = 0, None
            for i in b.column("id").to_pylist():
                try:
                    got = skip(i)
                except Exception as e:
                    wrong = f"skip_rows callable failed on row {i}: {e}"
                    break
                if not isinstance(got, bool):
                    wrong = f"skip_rows callable must return a bool, got {got!r}"
                    break
                n += got
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([wrong], pa.string())], ["n", "wrong"])

    found = spark.range(rows).mapInArrow(run, "n bigint, wrong string").agg(F.sum("n").alias("n"), F.min("wrong").alias("wrong")).first()
    if found["wrong"] is not None:
        raise InvalidParametersError(found["wrong"])
    return found["n"] or 0


def window(grid: Grid, found: Extent, options: LoadOptions) -> Window:
    if found.empty:
        return Window(0, 0, 0, 0, frozenset(), None)
    start = range_start(options, found.first)
    height = max(0, found.last - start + 1)
    header = start if options.header_row is not None and options.column_names is None else None
    skip = options.skip_rows if isinstance(options.skip_rows, int) else 0
    if skip > height:
        raise InvalidParametersError(f"Too many rows skipped. Max height is {height}")
    offset = (header is not None) + skip
    upper = height
    if options.skip_whitespace_tail_rows and height:
        tail = grid.last_filled(start)
        upper = 1 if tail is None else tail - start + 1
    limit = upper if options.n_rows is None else min(offset + options.n_rows, upper)
    limit = max(limit, offset)
    listed = options.skip_rows if isinstance(options.skip_rows, frozenset) else frozenset()
    listed = frozenset(i for i in listed if i < limit - offset)
    if callable(options.skip_rows):
        n = _count_skipped(grid.spark, options.skip_rows, limit - offset)
        return Window(start, height, offset, limit, listed, header, options.skip_rows, n)
    return Window(start, height, offset, limit, listed, header, None, len(listed))
