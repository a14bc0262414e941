"""Any DataFrame as a grid."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import coerce as C
from .operators.rows import Extent
from .plans.plan import Grid


def make_cell(kind: Column | int, s: Column | None = None, d: Column | None = None, i: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, int) else kind
    value = lambda x, t: (F.lit(None) if x is None else x).cast(t)
    return F.struct(kind.cast("tinyint").alias("k"), value(s, "string").alias("s"), value(d, "double").alias("d"), value(i, "bigint").alias("i"))


def empty_cell() -> Column:
    return make_cell(C.EMPTY)


def kind_of(spark_type: str) -> int:
    """The kind of the cells that a typed column becomes."""
    if spark_type in ("tinyint", "smallint", "int", "bigint"):
        return C.INT
    if spark_type in ("float", "double") or spark_type.startswith("decimal"):
        return C.FLOAT
    if spark_type == "boolean":
        return C.BOOL
    if spark_type == "string":
        return C.STRING
    if spark_type in ("timestamp", "timestamp_ntz", "date"):
        return C.ISO
    raise ValueError(f"a grid has no cells of {spark_type}")


def cell_of(col: Column, spark_type: str) -> Column:
    """A typed column as a cell: what a workbook would hold, integers kept as such."""
    kind = kind_of(spark_type)
    if kind == C.INT:
        cell = make_cell(kind, i=col)
    elif kind == C.FLOAT:
        cell = make_cell(kind, d=col)
    elif kind == C.BOOL:
        cell = make_cell(kind, i=col.cast("int"))
    elif kind == C.STRING:
        cell = make_cell(kind, s=col)
    else:
        cell = make_cell(kind, s=F.date_format(col, "yyyy-MM-dd" if spark_type == "date" else "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return F.when(col.isNull(), empty_cell()).otherwise(cell)


#: Rows of a range that ``numbered`` sorts in one task, about, and rows sampled for each range.
RANGE_ROWS, SAMPLED = 250_000, 64


def _bounds(df: DataFrame, keys: Sequence[str], n: int, ranges: int) -> list[Row]:
    """Keys that cut ``df`` into ``ranges`` parts of about equal size, by a sample whose size depends on their number alone."""
    some = df.select(*keys).sample(min(1.0, SAMPLED * ranges / n), seed=1).orderBy(*keys).collect()
    return [some[len(some) * k // ranges] for k in range(1, ranges)] if some else []


def _key(df: DataFrame, keys: Sequence[str], at: Row | None = None) -> Column:
    """The keys of a row, or those of ``at`` as a literal, to be compared; nulls are least, as in ORDER BY."""
    kinds = dict(df.dtypes)
    return F.struct(*((F.col(k) if at is None else F.lit(at[k])).cast(kinds[k]).alias(k) for k in keys))


def numbered(df: DataFrame, *keys: str, range_rows: int = RANGE_ROWS, n: int | None = None) -> DataFrame:
    """``df``, of ``n`` rows, with ``_row`` from 0 in the order of ``keys``, which should be unique.

    The driver settles bounds of ranges once, from a sample of keys, and counts each range's rows. From then on a row's range and number follow from its keys
    alone, so a job, a retried task or a second evaluation cannot number it otherwise. Ranges are sorted by a task each.
    """
    n = df.count() if n is None else n
    bounds = _bounds(df, keys, n, -(-n // range_rows)) if n > range_rows else []
    order = W.partitionBy("_range").orderBy(*keys)
    if not bounds:
        ranged, before = df.withColumn("_range", F.lit(0)), [0]
    else:
        # A row's range is the number of bounds that are not above it, found by bisection.
        some, mine = F.array(*(_key(df, keys, b) for b in bounds)), _key(df, keys)
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
        ranged = df.withColumn("_range", F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(some, at + step - 1) <= mine, at + step).otherwise(at)))
        counts = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
        before = list(itertools.accumulate((counts.get(k, 0) for k in range(len(bounds))), initial=0))
    start = F.get(F.array(*(F.lit(x).cast("bigint") for x in before)), F.col("_range"))
    return ranged.withColumn("_row", start + F.row_number().over(order) - 1).drop("_range")


def grid_of(df: DataFrame, row: Column, cells: Sequence[Column] | None = None, header: Sequence[str] | None = None) -> DataFrame:
    """A grid of ``df``: ``row`` from 0, a cell for each column but ``_row`` unless ``cells`` are given, under a header row if names are given."""
    cells = cells or [cell_of(F.col(c), t) for c, t in df.dtypes if c != "_row"]
    body = df.select((row + (1 if header else 0)).cast("bigint").alias("_row"), F.array(*cells).alias("cells"))
    if not header:
        return body
    top = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("_row"), F.array(*(make_cell(C.STRING, s=F.lit(h)) for h in header)).alias("cells"))
    return top.unionByName(body)


def grid_from_table(df: DataFrame, *keys: str, header: bool = True) -> DataFrame:
    """A table as a sheet: its column names in row 0, its rows in the order of ``keys``."""
    return grid_of(numbered(df, *keys), F.col("_row"), header=df.columns if header else None)


class TableGrid(Grid):
    """A table as a sheet, like ``grid_from_table``, whose parts do no more than they must: all rows of a table are a scan without numbers, and first rows are
    told from others by one key. Only what asks for the numbers of many rows sorts the table."""

    #: So many rows, at most, are sorted in one task by themselves.
    FEW = 10_000

    def __init__(self, df: DataFrame, *keys: str, header: bool = True):
        self.df, self.keys, self.names = df, keys, df.columns if header else []

    @cached_property
    def _counts(self) -> Row:
        """Number of rows, and of those whose keys are all null."""
        blank = reduce(and_, (F.col(k).isNull() for k in self.keys))
        return self.df.agg(F.count("*").alias("n"), F.count_if(blank).alias("blank")).first()

    @cached_property
    def _numbered(self) -> DataFrame:
        return numbered(self.df, *self.keys, n=self._counts["n"])

    @cached_property
    def whole(self) -> DataFrame:
        return self._cells(self._numbered, bool(self.names))

    def _cells(self, df: DataFrame, header: bool) -> DataFrame:
        return grid_of(df, F.col("_row") + (1 if self.names and not header else 0), header=self.names if header else None)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def extent(self) -> Extent:
        # Nulls come first: if any row has a key, then the last one has.
        head, n, blank = len(self.names[:1]), self._counts["n"], self._counts["blank"]
        if n and (blank == n or blank and not head):
            return super().extent()
        return Extent(0, head + n - 1, len(self.df.columns)) if head + n else Extent(None, None, 0)

    def last_filled(self, start: int) -> int | None:
        last, kinds = len(self.names[:1]) + self._counts["n"] - 1, dict(self.df.dtypes)
        if last < start or self._counts["n"] == self._counts["blank"] or any(kind_of(kinds[k]) == C.STRING for k in self.keys):
            return super().last_filled(start)
        return last

    def kinds(self, column: int, start: int) -> frozenset[int] | None:
        return frozenset({kind_of(self.df.dtypes[column][1])} | ({C.STRING} if self.names and start <= 0 else set()))

    def part(self, start: int = 0, end: int | None = None, columns: Sequence[int] | None = None) -> DataFrame:
        return self.rows(start, self._counts["n"] + 1 if end is None else end, columns=columns)

    def rows(self, start: int, end: int, left_out: Sequence[int] = (), columns: Sequence[int] | None = None, numbers: bool = True) -> DataFrame:
        head, n = len(self.names[:1]), self._counts["n"]
        a = max(0, start - head)
        b = max(a, min(n, end - head))
        out = [i - head for i in left_out if a <= i - head < b]
        # Only the rows before this one need to be told apart.
        told = max([a, *(i + 1 for i in out), b if b < n else 0])
        row = F.col("_row")
        inside = (row >= a) & (row < b)
        inside = inside & ~row.isin(out) if out else inside
        bare = self.df.withColumn("_row", F.lit(None).cast("bigint"))
        if a == b:
            body = bare.limit(0)
        elif not numbers and not told:
            body = bare
        elif not numbers and told == b and not a and not out and b <= self.FEW:
            body = bare.orderBy(*self.keys).limit(b)
        elif told <= self.FEW and told and (b < n or not numbers):
            mine = _key(self.df, self.keys)
            last = _key(self.df, self.keys, self.df.select(*self.keys).orderBy(*self.keys).offset(told - 1).limit(1).first())
            order = W.partitionBy(F.lit(0)).orderBy(*self.keys)
            body = self.df.filter(mine <= last).withColumn("_row", F.row_number().over(order).cast("bigint") - 1).filter(inside)
            body = body.unionByName(bare.filter(mine > last)) if b == n else body
        else:
            body = self._numbered.filter(inside)
        found = self._cells(body, bool(head and start <= 0 < end and 0 not in left_out))
        return found if numbers else found.drop("_row")
