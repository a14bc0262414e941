"""Sampled schema inference: one aggregation over the sample, then a small lattice on the driver."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CannotRetrieveCellDataError, UnsupportedColumnTypeCombinationError, WorkbookCellError
from ..functions import coerce as C
from ..plans.options import Coercion, Dtype

log = logging.getLogger("gridlake.types.dtype")

# Texts that count as missing when a dtype is guessed.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Error cells that count as missing; any other fails.
NULL_ERRORS = ("#N/A", "#VALUE!", "#NULL!", "#REF!", "#NUM!", "#DIV/0!")

BITS = {Dtype.INT: 1, Dtype.FLOAT: 2, Dtype.STRING: 4, Dtype.BOOL: 8, Dtype.DATETIME: 16, Dtype.DATE: 32, Dtype.DURATION: 64}
BROKEN = 128


def cell_bit(cell: Column, whitespace_as_null: bool = False) -> Column:
    """The bit of a cell's dtype, 0 if it counts as missing."""
    missing = cell["s"].isin(*NULL_TEXTS)
    if whitespace_as_null:
        missing = missing | cell["s"].rlike(C.BLANK)
    k = cell["k"]
    return (
        F.when(k == C.INT, BITS[Dtype.INT])
        .when(k == C.FLOAT, BITS[Dtype.FLOAT])
        .when((k == C.STRING) & ~missing, BITS[Dtype.STRING])
        .when(k == C.BOOL, BITS[Dtype.BOOL])
        .when((k == C.SERIAL) | (k == C.ISO) & cell["s"].contains("T"), BITS[Dtype.DATETIME])
        .when(k == C.ISO, BITS[Dtype.DATE])
        .when(k.isin(C.ELAPSED, C.ISO_DURATION), BITS[Dtype.DURATION])
        .when((k == C.ERROR) & ~cell["s"].isin(*NULL_ERRORS), BROKEN)
        .otherwise(0)
    )


def masks(sample: DataFrame, positions: Sequence[int], whitespace_as_null: bool = False) -> tuple[int, list[int]]:
    """Number of rows and, for each column, the union of its cells' bits."""
    cols = [F.coalesce(F.bit_or(cell_bit(F.get("cells", F.lit(p)), whitespace_as_null)), F.lit(0)) for p in positions]
    row = sample.agg(F.count("*"), *cols).first()
    return row[0], list(row[1:])


def lattice(mask: int, rows: int, coercion: Coercion = Coercion.COERCE, column: int = 0) -> Dtype:
    """The dtype that holds all that a mask names."""
    names = [d for d, bit in BITS.items() if mask & bit]
    if mask & BROKEN:
        raise WorkbookCellError(f"column {column} holds an error cell")
    if not names:
        if not rows:
            return Dtype.NULL
        log.warning("Could not determine dtype for column %s, falling back to string", column)
        return Dtype.STRING
    if len(names) == 1:
        return names[0]
    if coercion == Coercion.STRICT:
        raise UnsupportedColumnTypeCombinationError(f"type coercion is strict and column contains {sorted(d.value for d in names)}").with_context(
            f"could not determine dtype for column {column}"
        )
    for dtype, parts in ((Dtype.INT, (Dtype.INT, Dtype.BOOL)), (Dtype.FLOAT, (Dtype.INT, Dtype.FLOAT, Dtype.BOOL))):
        if set(names) <= set(parts):
            return dtype
    if Dtype.DURATION not in names:
        return Dtype.STRING
    raise UnsupportedColumnTypeCombinationError(f"could not determine dtype of {sorted(d.value for d in names)}").with_context(f"could not determine dtype for column {column}")


def cell_dtype(grid: DataFrame, row: int, column: int) -> Dtype | None:
    """The dtype of one cell, None if it is empty or like one; an error if there is no such cell, or if it holds an error."""
    found = grid.filter(F.col("_row") == row).select(F.size("cells").alias("n"), cell_bit(F.get("cells", F.lit(column))).alias("bit")).first()
    if found is None or not 0 <= column < found["n"]:
        raise CannotRetrieveCellDataError(f"could not retrieve data at ({row},{column})")
    if found["bit"] == BROKEN:
        raise WorkbookCellError(f"the cell at ({row},{column}) holds an error")
    return next((d for d, bit in BITS.items() if bit == found["bit"]), None)
