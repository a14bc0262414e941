"""Typed columns on the driver: what a loaded sheet holds, column by column, and columns made by hand."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa

from ..errors import ArrowError, InvalidColumnError
from ..plans.options import Dtype

ARROW_TYPES = {
    Dtype.NULL: pa.null(),
    Dtype.INT: pa.int64(),
    Dtype.FLOAT: pa.float64(),
    Dtype.STRING: pa.string(),
    Dtype.BOOL: pa.bool_(),
    Dtype.DATETIME: pa.timestamp("ms"),
    Dtype.DATE: pa.date32(),
    Dtype.DURATION: pa.duration("ms"),
}


class TypedColumn:
    """A named vector of one dtype; None is a missing value. A column of nulls has but a length."""

    def __init__(self, name: str, dtype: Dtype | str, values: pa.Array | Iterable | None = None, length: int | None = None):
        self.name, self.dtype = name, Dtype(dtype)
        if self.dtype == Dtype.NULL:
            if length is None:
                raise InvalidColumnError(f'column "{name}" of nulls needs a length')
            self.values = pa.nulls(length)
            return
        if values is None:
            raise InvalidColumnError(f'column "{name}" needs values')
        try:
            self.values = values if isinstance(values, pa.Array) and values.type == ARROW_TYPES[self.dtype] else pa.array(values, ARROW_TYPES[self.dtype])
        except (pa.ArrowException, TypeError) as e:
            raise InvalidColumnError(f'column "{name}" cannot hold {self.dtype.value}: {e}') from e
        if length not in (None, len(self.values)):
            raise InvalidColumnError(f'column "{name}" has {len(self.values)} values and not {length}')

    def __len__(self) -> int:
        return len(self.values)

    def into(self, dtype: Dtype | str) -> list:
        """The values, if the column is of ``dtype``."""
        if Dtype(dtype) != self.dtype:
            raise InvalidColumnError(f'column "{self.name}" is {self.dtype.value} and not {Dtype(dtype).value}')
        return self.values.to_pylist()


def to_table(columns: Sequence[TypedColumn]) -> pa.Table:
    """Columns of one length side by side."""
    lengths = {len(c) for c in columns}
    if len(lengths) > 1:
        raise InvalidColumnError(f"columns differ in length: {sorted(lengths)}")
    try:
        return pa.table([c.values for c in columns], names=[c.name for c in columns])
    except pa.ArrowException as e:
        raise ArrowError(str(e)) from e
