"""Options of a load, column metadata and their argument parsing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import Enum

from ..errors import InvalidParametersError


class Dtype(str, Enum):
    NULL = "null"
    INT = "int"
    FLOAT = "float"
    STRING = "string"
    BOOL = "boolean"
    DATETIME = "datetime"
    DATE = "date"
    DURATION = "duration"

    @classmethod
    def parse(cls, token: str) -> Dtype:
        try:
            return cls(token)
        except ValueError:
            raise InvalidParametersError(f'unsupported dtype: "{token}"') from None

    @property
    def spark(self) -> str:
        return SPARK_TYPES[self]


SPARK_TYPES = {
    Dtype.NULL: "void",
    Dtype.INT: "bigint",
    Dtype.FLOAT: "double",
    Dtype.STRING: "string",
    Dtype.BOOL: "boolean",
    Dtype.DATETIME: "timestamp_ntz",
    Dtype.DATE: "date",
    Dtype.DURATION: "interval day to second",
}


class Coercion(str, Enum):
    COERCE = "coerce"
    STRICT = "strict"

    @classmethod
    def parse(cls, token: str) -> Coercion:
        try:
            return cls(token)
        except ValueError:
            raise InvalidParametersError(f'unsupported dtype_coercion: "{token}"') from None


class NameFrom(str, Enum):
    PROVIDED = "provided"
    LOOKED_UP = "looked_up"
    GENERATED = "generated"


class DtypeFrom(str, Enum):
    PROVIDED_FOR_ALL = "provided_for_all"
    PROVIDED_BY_INDEX = "provided_by_index"
    PROVIDED_BY_NAME = "provided_by_name"
    GUESSED = "guessed"


@dataclass(frozen=True)
class ColumnInfoNoDtype:
    name: str
    #: Position in the used range, and in the sheet.
    index: int
    absolute_index: int
    column_name_from: str


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    index: int
    absolute_index: int
    dtype: str
    column_name_from: str
    dtype_from: str


#: None, or one dtype for all, or dtypes by name or absolute index.
Dtypes = Dtype | dict[str | int, Dtype] | None


def parse_dtypes(value: object) -> Dtypes:
    if value is None:
        return None
    if isinstance(value, str):
        return Dtype.parse(value)
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if isinstance(k, bool) or not isinstance(k, (str, int)):
                raise InvalidParametersError(f"dtypes must be keyed by column name or index, got {k!r}")
            out[k] = Dtype.parse(v)
        return out
    raise InvalidParametersError(f"unsupported object type for dtypes: {value!r}")


def parse_idx_or_name(value: object) -> int | str:
    if isinstance(value, str) or isinstance(value, int) and not isinstance(value, bool) and value >= 0:
        return value
    raise InvalidParametersError(f"expected a name or a non-negative index, got {value!r}")


SkipRows = None | int | frozenset | Callable[[int], bool]


def parse_skip_rows(value: object) -> SkipRows:
    natural = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    if value is None or natural(value):
        return value
    if callable(value):
        return value
    if isinstance(value, Sequence) and not isinstance(value, str) and all(map(natural, value)):
        return frozenset(value)
    raise InvalidParametersError(f"skip_rows must be a non-negative int, a list of them or a callable, got {value!r}")


@dataclass(frozen=True)
class LoadOptions:
    """What to load from a sheet or a table; ``for_sheet`` and ``for_table`` differ in the header's default."""

    header_row: int | None = 0
    column_names: tuple[str, ...] | None = None
    skip_rows: SkipRows = None
    n_rows: int | None = None
    schema_sample_rows: int | None = 1000
    coercion: Coercion = Coercion.COERCE
    use_columns: object = None
    dtypes: Dtypes = field(default=None, hash=False)
    skip_whitespace_tail_rows: bool = False
    whitespace_as_null: bool = False

    @classmethod
    def build(
        cls,
        header_row=0,
        column_names=None,
        skip_rows=None,
        n_rows=None,
        schema_sample_rows=1000,
        dtype_coercion="coerce",
        use_columns=None,
        dtypes=None,
        skip_whitespace_tail_rows=False,
        whitespace_as_null=False,
    ) -> LoadOptions:
        if schema_sample_rows is not None and schema_sample_rows <= 0:
            raise InvalidParametersError("schema_sample_rows cannot be 0, as it would prevent dtype inferring")
        return cls(
            header_row,
            None if column_names is None else tuple(column_names),
            parse_skip_rows(skip_rows),
            n_rows,
            schema_sample_rows,
            Coercion.parse(dtype_coercion),
            use_columns,
            parse_dtypes(dtypes),
            skip_whitespace_tail_rows,
            whitespace_as_null,
        )

    @classmethod
    def for_sheet(cls, **options) -> LoadOptions:
        return cls.build(**{"header_row": 0} | options)

    @classmethod
    def for_table(cls, **options) -> LoadOptions:
        return cls.build(**{"header_row": None} | options)
