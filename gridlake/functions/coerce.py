"""Cells to typed values, as Column expressions; every coercion is total, and what does not convert is null.

A cell is a struct: ``k`` kind, ``s`` text, ``d`` number, ``i`` integer (also 0 and 1 of a boolean).
"""

from __future__ import annotations

from collections.abc import Collection

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.options import Dtype

CELL = "struct<k:tinyint,s:string,d:double,i:bigint>"
GRID = f"_row bigint, cells array<{CELL}>"

EMPTY, INT, FLOAT, STRING, BOOL, SERIAL, ELAPSED, ISO, ISO_DURATION, ERROR = range(10)
KIND_NAMES = ("Empty", "Int", "Float", "String", "Bool", "DateTime", "Duration", "DateTimeIso", "DurationIso", "Error")

BLANK = r"^\p{IsWhite_Space}*$"
_INTEGER = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DAY_MS = 86_400_000


def is_blank(cell: Column) -> Column:
    return (cell["k"] == EMPTY) | ((cell["k"] == STRING) & cell["s"].rlike(BLANK))


@F.pandas_udf(StringType())
def float_text(x: pd.Series) -> pd.Series:
    """A number with at most nine decimals, without trailing zeros.

    C formatting rounds the exact binary value; the JVM's rounds its shortest decimal text, which differs at ties."""
    return pd.Series([None if v != v else ("%.9f" % v).rstrip("0").rstrip(".") for v in x.to_numpy()], dtype=object)


#: Kinds, besides empty, that a cell can have; None for any.
Kinds = Collection[int] | None


def _when(cell: Column, cases: dict[tuple[int, ...], Column], kind: str, among: Kinds = None) -> Column:
    """The value of the case that a cell's kind names. Cases that cannot occur are left out: a Python function in one would get all rows."""
    out = None
    for kinds, value in cases.items():
        kinds = [k for k in kinds if among is None or k in among]
        if kinds:
            test = cell["k"].isin(*kinds) if len(kinds) > 1 else cell["k"] == kinds[0]
            out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(None).cast(kind) if out is None else out.otherwise(F.lit(None).cast(kind))


def to_boolean(cell: Column, among: Kinds = None) -> Column:
    return _when(cell, {(BOOL, INT): cell["i"] != 0, (FLOAT,): cell["d"] != 0.0}, "boolean", among)


def to_int(cell: Column, among: Kinds = None) -> Column:
    """Numbers are cut towards zero; out of range, and texts that are not plain integers, are null."""
    text = F.when(cell["s"].rlike(_INTEGER), cell["s"].try_cast("bigint"))
    return _when(cell, {(INT, BOOL): cell["i"], (FLOAT,): cell["d"].try_cast("bigint"), (STRING,): text}, "bigint", among)


def to_float(cell: Column, among: Kinds = None) -> Column:
    text = F.when(cell["s"].rlike(_NUMBER), cell["s"].try_cast("double"))
    return _when(cell, {(FLOAT,): cell["d"], (INT, BOOL): cell["i"].cast("double"), (STRING,): text}, "double", among)


def _shifted(days: Column) -> Column:
    """Milliseconds since 1899-12-31 of a serial; from 60 on serials count a 29 February 1900 that never was."""
    ms = F.round(days * _DAY_MS).try_cast("bigint")
    return F.when(days < 60, ms).otherwise(ms - _DAY_MS)


def serial_to_datetime(days: Column) -> Column:
    return F.timestamp_add("MILLISECOND", _shifted(days), F.expr("TIMESTAMP_NTZ'1899-12-31 00:00:00'"))


def serial_to_date(days: Column) -> Column:
    return serial_to_datetime(days).cast("date")


def datetime_text(at: Column) -> Column:
    ms = F.date_format(at, "SSS")
    plain = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    return F.when(ms == "000", plain).otherwise(F.concat(plain, F.lit("."), ms))


def to_string(cell: Column, among: Kinds = None) -> Column:
    return _when(
        cell,
        {
            (STRING, ISO, ISO_DURATION): cell["s"],
            (FLOAT,): float_text(cell["d"]),
            (INT,): cell["i"].cast("string"),
            (BOOL,): F.when(cell["i"] != 0, "true").otherwise("false"),
            (SERIAL,): datetime_text(serial_to_datetime(cell["d"])),
            (ELAPSED,): float_text(cell["d"]),
        },
        "string",
        among,
    )


def _number(cell: Column) -> Column:
    return F.when(cell["k"] == INT, cell["i"].cast("double")).otherwise(cell["d"])


def _iso_datetime(cell: Column) -> Column:
    return F.regexp_replace(cell["s"], "(Z|[+-][0-9]{2}:?[0-9]{2})$", "").try_cast("timestamp_ntz")


def to_datetime(cell: Column, among: Kinds = None) -> Column:
    with_date_only = F.coalesce(cell["s"].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))
    iso = F.when(with_date_only, cell["s"].try_cast("date").cast("timestamp_ntz")).otherwise(_iso_datetime(cell))
    return _when(cell, {(SERIAL, FLOAT, INT): serial_to_datetime(_number(cell)), (ISO,): iso}, "timestamp_ntz", among)


def to_date(cell: Column, among: Kinds = None) -> Column:
    iso = F.substring(cell["s"], 1, 10).try_cast("date")
    return _when(cell, {(SERIAL, FLOAT, INT): serial_to_date(_number(cell)), (ISO,): iso}, "date", among)


def duration_ms(cell: Column, among: Kinds = None) -> Column:
    """Milliseconds of a duration. Plain numbers are none."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(cell["s"], f"([0-9.]+){unit}", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    hours = part("H") * 3_600_000 + part("M") * 60_000 + part("S") * 1000
    iso = F.when(cell["s"].rlike(r"^PT([0-9.]+H)?([0-9.]+M)?([0-9.]+S)?$"), F.round(hours).try_cast("bigint"))
    return _when(cell, {(SERIAL, ELAPSED): F.round(cell["d"] * _DAY_MS).try_cast("bigint"), (ISO_DURATION,): iso}, "bigint", among)


def to_duration(cell: Column, among: Kinds = None) -> Column:
    return F.make_dt_interval(secs=(duration_ms(cell, among) / 1000).cast("decimal(18,6)"))


_TO = {
    Dtype.INT: to_int,
    Dtype.FLOAT: to_float,
    Dtype.STRING: to_string,
    Dtype.BOOL: to_boolean,
    Dtype.DATETIME: to_datetime,
    Dtype.DATE: to_date,
    Dtype.DURATION: to_duration,
}


def coerce(cell: Column, dtype: Dtype, whitespace_as_null: bool = False, among: Kinds = None) -> Column:
    if dtype == Dtype.NULL:
        return F.lit(None)
    out = _TO[dtype](cell, among)
    if dtype == Dtype.STRING and whitespace_as_null:
        out = F.when(~is_blank(cell), out)
    return out


def shown(cell: Column) -> Column:
    """A cell as an error report prints it, such as ``String("foo")``."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(cell["s"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    inner = _when(
        cell,
        {
            (STRING, ISO, ISO_DURATION): quoted,
            (INT,): cell["i"].cast("string"),
            (FLOAT, SERIAL, ELAPSED): cell["d"].cast("string"),
            (BOOL,): F.when(cell["i"] != 0, "true").otherwise("false"),
            (ERROR,): cell["s"],
        },
        "string",
    )
    name = F.element_at(F.array(*map(F.lit, KIND_NAMES)), cell["k"].cast("int") + 1)
    return F.when(cell["k"] == EMPTY, name).otherwise(F.concat(name, F.lit("("), inner, F.lit(")")))
