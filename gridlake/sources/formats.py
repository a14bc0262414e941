"""What all workbook parsers share: cells, metadata and the choice of a parser."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

from ..errors import WorkbookFormatError
from ..functions import coerce as C

#: kind, text, number, integer
Cell = tuple[int, str | None, float | None, int | None]
EMPTY: Cell = (C.EMPTY, None, None, None)


def text_cell(s: str) -> Cell:
    return (C.STRING, s, None, None)


def number_cell(x: float) -> Cell:
    return (C.FLOAT, None, x, None)


@dataclass(frozen=True)
class SheetMeta:
    name: str
    visible: str = "visible"


@dataclass(frozen=True)
class TableMeta:
    """A named table: the first row and column and the size of its data, header and totals left out."""

    name: str
    sheet: str
    columns: tuple[str, ...]
    first_row: int
    first_col: int
    n_rows: int


@dataclass(frozen=True)
class DefinedName:
    name: str
    formula: str

    def __repr__(self) -> str:
        formula = self.formula.encode()
        short = formula[:10].decode(errors="ignore") + "..." if len(formula) > 10 else self.formula
        return f'DefinedName<name="{self.name}", formula="{short}">'


@dataclass
class Metadata:
    sheets: list[SheetMeta] = field(default_factory=list)
    names: list[DefinedName] = field(default_factory=list)


class Workbook(Protocol):
    """A parser; ``used`` and ``batches``, where it has them, do in bulk what ``used_range`` and ``grid_batches`` do by rows."""

    metadata: Metadata

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, Cell]]]:
        """Rows that hold something, in order: number and cells by column."""

    def tables(self) -> list[TableMeta]: ...


def open_workbook(content: bytes) -> Workbook:
    """A parser for the bytes, by what they are and not by a file name."""
    from .ods import Ods
    from .xls import Xls
    from .xlsb import Xlsb
    from .xlsx import Xlsx

    try:
        if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            return Xls(content)
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
        if "content.xml" in names:
            return Ods(content)
        if "xl/workbook.xml" in names or any(n.endswith("workbook.xml") for n in names):
            return Xlsx(content)
        if any(n.endswith("workbook.bin") for n in names):
            return Xlsb(content)
    except (zipfile.BadZipFile, KeyError, ValueError, SyntaxError, EOFError, IndexError, StopIteration, struct.error) as e:
        raise WorkbookFormatError(f"cannot open workbook: {e}") from e
    raise WorkbookFormatError("cannot open workbook: not a known format")


class Used(NamedTuple):
    """The range of a sheet's cells that hold something."""

    col_start: int
    width: int
    first: int | None
    last: int | None


def used_range(book: Workbook, sheet: str) -> Used:
    """By the parser's own quick way, or from all rows."""
    if hasattr(book, "used"):
        return book.used(sheet)
    low, high, first, last = None, -1, None, None
    for r, cells in book.rows(sheet):
        if cells:
            low = min(cells) if low is None else min(low, min(cells))
            high, last = max(high, max(cells)), r
            first = r if first is None else first
    return Used(low or 0, high - low + 1 if low is not None else 0, first, last)
