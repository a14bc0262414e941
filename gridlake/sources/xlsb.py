"""A binary workbook (.xlsb) parser: BIFF12 records in the parts of an Office package ([MS-XLSB])."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from ..errors import InternalError
from ..functions import coerce as C
from .formats import Cell, DefinedName, Metadata, SheetMeta, TableMeta, text_cell
from .xls import ERRORS, rk_number
from .xlsx import DATES, ELAPSED, format_kind

# Numbers of the records that are read.
ROW, RK, ERROR, BOOL, REAL, TEXT, SHARED, F_TEXT, F_REAL, F_BOOL, F_ERROR, RICH = 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 62
ITEM, FORMAT, XF, NAME, SHEET_DATA, END_SHEET_DATA, BOOK, SHEET, XFS, END_XFS = 19, 44, 47, 39, 145, 146, 153, 156, 617, 618


def records(part: bytes) -> Iterator[tuple[int, memoryview]]:
    """Kind and body of each record. Kind and size are numbers of seven bits a byte, of at most two and four bytes."""
    data, at = memoryview(part), 0

    def number(most: int) -> int:
        nonlocal at
        value = 0
        for k in range(most):
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << 7 * k
            if not byte & 0x80:
                break
        return value

    while at < len(data):
        kind, size = number(2), number(4)
        yield kind, data[at : at + size]
        at += size


def wide(body: memoryview, at: int = 0) -> tuple[str, int]:
    """A string with its count of UTF-16 units before it, and where it ends; a null one is empty."""
    n = struct.unpack_from("<I", body, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    end = at + 4 + 2 * n
    return bytes(body[at + 4 : end]).decode("utf-16-le", "replace"), end


class Xlsb:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book = next(n for n in self.zip.namelist() if n.endswith("workbook.bin"))
        rels = self._rels(book)
        self.metadata, self.paths, self.epoch = Metadata(), {}, 0
        for kind, body in records(self.zip.read(book)):
            if kind == BOOK and body[0] & 1:
                self.epoch = 1462
            elif kind == SHEET:
                rid, at = wide(body, 8)
                name = wide(body, at)[0]
                if "worksheet" in rels.get(rid, ("",))[0]:
                    self.metadata.sheets.append(SheetMeta(name, ("visible", "hidden", "veryhidden")[min(struct.unpack_from("<I", body)[0], 2)]))
                    self.paths[name] = rels[rid][1]
            elif kind == NAME and not struct.unpack_from("<I", body)[0] & 0x20:  # not a built-in one; formulas are stored parsed and not shown
                self.metadata.names.append(DefinedName(wide(body, 9)[0], ""))
        part = {kind: path for kind, path in rels.values()}
        self.shared = [wide(b, 1)[0] for k, b in records(self.zip.read(part["sharedStrings"])) if k == ITEM] if "sharedStrings" in part else []
        self.kinds = self._styles(self.zip.read(part["styles"])) if "styles" in part else []

    def _rels(self, part: str) -> dict[str, tuple[str, str]]:
        folder, name = posixpath.split(part)
        root = ET.fromstring(self.zip.read(posixpath.join(folder, "_rels", name + ".rels")))
        return {e.get("Id"): (e.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join("/", folder, e.get("Target"))).lstrip("/")) for e in root}

    @staticmethod
    def _styles(part: bytes) -> list[int]:
        own, out, inside = {}, [], False
        for kind, body in records(part):
            if kind == FORMAT:
                own[struct.unpack_from("<H", body)[0]] = format_kind(wide(body, 2)[0])
            elif kind in (XFS, END_XFS):
                inside = kind == XFS
            elif kind == XF and inside:
                n = struct.unpack_from("<H", body, 2)[0]
                out.append(own.get(n, C.ELAPSED if n in ELAPSED else C.SERIAL if n in DATES else C.FLOAT))
        return out

    def _number(self, style: int, x: float) -> Cell:
        kind = self.kinds[style] if style < len(self.kinds) else C.FLOAT
        return (kind, None, x + self.epoch if kind == C.SERIAL else x, None)

    def _cell(self, kind: int, body: memoryview) -> Cell | None:
        style = struct.unpack_from("<I", body, 4)[0] & 0xFFFFFF
        if kind == RK:
            return self._number(style, rk_number(struct.unpack_from("<I", body, 8)[0]))
        if kind in (REAL, F_REAL):
            return self._number(style, struct.unpack_from("<d", body, 8)[0])
        if kind in (BOOL, F_BOOL):
            return (C.BOOL, None, None, int(body[8] != 0))
        if kind in (ERROR, F_ERROR):
            return (C.ERROR, ERRORS.get(body[8], "#ERR"), None, None)
        if kind == SHARED:
            return text_cell(self.shared[struct.unpack_from("<I", body, 8)[0]])
        if kind in (TEXT, F_TEXT):
            return text_cell(wide(body, 8)[0])
        return text_cell(wide(body, 9)[0]) if kind == RICH else None

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, Cell]]]:
        row, cells, inside = -1, {}, False
        for kind, body in records(self.zip.read(self.paths[sheet])):
            if kind == SHEET_DATA:
                inside = True
            elif kind == END_SHEET_DATA:
                break
            elif inside and kind == ROW:
                if cells:
                    yield row, cells
                row, cells = struct.unpack_from("<I", body)[0], {}
            elif inside and (RK <= kind <= F_ERROR or kind == RICH) and (cell := self._cell(kind, body)) is not None:
                cells[struct.unpack_from("<I", body)[0]] = cell
        if cells:
            yield row, cells

    def tables(self) -> list[TableMeta]:
        raise InternalError("tables are only supported for XLSX workbooks")
