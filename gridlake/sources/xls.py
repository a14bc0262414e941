"""A BIFF8 (.xls) parser: the compound file's directory, then the workbook stream's records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..errors import InternalError, WorkbookFormatError
from ..functions import coerce as C
from .formats import Cell, DefinedName, Metadata, SheetMeta, TableMeta, text_cell
from .xlsx import DATES, ELAPSED, format_kind

# Codes of error cells.
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}
END = 0xFFFFFFFE
BOF, EOF_, CONTINUE = 0x809, 0x0A, 0x3C


def workbook_stream(data: bytes) -> bytes:
    """The ``Workbook`` stream of a compound file."""
    u32 = lambda b, o=0: struct.unpack_from("<I", b, o)[0]
    size, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    difat = list(struct.unpack_from("<109I", data, 76))
    nxt = u32(data, 68)
    while nxt < END and len(difat) < 1 << 20:
        s = sector(nxt)
        difat += struct.unpack(f"<{size // 4 - 1}I", s[:-4])
        nxt = u32(s, size - 4)
    fat: list[int] = []
    for n in difat:
        if n < END - 2 and len(s := sector(n)) == size:
            fat += struct.unpack(f"<{size // 4}I", s)

    def chain(n: int) -> bytes:
        out, seen = [], 0
        while n < len(fat) and seen <= len(fat):
            out.append(sector(n))
            n, seen = fat[n], seen + 1
        return b"".join(out)

    directory = chain(u32(data, 48))
    root = small = None
    found = None
    for at in range(0, len(directory), 128):
        e = directory[at : at + 128]
        name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
        if e[66] == 5:
            root = u32(e, 116)
        elif name in ("Workbook", "Book"):
            found = (u32(e, 116), u32(e, 120))
    if found is None:
        raise WorkbookFormatError("cannot open workbook: no workbook stream")
    start, length = found
    if length >= u32(data, 56):
        return chain(start)[:length]
    small = chain(root)
    table = chain(u32(data, 60))
    links = struct.unpack(f"<{len(table) // 4}I", table)
    out = []
    while start < len(links):
        out.append(small[start * mini : (start + 1) * mini])
        start = links[start]
    return b"".join(out)[:length]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Type, body and continuations of each record from an offset on."""
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        body, at = stream[at + 4 : at + 4 + n], at + 4 + n
        more = []
        while at + 4 <= len(stream) and struct.unpack_from("<H", stream, at)[0] == CONTINUE:
            n = struct.unpack_from("<H", stream, at + 2)[0]
            more.append(stream[at + 4 : at + 4 + n])
            at += 4 + n
        yield kind, body, more


class _Pieces:
    """Reads over the pieces of a record; a string's characters may change width where a piece ends."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.k, self.at = pieces, 0, 0

    def _next(self) -> None:
        self.k, self.at = self.k + 1, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            got = self.pieces[self.k][self.at : self.at + n - len(out)]
            self.at += len(got)
            out += got
            if len(out) < n:
                self._next()
        return out

    def string(self, count: int | None = None) -> str:
        if self.at >= len(self.pieces[self.k]):
            self._next()
        n = struct.unpack("<H", self.take(2))[0] if count is None else count
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, []
        while n:
            left = len(self.pieces[self.k]) - self.at
            if not left:
                self._next()
                wide = self.take(1)[0] & 1
                continue
            m = min(n, left // (2 if wide else 1))
            raw = self.take(m * (2 if wide else 1))
            out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= m
        self.take(4 * runs + extra)
        return "".join(out)


def rk_number(raw: int) -> float:
    value = float(struct.unpack("<i", struct.pack("<I", raw))[0] >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class Xls:
    def __init__(self, content: bytes):
        self.stream = workbook_stream(content)
        self.metadata, self.at, self.shared, self.formats, self.kinds, self.epoch = Metadata(), {}, [], {}, [], 0
        xfs = []
        for kind, body, more in records(self.stream):
            if kind == BOF and struct.unpack_from("<H", body)[0] != 0x600:
                raise WorkbookFormatError("cannot open workbook: only BIFF8 is supported")
            if kind == 0x85:  # a sheet
                where, state, what = struct.unpack_from("<IBB", body)
                if what == 0:
                    name = _Pieces([body[7:]]).string(body[6])
                    self.metadata.sheets.append(SheetMeta(name, ("visible", "hidden", "veryhidden")[state & 3]))
                    self.at[name] = where
            elif kind == 0xFC:
                p = _Pieces([body, *more])
                n = struct.unpack("<II", p.take(8))[1]
                self.shared = [p.string() for _ in range(n)]
            elif kind == 0x41E:
                self.formats[struct.unpack_from("<H", body)[0]] = format_kind(_Pieces([body[2:], *more]).string())
            elif kind == 0xE0:
                xfs.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == 0x22 and body[:1] == b"\1":
                self.epoch = 1462
            elif kind == 0x18 and len(body) > 14 and not struct.unpack_from("<H", body)[0] & 0x20:
                self.metadata.names.append(DefinedName(_Pieces([body[14:]]).string(body[3]), ""))
            elif kind == EOF_:
                break
        self.kinds = [self.formats.get(n, C.ELAPSED if n in ELAPSED else C.SERIAL if n in DATES else C.FLOAT) for n in xfs]

    def _number(self, xf: int, x: float) -> Cell:
        kind = self.kinds[xf] if xf < len(self.kinds) else C.FLOAT
        return (kind, None, x + self.epoch if kind == C.SERIAL else x, None)

    def _cells(self, sheet: str) -> Iterator[tuple[int, int, Cell]]:
        waiting = None
        for kind, body, more in records(self.stream, self.at[sheet]):
            if kind == EOF_:
                return
            if kind == 0x207 and waiting:  # the text of the formula before
                yield *waiting, text_cell(_Pieces([body, *more]).string())
                waiting = None
            if kind not in (0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x205, 0x06):
                continue
            row, col, xf = struct.unpack_from("<HHH", body)
            if kind == 0x203:
                yield row, col, self._number(xf, struct.unpack_from("<d", body, 6)[0])
            elif kind == 0x27E:
                yield row, col, self._number(xf, rk_number(struct.unpack_from("<I", body, 6)[0]))
            elif kind == 0xBD:
                for k in range((len(body) - 6) // 6):
                    xf, raw = struct.unpack_from("<HI", body, 4 + 6 * k)
                    yield row, col + k, self._number(xf, rk_number(raw))
            elif kind == 0xFD:
                yield row, col, text_cell(self.shared[struct.unpack_from("<I", body, 6)[0]])
            elif kind == 0x204:
                yield row, col, text_cell(_Pieces([body[6:], *more]).string())
            elif kind == 0x205:
                yield row, col, (C.ERROR, ERRORS.get(body[6], "#ERR"), None, None) if body[7] else (C.BOOL, None, None, int(body[6]))
            elif body[12:14] != b"\xff\xff":
                yield row, col, self._number(xf, struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 0:
                waiting = (row, col)
            elif body[6] == 1:
                yield row, col, (C.BOOL, None, None, int(body[8]))
            elif body[6] == 2:
                yield row, col, (C.ERROR, ERRORS.get(body[8], "#ERR"), None, None)
            else:
                yield row, col, text_cell("")

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, Cell]]]:
        by_row: dict[int, dict[int, Cell]] = {}
        for r, c, cell in self._cells(sheet):  # a sheet has 65,536 rows at most
            by_row.setdefault(r, {})[c] = cell
        yield from sorted(by_row.items())

    def tables(self) -> list[TableMeta]:
        raise InternalError("tables are only supported for XLSX workbooks")
