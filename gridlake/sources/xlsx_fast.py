"""Sheet XML in bulk: the cells of a piece of a sheet are found by one regular expression and turned into Arrow columns without a Python object a cell.

The expression knows cells as common writers emit them. A piece that holds any cell it does not cover whole goes, as a piece, to the XML parser, so
what is read never depends on which way it took.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import coerce as C
from .formats import Cell

#: Bytes of XML taken up at a time, and cells of the grid made at a time.
PIECE, FLUSH_CELLS = 4 << 20, 1 << 20
CELL_TYPE = pa.struct([("k", pa.int8()), ("s", pa.string()), ("d", pa.float64()), ("i", pa.int64())])

_CELL = re.compile(
    rb'<c r="([A-Z]{1,3})([0-9]+)"(?: s="([0-9]+)")?(?: t="([a-zA-Z]+)")?\s*'
    rb'(?:/>|>(?:<f[^<>]*(?:/>|>[^<]*</f>))?(?:<v>([^<]*)</v>|<v/>|<is><t(?: xml:space="preserve")?>([^<]*)</t></is>)?</c>)'
)
_START = re.compile(rb'<c r="([A-Z]{1,3})([0-9]+)"')


def column_number(letters: bytes) -> int:
    n = 0
    for c in letters:
        n = n * 26 + c - 64
    return n - 1


class _Columns(dict):
    def __missing__(self, letters: bytes) -> int:
        self[letters] = n = column_number(letters)
        return n


def pieces(stream: BinaryIO) -> Iterator[bytes]:
    """Whole rows of the sheet's data, some at a time. A sheet whose tags have a prefix gives one piece: all of it, as it is."""
    held = b""
    begun = False
    while True:
        more = stream.read(PIECE)
        held += more
        if not begun:
            at = held.find(b"<sheetData")
            if at < 0:
                if more:
                    continue
                if b":sheetData" in held:
                    yield held
                return
            close = held.find(b">", at)
            if close < 0 and more:
                continue
            if held[close - 1 : close] == b"/":
                return
            begun, held = True, held[close + 1 :]
        end = held.find(b"</sheetData>")
        if end >= 0 or not more:
            if body := held[:end] if end >= 0 else held:
                yield body
            return
        cut = held.rfind(b"</row>")
        if cut >= 0:
            yield held[: cut + 6]
            held = held[cut + 6 :]


def used(stream: BinaryIO, parse: Callable[[bytes], Iterator[tuple[int, dict[int, Cell]]]]) -> tuple[int, int, int | None, int | None]:
    """First column, width, and first and last row (None if empty) of the cells that hold something."""
    columns, first, last = _Columns(), None, None
    low, high = None, -1

    def seen(rows: list[int], cols: list[int]) -> None:
        nonlocal first, last, low, high
        if rows:
            first, last = min(rows) if first is None else min(first, *rows), max(rows) if last is None else max(last, *rows)
            low, high = min(cols) if low is None else min(low, *cols), max(high, *cols)

    for piece in pieces(stream):
        starts = piece.count(b'<c r="')
        # Where every cell has a value, the first and the last cell of a row tell its extent; nothing begins before column A.
        if starts and starts == piece.count(b"<c") and starts == piece.count(b"<v>") + piece.count(b"<is><t") and b"<v></v>" not in piece:
            rows = piece.split(b"</row>")
            ends = {r.rpartition(b'<c r="')[2][:4] for r in rows} | (set() if low == 0 else {r.partition(b'<c r="')[2][:4] for r in rows})
            cols = [columns[m[0]] for m in map(re.compile(rb"[A-Z]+").match, ends) if m]
            seen([int(_START.match(piece, at)[2]) - 1 for at in (piece.find(b'<c r="'), piece.rfind(b'<c r="'))], cols)
        else:
            for r, cells in parse(piece):
                seen([r], [min(cells), max(cells)])
    return low or 0, high - low + 1 if low is not None else 0, first, last


def _some(texts: pa.Array, part: str) -> bool:
    return bool(pc.any(pc.match_substring(texts, part)).as_py())


def _plain(texts: pa.Array) -> pa.Array:
    """Texts without XML's escapes and with its line ends."""
    if not _some(texts, "&") and not _some(texts, "\r"):
        return texts
    return pa.array([unescape(x).replace("\r\n", "\n").replace("\r", "\n") for x in texts.to_pylist()], pa.string())


class Sheet:
    """One sheet's rows as Arrow batches."""

    def __init__(self, shared: Callable[[], pa.Array], styles: list[int], epoch: float, parse: Callable[[bytes], Iterator[tuple[int, dict[int, Cell]]]]):
        self.shared, self.styles, self.epoch, self.parse = shared, styles, epoch, parse
        self.columns = _Columns()

    def _found(self, piece: bytes):
        """Row, column, kind, text, number and integer of each cell of a piece, or None if it has cells of another make."""
        found = _CELL.findall(piece)
        if len(found) != piece.count(b"<c ") + piece.count(b"<c>") + piece.count(b"<c/"):
            return None
        if not found:
            return [np.zeros(0, np.int64)] * 3 + [pa.array([], pa.string()), np.zeros(0), np.zeros(0, np.int64)]
        letters, *others = zip(*found)
        col = np.fromiter(map(self.columns.__getitem__, letters), np.int64, len(found))
        rows, style, kind, value, inline = (pa.array(x, pa.binary()).cast(pa.string()) for x in others)
        row = rows.cast(pa.int64()).to_numpy() - 1
        kind = kind.dictionary_encode()
        of, names = kind.indices.to_numpy(), kind.dictionary.to_pylist()
        k, d, i = np.zeros(len(found), np.int8), np.zeros(len(found)), np.zeros(len(found), np.int64)
        texts: list[tuple[np.ndarray, pa.Array]] = []
        held = pc.binary_length(value).to_numpy() > 0
        for n, name in enumerate(names):
            at = np.flatnonzero((of == n) & held)
            here = value.take(pa.array(at))
            if name in ("", "n"):
                d[at] = here.cast(pa.float64()).to_numpy()
                k[at] = C.FLOAT
                if self.styles and len(at):
                    shown = style.take(pa.array(at)).dictionary_encode()
                    kinds = np.array([self.styles[int(x or 0)] for x in shown.dictionary.to_pylist()], np.int8)
                    k[at] = kinds[shown.indices.to_numpy()]
                    d[at[k[at] == C.SERIAL]] += self.epoch
            elif name == "s":
                k[at] = C.STRING
                texts.append((at, self.shared().take(here.cast(pa.int64()))))
            elif name == "b":
                k[at] = C.BOOL
                i[at] = pc.is_in(here, pa.array(["1", "true"])).to_numpy(zero_copy_only=False)
            elif name in ("e", "d"):
                k[at] = C.ERROR if name == "e" else C.ISO
                texts.append((at, _plain(here)))
            elif name in ("inlineStr", "str"):
                at = np.flatnonzero(of == n)
                here = (inline if name == "inlineStr" else value).take(pa.array(at))
                # An empty text, or none: the tags tell, which are not at hand. Escapes are for the parser too.
                if pc.min(pc.binary_length(here)).as_py() == 0 or _some(here, "_x") or _some(here, "&#"):
                    return None
                k[at] = C.STRING
                texts.append((at, _plain(here)))
            else:
                return None
        place = np.full(len(found), -1, np.int64)
        base = 0
        for at, t in texts:
            place[at] = base + np.arange(len(at))
            base += len(at)
        every = pa.concat_arrays([t for _, t in texts]) if texts else pa.array([], pa.string())
        return row, col, k, every.take(pa.array(place, mask=place < 0)), d, i

    def _parsed(self, piece: bytes):
        cells = [(r, c, *cell) for r, found in self.parse(piece) for c, cell in found.items()]
        r, c, k, s, d, i = zip(*cells) if cells else [()] * 6
        number = lambda x, t: np.array([v or 0 for v in x], t)
        return number(r, np.int64), number(c, np.int64), number(k, np.int8), pa.array(s, pa.string()), number(d, np.float64), number(i, np.int64)

    def batches(self, stream: BinaryIO, col_start: int, width: int, row_start: int, row_end: int | None, columns: frozenset[int] | None) -> Iterator[pa.RecordBatch]:
        """``_row, cells`` from the first to the last row that holds something; rows without cells between come as empty ones."""
        following = row_start
        for piece in pieces(stream):
            try:
                found = self._found(piece)
            except (pa.ArrowException, ValueError):
                found = None
            row, col, k, s, d, i = self._parsed(piece) if found is None else found
            if row_end is not None and len(row) and row[0] >= row_end:
                return
            keep = np.flatnonzero((k != C.EMPTY) & (row >= following) & (row < row_end if row_end is not None else True))
            if not len(keep):
                continue
            if not (np.diff(row[keep]) >= 0).all():
                keep = keep[np.argsort(row[keep], kind="stable")]
            row, col, k, s, d, i = row[keep], col[keep] - col_start, k[keep], s.take(pa.array(keep)), d[keep], i[keep]
            step = max(1, FLUSH_CELLS // max(width, 1))
            last = int(row[-1])
            for low in range(following, last + 1, step):
                high = min(low + step, last + 1)
                a, z = np.searchsorted(row, [low, high])
                yield self._grid(low, high, *(x[a:z] for x in (row, col, k)), s.slice(a, z - a), d[a:z], i[a:z], width, columns)
            following = last + 1

    @staticmethod
    def _grid(low: int, high: int, row: np.ndarray, col: np.ndarray, k: np.ndarray, s: pa.Array, d: np.ndarray, i: np.ndarray, width: int, columns: frozenset[int] | None) -> pa.RecordBatch:
        size = (high - low) * width
        inside = (col >= 0) & (col < width)
        if columns is not None:
            inside &= np.isin(col, list(columns))
        source = np.flatnonzero(inside)
        at = (row[source] - low) * width + col[source]
        kinds, where = np.zeros(size, np.int8), np.full(size, -1, np.int64)
        kinds[at], where[at] = k[source], source
        number, whole = np.zeros(size), np.zeros(size, np.int64)
        number[at], whole[at] = d[source], i[source]
        text = s.take(pa.array(where, mask=where < 0)) if len(s) else pa.nulls(size, pa.string())
        numeric = (kinds == C.FLOAT) | (kinds == C.SERIAL) | (kinds == C.ELAPSED)
        flat = pa.StructArray.from_arrays([pa.array(kinds), text, pa.array(number, mask=~numeric), pa.array(whole, mask=kinds != C.BOOL)], fields=list(CELL_TYPE))
        offsets = pa.array(np.arange(high - low + 1, dtype=np.int32) * width)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), pa.ListArray.from_arrays(offsets, flat)], ["_row", "cells"])
