"""A streaming XLSX parser on the standard library (Office Open XML, ECMA-376)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import BinaryIO
from xml.etree import ElementTree as ET

import pyarrow as pa

from ..functions import coerce as C
from . import xlsx_fast
from .formats import Cell, DefinedName, Metadata, SheetMeta, TableMeta, Used, number_cell, text_cell

#: Built-in number formats that show a date or a time, and those that show elapsed time.
DATES = {*range(14, 23), *range(27, 37), 45, 47, *range(50, 59)}
ELAPSED = {46}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def format_kind(code: str) -> int:
    """The kind of number that a format code shows: a plain one, a date or time, or elapsed time."""
    code = code.split(";")[0]
    if re.search(r"\[(h+|m+|s+)\]", code, re.I):
        return C.ELAPSED
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]', "", code)
    if bare.strip().lower() == "general":
        return C.FLOAT
    return C.SERIAL if re.search("[dmyhs]", re.sub("(?i)general|e[+-]", "", bare), re.I) else C.FLOAT


def reference(ref: str) -> tuple[int, int]:
    """Row and column from 0 of a cell reference such as ``B12``."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", ref)
    if not m:
        raise ValueError(f"not a cell reference: {ref!r}")
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def area(ref: str) -> tuple[int, int, int, int]:
    a, _, b = ref.partition(":")
    (r0, c0), (r1, c1) = reference(a), reference(b or a)
    return r0, c0, r1, c1


def _unescaped(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


class Xlsx:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.book = next((n for n in ("xl/workbook.xml",) if n in self.zip.namelist()), None) or next(n for n in self.zip.namelist() if n.endswith("workbook.xml"))
        root = ET.fromstring(self.zip.read(self.book))
        rels = self._rels(self.book)
        self.metadata, self.paths = Metadata(), {}
        self.epoch = 0
        for e in root.iter():
            tag = local(e.tag)
            if tag == "workbookPr" and e.get("date1904") in ("1", "true"):
                self.epoch = 1462  # days from 1899-12-30 to 1904-01-01
            elif tag == "sheet":
                state = {"hidden": "hidden", "veryHidden": "veryhidden"}.get(e.get("state", ""), "visible")
                rid = next((v for k, v in e.attrib.items() if local(k) == "id"), None)
                if rid in rels and "worksheet" in rels[rid][0]:
                    self.metadata.sheets.append(SheetMeta(e.get("name"), state))
                    self.paths[e.get("name")] = rels[rid][1]
            elif tag == "definedName":
                self.metadata.names.append(DefinedName(e.get("name"), e.text or ""))

    def _rels(self, part: str) -> dict[str, tuple[str, str]]:
        folder, name = posixpath.split(part)
        try:
            root = ET.fromstring(self.zip.read(f"{folder}/_rels/{name}.rels"))
        except KeyError:
            return {}
        return {e.get("Id"): (e.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join("/", folder, e.get("Target"))).lstrip("/")) for e in root}

    def _part(self, kind: str) -> str | None:
        return next((p for t, p in self._rels(self.book).values() if t == kind and p in self.zip.namelist()), None)

    @cached_property
    def shared(self) -> list[str]:
        out: list[str] = []
        if part := self._part("sharedStrings"):
            with self.zip.open(part) as f:
                for _, e in ET.iterparse(f):
                    if local(e.tag) == "si":
                        out.append(self._rich(e))
                        e.clear()
        return out

    @staticmethod
    def _rich(e: ET.Element) -> str:
        """Text of a string item, its phonetic hints left out."""
        parts = []
        for x in e:
            if local(x.tag) == "t":
                parts.append(x.text or "")
            elif local(x.tag) == "r":
                parts += [t.text or "" for t in x if local(t.tag) == "t"]
        return _unescaped("".join(parts))

    @cached_property
    def styles(self) -> list[int]:
        """The kind of number that each cell format shows."""
        part = self._part("styles")
        if part is None:
            return []
        root = ET.fromstring(self.zip.read(part))
        own = {int(e.get("numFmtId")): format_kind(e.get("formatCode", "")) for e in root.iter() if local(e.tag) == "numFmt"}
        out = []
        for e in root:
            if local(e.tag) == "cellXfs":
                for x in e:
                    n = int(x.get("numFmtId", 0))
                    out.append(own.get(n, C.ELAPSED if n in ELAPSED else C.SERIAL if n in DATES else C.FLOAT))
        return out

    def _cell(self, e: ET.Element) -> Cell | None:
        kind, value, inline = e.get("t", "n"), None, None
        for x in e:
            tag = local(x.tag)
            if tag == "v":
                value = x.text
            elif tag == "is":
                inline = x
        if kind == "inlineStr":
            return text_cell(self._rich(inline)) if inline is not None else None
        if value is None:
            return text_cell("") if kind == "str" else None
        if kind == "n":
            x = float(value)
            shows = self.styles[int(e.get("s", 0))] if self.styles else C.FLOAT
            if shows == C.FLOAT:
                return number_cell(x)
            return (shows, None, x + self.epoch if shows == C.SERIAL else x, None)
        if kind == "s":
            return text_cell(self.shared[int(value)])
        if kind == "str":
            return text_cell(_unescaped(value))
        if kind == "b":
            return (C.BOOL, None, None, int(value in ("1", "true")))
        if kind == "e":
            return (C.ERROR, value, None, None)
        if kind == "d":
            return (C.ISO, value, None, None)
        raise ValueError(f"unknown cell type {kind!r}")

    def _rows(self, stream: BinaryIO, before: int = -1) -> Iterator[tuple[int, dict[int, Cell]]]:
        at = before
        data = None
        for event, e in ET.iterparse(stream, events=("start", "end")):
            tag = local(e.tag)
            if event == "start":
                if tag == "sheetData":
                    data = e
                continue
            if tag == "row":
                at = int(e.get("r")) - 1 if e.get("r") else at + 1
                cells: dict[int, Cell] = {}
                col = -1
                for x in e:
                    col = reference(x.get("r"))[1] if x.get("r") else col + 1
                    if (cell := self._cell(x)) is not None:
                        cells[col] = cell
                if cells:
                    yield at, cells
                e.clear()
                if data is not None:
                    data.clear()
            elif tag == "sheetData":
                return

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, Cell]]]:
        with self.zip.open(self.paths[sheet]) as f:
            yield from self._rows(f)

    def _pieces_parser(self) -> Callable[[bytes], Iterator[tuple[int, dict[int, Cell]]]]:
        """Parses pieces of one sheet in their order: rows without a number follow the row before."""
        last = -1

        def parse(piece: bytes) -> Iterator[tuple[int, dict[int, Cell]]]:
            nonlocal last
            prefixes = set(re.findall(rb"[ <]([A-Za-z][A-Za-z0-9]*):", piece)) - {b"xml"}
            names = b"".join(b' xmlns:%s="%s"' % (x, x) for x in sorted(prefixes))
            whole = piece if b":sheetData" in piece else b"<sheetData" + names + b">" + piece + b"</sheetData>"
            for last, cells in self._rows(io.BytesIO(whole), last):
                yield last, cells

        return parse

    def used(self, sheet: str) -> Used:
        with self.zip.open(self.paths[sheet]) as f:
            return Used(*xlsx_fast.used(f, self._pieces_parser()))

    @cached_property
    def _shared_array(self) -> pa.Array:
        return pa.array(self.shared, pa.string())

    def batches(self, sheet: str, col_start: int, width: int, row_start: int = 0, row_end: int | None = None, columns: frozenset[int] | None = None) -> Iterator[pa.RecordBatch]:
        reader = xlsx_fast.Sheet(lambda: self._shared_array, self.styles, self.epoch, self._pieces_parser())
        with self.zip.open(self.paths[sheet]) as f:
            yield from reader.batches(f, col_start, width, row_start, row_end, columns)

    def tables(self) -> list[TableMeta]:
        out = []
        for s in self.metadata.sheets:
            for kind, part in self._rels(self.paths[s.name]).values():
                if kind == "table":
                    root = ET.fromstring(self.zip.read(part))
                    r0, c0, r1, _ = area(root.get("ref"))
                    head, totals = int(root.get("headerRowCount", 1)), int(root.get("totalsRowCount", 0))
                    columns = tuple(_unescaped(e.get("name")) for e in root.iter() if local(e.tag) == "tableColumn")
                    out.append(TableMeta(root.get("displayName") or root.get("name"), s.name, columns, r0 + head, c0, max(0, r1 - totals - r0 - head + 1)))
        return out
