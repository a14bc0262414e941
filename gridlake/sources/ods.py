"""An OpenDocument spreadsheet parser on the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from ..errors import InternalError
from ..functions import coerce as C
from .formats import Cell, DefinedName, Metadata, SheetMeta, TableMeta, number_cell, text_cell
from .xlsx import local


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def _paragraph(e: ET.Element) -> str:
    parts = [e.text or ""]
    for x in e:
        tag = local(x.tag)
        if tag == "s":
            parts.append(" " * int(_attr(x, "c") or 1))
        elif tag == "tab":
            parts.append("\t")
        elif tag == "line-break":
            parts.append("\n")
        elif tag != "annotation":
            parts.append(_paragraph(x))
        parts.append(x.tail or "")
    return "".join(parts)


class Ods:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.metadata = Metadata()
        hidden: set[str] = set()
        style = None
        with self.zip.open("content.xml") as f:
            for event, e in ET.iterparse(f, events=("start", "end")):
                tag = local(e.tag)
                if event == "start" and tag == "style":
                    style = _attr(e, "name")
                elif event == "start" and tag == "table-properties" and _attr(e, "display") == "false":
                    hidden.add(style)
                elif event == "start" and tag == "table":
                    self.metadata.sheets.append(SheetMeta(_attr(e, "name"), "hidden" if _attr(e, "style-name") in hidden else "visible"))
                elif event == "start" and tag in ("named-range", "named-expression"):
                    self.metadata.names.append(DefinedName(_attr(e, "name"), _attr(e, "cell-range-address") or _attr(e, "expression") or ""))
                elif event == "end" and tag == "table-row":
                    e.clear()

    @staticmethod
    def _cell(e: ET.Element) -> Cell | None:
        kind = _attr(e, "value-type")
        text = "\n".join(_paragraph(x) for x in e if local(x.tag) == "p")
        formula_error = (_attr(e, "formula") is not None) and text.startswith("#")
        if formula_error:
            return (C.ERROR, text, None, None)
        if kind in ("float", "percentage", "currency"):
            return number_cell(float(_attr(e, "value")))
        if kind == "boolean":
            return (C.BOOL, None, None, int(_attr(e, "boolean-value") == "true"))
        if kind == "date":
            return (C.ISO, _attr(e, "date-value"), None, None)
        if kind == "time":
            return (C.ISO_DURATION, _attr(e, "time-value"), None, None)
        if kind == "string":
            return text_cell(_attr(e, "string-value") or text)
        return None

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, Cell]]]:
        inside, at = False, 0
        with self.zip.open("content.xml") as f:
            for event, e in ET.iterparse(f, events=("start", "end")):
                tag = local(e.tag)
                if tag == "table":
                    if event == "end" and inside:
                        return
                    inside = event == "start" and _attr(e, "name") == sheet
                elif event == "end" and tag == "table-row":
                    if inside:
                        cells: dict[int, Cell] = {}
                        col = 0
                        for x in e:
                            if local(x.tag) not in ("table-cell", "covered-table-cell"):
                                continue
                            n = int(_attr(x, "number-columns-repeated") or 1)
                            if (cell := self._cell(x)) is not None:
                                cells.update((col + k, cell) for k in range(n))
                            col += n
                        times = int(_attr(e, "number-rows-repeated") or 1)
                        if cells:
                            for k in range(times):
                                yield at + k, cells
                        at += times
                    e.clear()

    def tables(self) -> list[TableMeta]:
        raise InternalError("tables are only supported for XLSX workbooks")
