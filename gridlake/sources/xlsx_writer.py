"""A minimal XLSX writer for fixtures and benchmarks: values, two date styles, tables, defined names, visibility."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


@dataclass(frozen=True)
class Serial:
    """A number shown as a date and time, or as elapsed time."""

    days: float
    elapsed: bool = False


@dataclass(frozen=True)
class ErrorCell:
    code: str


@dataclass
class SheetSpec:
    name: str
    #: Rows of values: None, bool, int, float, str, Serial, ErrorCell; ``at`` is the first cell's row and column.
    rows: Iterable[Sequence]
    at: tuple[int, int] = (0, 0)
    state: str = "visible"
    #: name, area reference, column names
    tables: list[tuple[str, str, list[str]]] = field(default_factory=list)


def letters(col: int) -> str:
    out = ""
    col += 1
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, Serial):
        return f'<c r="{ref}" s="{2 if v.elapsed else 1}"><v>{v.days!r}</v></c>'
    if isinstance(v, ErrorCell):
        return f'<c r="{ref}" t="e"><v>{escape(v.code)}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def write_xlsx(sheets: Sequence[SheetSpec], names: Sequence[tuple[str, str]] = ()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        n_tables = 0
        for k, sheet in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}"><sheetData>'.encode())
                r0, c0 = sheet.at
                for r, row in enumerate(sheet.rows, r0 + 1):
                    cells = "".join(_cell(f"{letters(c)}{r}", v) for c, v in enumerate(row, c0))
                    if cells:
                        f.write(f'<row r="{r}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
            links = []
            for name, ref, columns in sheet.tables:
                n_tables += 1
                inner = "".join(f'<tableColumn id="{i}" name={quoteattr(c)}/>' for i, c in enumerate(columns, 1))
                z.writestr(f"xl/tables/table{n_tables}.xml", f'<table xmlns="{MAIN}" id="{n_tables}" name="{name}" displayName="{name}" ref="{ref}"><tableColumns>{inner}</tableColumns></table>')
                links.append(f'<Relationship Id="rId{n_tables}" Type="{REL}/table" Target="../tables/table{n_tables}.xml"/>')
            if links:
                z.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", f'<Relationships xmlns="{PACKAGE}">{"".join(links)}</Relationships>')
        state = {"hidden": ' state="hidden"', "veryhidden": ' state="veryHidden"'}
        listed = "".join(f'<sheet name={quoteattr(s.name)} sheetId="{k}" r:id="rId{k}"{state.get(s.state, "")}/>' for k, s in enumerate(sheets, 1))
        defined = "".join(f"<definedName name={quoteattr(n)}>{escape(f)}</definedName>" for n, f in names)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets><definedNames>{defined}</definedNames></workbook>')
        rels = "".join(f'<Relationship Id="rId{k}" Type="{REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        rels += f'<Relationship Id="rIdS" Type="{REL}/styles" Target="styles.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{rels}</Relationships>')
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="[h]:mm:ss"/></numFmts>'
            '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        )
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
    return out.getvalue()
