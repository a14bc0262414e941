"""Workbooks written here and read back, by every way in and out."""

import datetime as dt
import io
import struct
import zipfile

import pyarrow as pa
import pytest

from gridlake.errors import InternalError, InvalidParametersError, SheetNotFoundError, WorkbookFormatError
from gridlake.reader import read_workbook
from gridlake.sources import xlsx_fast
from gridlake.sources.datasource import register
from gridlake.sources.formats import open_workbook
from gridlake.sources.scan import binary, scan_all
from gridlake.sources.xls import rk_number
from gridlake.sources.xlsx import Xlsx, format_kind
from gridlake.sources.xlsx_writer import ErrorCell, Serial, SheetSpec, write_xlsx
from gridlake.streaming.folder import stream_folder

MONTHS = [("Month", "Year"), (1, 2019), (2, 2020)]


@pytest.fixture(scope="module")
def content():
    users = [("User Id", "FirstName", "LastName"), (1, "Jamal", "Oot"), (2, "Anna", "Müller"), (5, "Zoé", None)]
    typed = [(None, "bools", "dates", "span"), (0, True, Serial(44622.23824074074), Serial(0.25, elapsed=True)), (1, False, None, None), (ErrorCell("#N/A"), True, None, None)]
    return write_xlsx(
        [
            SheetSpec("January", MONTHS),
            SheetSpec("people", users, at=(4, 3), state="hidden", tables=[("users", "D5:F8", ["User Id", "FirstName", "LastName"])]),
            SheetSpec("typed", typed, state="veryhidden"),
            SheetSpec("empty", []),
        ],
        [("AddingValues", "SUM(sheet1!$K$5:$K$6)"), ("NamedConstant", "3.4")],
    )


@pytest.fixture(scope="module")
def book(spark, content):
    return read_workbook(content, spark)


def test_metadata(book):
    assert book.sheet_names == ["January", "people", "typed", "empty"]
    assert [r["visible"] for r in book.sheets_dataframe().orderBy("sheet_idx").collect()] == ["visible", "hidden", "veryhidden", "visible"]
    assert book.table_names() == ["users"] and book.table_names("January") == []
    assert [(n.name, n.formula) for n in book.defined_names()] == [("AddingValues", "SUM(sheet1!$K$5:$K$6)"), ("NamedConstant", "3.4")]
    assert repr(book.defined_names()[0]) == 'DefinedName<name="AddingValues", formula="SUM(sheet1...">'


def test_sheet(book):
    sheet = book.load_sheet("January")
    assert (sheet.width, sheet.height, sheet.total_height, sheet.offset, sheet.visible) == (2, 2, 2, 1, "visible")
    assert sheet.to_arrow().to_pydict() == {"Month": [1.0, 2.0], "Year": [2019.0, 2020.0]}
    assert pa.record_batch(sheet).to_pydict() == sheet.to_arrow().to_pydict()
    assert pa.schema(sheet) == sheet.to_arrow().schema
    assert sheet.to_pandas()["Year"].tolist() == [2019.0, 2020.0]
    assert book.load_sheet_eager(0).equals(sheet.to_arrow())


def test_types(book):
    sheet = book.load_sheet("typed")
    got = sheet.to_arrow()
    assert [f.type for f in got.schema] == [pa.float64(), pa.bool_(), pa.timestamp("ms"), pa.duration("ms")]
    assert got.column("dates").to_pylist()[0] == dt.datetime(2022, 3, 2, 5, 43, 4)
    assert got.column("span").to_pylist() == [dt.timedelta(hours=6), None, None]
    assert got.column("__UNNAMED__0").to_pylist() == [0.0, 1.0, None]


def test_errors(book):
    table, errors = book.load_sheet("people", dtypes={"FirstName": "int"}).to_arrow_with_errors()
    assert table.column("FirstName").to_pylist() == [None] * 3
    assert [e.offset_position for e in errors.errors] == [(0, 1), (1, 1), (2, 1)]
    assert book.load_sheet("January").to_arrow_with_errors()[1] is None


def test_shifted(book):
    people = book.load_sheet("people")
    assert [c.absolute_index for c in people.selected_columns] == [3, 4, 5]
    assert book.load_sheet("people", use_columns="D,F").to_arrow().column_names == ["User Id", "LastName"]


def test_table(book):
    users = book.load_table("users")
    assert users.sheet_name == "people" and users.height == 3
    assert users.to_arrow().to_pydict() == {"User Id": [1.0, 2.0, 5.0], "FirstName": ["Jamal", "Anna", "Zoé"], "LastName": ["Oot", "Müller", None]}
    assert book.load_table("users", use_columns=["LastName", "FirstName"]).to_arrow().column("FirstName").to_pylist() == ["Jamal", "Anna", "Zoé"]
    assert book.load_table("users", header_row=0).to_arrow().column_names == ["1", "Jamal", "Oot"]
    assert book.load_table("users", use_columns=[5, 3], n_rows=1).to_arrow().to_pydict() == {"LastName": ["Oot"], "User Id": [1.0]}
    assert book.load_table("users", column_names=["a", "b", "c"], skip_rows=2).to_arrow().to_pydict() == {"a": [5.0], "b": ["Zoé"], "c": [None]}


def test_empty(book):
    assert book.load_sheet("empty").to_arrow().num_rows == 0


def test_lookup_errors(book, spark):
    with pytest.raises(SheetNotFoundError, match="Available sheets"):
        book.load_sheet("nope")
    with pytest.raises(SheetNotFoundError, match="out of range"):
        book.load_sheet(9)
    with pytest.raises(InvalidParametersError):
        book.load_sheet(-1)
    with pytest.raises(InvalidParametersError, match="source must be a string or bytes"):
        read_workbook(3, spark)
    for bad in (b"not a workbook", b"PK\3\4broken", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 600):
        with pytest.raises(WorkbookFormatError):
            open_workbook(bad)


def test_path_and_sources(spark, content, tmp_path):
    (tmp_path / "one.xlsx").write_bytes(content)
    (tmp_path / "two.xlsx").write_bytes(write_xlsx([SheetSpec("January", MONTHS)]))
    assert read_workbook(tmp_path / "one.xlsx", spark).load_sheet(0).height == 2
    counts = {(r["path"].rpartition("/")[2], r["sheet"]): r["count"] for r in scan_all(binary(spark, str(tmp_path))).groupBy("path", "sheet").count().collect()}
    assert counts == {("one.xlsx", "January"): 3, ("one.xlsx", "people"): 8, ("one.xlsx", "typed"): 4, ("two.xlsx", "January"): 3}
    register(spark)
    assert spark.read.format("workbook").option("sheet", "January").load(str(tmp_path)).count() == 6
    assert spark.read.format("workbook").option("row_end", 2).load(str(tmp_path / "one.xlsx")).filter("sheet = 'January'").count() == 2


SHEET_XML = b"""<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:x14ac="u"><dimension ref="A1"/><sheetData>
<row r="2" spans="1:4" x14ac:dyDescent="0.25"><c r="B2" t="s"><v>0</v></c><c r="C2" s="1"><v>44622.5</v></c><c r="D2" s="3"/></row>%s</sheetData></worksheet>"""
ODD_ROWS = [
    b'<row r="3"><c r="B3"><f>1+1</f><v>2</v></c><c r="C3" t="str"><f>"a"</f><v>a &amp; b</v></c></row>',
    b'<row r="4"><c r="B4" t="b"><v>1</v></c><c r="C4" t="e"><v>#N/A</v></c><c r="D4" t="inlineStr"><is><t>x &lt;y&gt;</t></is></c></row>',
    b'<row r="5"><c s="1" r="B5"><v>1</v></c><c r="C5" t="str"><v></v></c></row>',
    b'<row r="7"><c r="AA7" t="inlineStr"><is><r><t>ri</t></r><r><t>ch</t></r></is></c><c r="AB7" t="d"><v>2024-01-02</v></c></row>',
    b'<row r="8" x14ac:dyDescent="0.2"><c r="B8"><v> 7 </v></c><c r="C8" t="str"><v>_x0041_&#233;</v></c></row>',
    b'<row><c><v>5</v></c><c t="inlineStr"><is><t></t></is></c></row>',
    b'<row r="12"><c r="B12" t="n"><v>-1.5E-2</v></c><c r="C12" s="2"><v>0.25</v></c></row>',
]


@pytest.mark.parametrize("piece", [64, 300, 1 << 22])
@pytest.mark.parametrize("rows", [ODD_ROWS, ODD_ROWS[:2], ODD_ROWS[:1] + ODD_ROWS[-1:], []])
def test_bulk_parser(monkeypatch, piece, rows):
    """Whatever is found in bulk, or piece by piece by the XML parser, is what the XML parser finds in the whole sheet."""
    monkeypatch.setattr(xlsx_fast, "PIECE", piece)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(write_xlsx([SheetSpec("S", [])]))) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, SHEET_XML % b"".join(rows) if name.endswith("sheet1.xml") else old.read(name))
        new.writestr("xl/sharedStrings.xml", "<sst><si><t>one</t></si></sst>")
        rels = old.read("xl/_rels/workbook.xml.rels").decode()
    content = out.getvalue()
    fixed = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(fixed, "w") as new:
        for name in old.namelist():
            link = '<Relationship Id="s" Type="x/sharedStrings" Target="sharedStrings.xml"/></Relationships>'
            new.writestr(name, rels.replace("</Relationships>", link) if name.endswith("workbook.xml.rels") else old.read(name))
    book = Xlsx(fixed.getvalue())
    want = {r: dict(c) for r, c in book.rows("S")}
    columns = [c for cells in want.values() for c in cells]
    assert tuple(book.used("S")) == (min(columns), max(columns) - min(columns) + 1, min(want), max(want))
    got = {}
    for batch in book.batches("S", 0, 30):
        for row in batch.to_pylist():
            found = {c: (x["k"], x["s"], x["d"], x["i"]) for c, x in enumerate(row["cells"]) if x["k"]}
            got[row["_row"]] = found
    assert {r: c for r, c in got.items() if c} == want and sorted(got) == list(range(max(want) + 1))
    part = [r for b in book.batches("S", 1, 2, 2, 8, frozenset({1})) for r in b.to_pylist()]
    assert all(r["cells"][0]["k"] == 0 and 2 <= r["_row"] < 8 for r in part)
    assert {r["_row"]: r["cells"][1]["k"] for r in part if r["cells"][1]["k"]} == {r: c[2][0] for r, c in want.items() if 2 <= r < 8 and 2 in c}


def test_kept_rows(spark, content):
    sheet = read_workbook(content, spark).load_sheet("January", eager=True)
    assert sheet.to_spark().is_cached is False and sheet.to_spark(keep_row=True).is_cached and sheet.to_spark().count() == 2
    sheet.release()
    assert not sheet.to_spark(keep_row=True).is_cached
    assert {c.name: c.into("float") for c in sheet.to_columns()} == {"Month": [1.0, 2.0], "Year": [2019.0, 2020.0]}


def test_stream(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(write_xlsx([SheetSpec("January", MONTHS)]))
    rows = stream_folder(spark, str(tmp_path), {"month": (0, "int"), "year": (1, "int")})
    q = rows.writeStream.format("memory").queryName("months").outputMode("append").start()
    try:
        q.processAllAvailable()
        (tmp_path / "b.xlsx").write_bytes(write_xlsx([SheetSpec("February", MONTHS)]))
        q.processAllAvailable()
        got = spark.table("months").orderBy("sheet", "month").collect()
        assert [(r["sheet"], r["month"], r["year"]) for r in got] == [("February", 1, 2019), ("February", 2, 2020), ("January", 1, 2019), ("January", 2, 2020)]
    finally:
        q.stop()


ODS = """<office:document-content xmlns:office="o" xmlns:table="t" xmlns:text="x"><office:body><office:spreadsheet><table:table table:name="S">
<table:table-row><table:table-cell office:value-type="string"><text:p>date</text:p></table:table-cell><table:table-cell office:value-type="string"><text:p>time</text:p></table:table-cell>
<table:table-cell office:value-type="string"><text:p>n</text:p></table:table-cell></table:table-row>
<table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="date" office:date-value="2023-06-01"/><table:table-cell office:value-type="time" office:time-value="PT01H02M03S"/>
<table:table-cell office:value-type="float" office:value="1.5"/></table:table-row>
<table:table-row table:number-rows-repeated="1048573"><table:table-cell table:number-columns-repeated="1024"/></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>"""


def test_ods(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", ODS)
    book = read_workbook(out.getvalue(), spark)
    got = book.load_sheet("S").to_arrow()
    assert got.to_pydict() == {"date": [dt.date(2023, 6, 1)] * 2, "time": [dt.timedelta(hours=1, minutes=2, seconds=3)] * 2, "n": [1.5, 1.5]}
    with pytest.raises(InternalError):
        book.table_names()


def xls(records):
    """A compound file whose only stream holds the records."""
    stream = b"".join(struct.pack("<HH", k, len(b)) + b for k, b in records)
    stream += b"\0" * (max(4096, len(stream)) - len(stream))
    n = -(-len(stream) // 512)
    stream = stream.ljust(n * 512, b"\0")
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [i + 3 for i in range(n - 1)] + [0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\0" * 48 + struct.pack("<IQ", start, size)
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream)) + b"\0" * 256
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat) + directory + stream


def test_xls(spark):
    bof = lambda kind: (0x809, struct.pack("<HH", 0x600, kind) + b"\0" * 12)
    string = lambda s: struct.pack("<HB", len(s), 0) + s.encode("latin-1")
    sst = (0xFC, struct.pack("<II", 3, 3) + string("na\0me") + string("n") + string("Zoé"))
    head = [bof(5), (0xE0, struct.pack("<HH", 0, 0) + b"\0" * 16), (0xE0, struct.pack("<HH", 0, 14) + b"\0" * 16), sst]
    size = sum(4 + len(b) for _, b in head) + 4 + 9 + 4
    sheet = [
        bof(16), (0xFD, struct.pack("<HHHI", 0, 0, 0, 0)), (0xFD, struct.pack("<HHHI", 0, 1, 0, 1)), (0xFD, struct.pack("<HHHI", 1, 0, 0, 2)),
        (0x203, struct.pack("<HHHd", 1, 1, 1, 45128.0)), (0x205, struct.pack("<HHHBB", 2, 0, 0, 1, 0)), (0x27E, struct.pack("<HHHI", 2, 1, 1, (45129 << 2) | 2)), (0x0A, b""),
    ]
    content = xls([*head, (0x85, struct.pack("<IBBBB", size, 0, 0, 1, 0) + b"S"), (0x0A, b""), *sheet])
    got = read_workbook(content, spark).load_sheet("S", dtypes={"name": "string"}).to_arrow()
    assert got.to_pydict() == {"name": ["Zoé", "true"], "n": [dt.datetime(2023, 7, 21), dt.datetime(2023, 7, 22)]}


def xlsb() -> bytes:
    """A binary workbook record by record: a visible and a hidden sheet, shared and own strings, a date style."""

    def record(kind, body=b""):
        head = bytes([kind]) if kind < 0x80 else bytes([kind & 0x7F | 0x80, kind >> 7])
        size, n = b"", len(body)
        while True:
            size += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
            n >>= 7
            if not n:
                return head + size + body

    text = lambda s: struct.pack("<I", len(s.encode("utf-16-le")) // 2) + s.encode("utf-16-le")
    cell = lambda kind, col, body, style=0: record(kind, struct.pack("<II", col, style) + body)
    row = lambda n, *cells: record(0, struct.pack("<I", n) + b"\0" * 13) + b"".join(cells)
    sheet = record(145) + row(2, cell(7, 1, struct.pack("<I", 0)), cell(6, 2, text("n" * 70)), cell(8, 3, text("day") + b"\0\0"), cell(62, 4, b"\0" + text("ok")))
    sheet += row(3, cell(5, 1, struct.pack("<d", 1.5)), cell(2, 2, struct.pack("<I", 7 << 2 | 2)), cell(9, 3, struct.pack("<d", 45128.5), 1), cell(4, 4, b"\1"))
    sheet += row(5, cell(1, 1, b""), cell(3, 2, bytes([42])), cell(2, 3, struct.pack("<I", 45129 << 2 | 2), 1), cell(10, 4, b"\0"), cell(11, 1, bytes([7]))) + record(146)
    names = record(39, struct.pack("<IBI", 0, 0, 0xFFFFFFFF) + text("Total") + b"\0" * 8)
    bundle = lambda state, rid, name: record(156, struct.pack("<II", state, 1) + text(rid) + text(name))
    parts = {
        "xl/workbook.bin": record(153, struct.pack("<II", 0, 0)) + bundle(0, "r1", "S") + bundle(2, "r2", "Blätter") + names,
        "xl/worksheets/sheet1.bin": sheet,
        "xl/worksheets/sheet2.bin": record(145) + record(146),
        "xl/sharedStrings.bin": record(159, struct.pack("<II", 1, 1)) + record(19, b"\0" + text("prix €")),
        "xl/styles.bin": record(44, struct.pack("<H", 170) + text("yyyy-mm-dd")) + record(47, struct.pack("<HH", 0, 170)) + record(617) + record(47, struct.pack("<HH", 0, 0)) + record(47, struct.pack("<HH", 0, 170)) + record(618),
    }
    kinds = {"r1": ("worksheet", "worksheets/sheet1.bin"), "r2": ("worksheet", "/xl/worksheets/sheet2.bin"), "r3": ("sharedStrings", "sharedStrings.bin"), "r4": ("styles", "styles.bin")}
    links = "".join(f'<Relationship Id="{k}" Type="x/{t}" Target="{path}"/>' for k, (t, path) in kinds.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
        z.writestr("xl/_rels/workbook.bin.rels", f"<Relationships>{links}</Relationships>")
    return out.getvalue()


def test_xlsb(spark):
    book = read_workbook(xlsb(), spark)
    assert [(s.name, s.visible) for s in book._metadata.sheets] == [("S", "visible"), ("Blätter", "veryhidden")]
    assert [n.name for n in book.defined_names()] == ["Total"]
    sheet = book.load_sheet("S")
    assert (sheet.width, sheet.total_height) == (4, 3)
    got = sheet.to_arrow().to_pydict()
    assert got["prix €"] == [1.5, None, None] and got["n" * 70] == [7.0, None, None] and got["ok"] == [True, None, False]
    assert got["day"] == [dt.datetime(2023, 7, 21, 12), None, dt.datetime(2023, 7, 22)]
    assert book.load_sheet("Blätter").to_arrow().num_rows == 0
    with pytest.raises(InternalError):
        book.table_names()


@pytest.mark.parametrize(("raw", "value"), [((5 << 2) | 2, 5.0), ((-7 << 2 | 2) & 0xFFFFFFFF, -7.0), ((1234 << 2) | 3, 12.34), (0x3FF00000, 1.0)])
def test_rk(raw, value):
    assert rk_number(raw) == value


@pytest.mark.parametrize(("code", "kind"), [("General", 2), ("0.00", 2), ("yyyy-mm-dd", 5), ('"day" 0', 2), ("[h]:mm:ss", 6), ("[Red]0.0", 2), ("0.00E+00", 2), ("h:mm", 5), ("mmm\\-yy", 5)])
def test_format_kind(code, kind):
    assert format_kind(code) == kind
