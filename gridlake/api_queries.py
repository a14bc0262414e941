"""Queries over the workbook API: ways in and out, accessors, argument parsing and errors, each with the SQL that must give the same rows."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import grid_of, make_cell
from .errors import WorkbookError
from .functions import coerce as C
from .functions.vectors import TypedColumn, to_table
from .operators.columns import letter_positions
from .operators.infer import BITS, cell_dtype, lattice
from .plans.options import Coercion, Dtype, DtypeFrom, LoadOptions, NameFrom, parse_dtypes, parse_idx_or_name, parse_skip_rows
from .plans.plan import LoadPlan
from .queries import _nation_workbook, _sheet, _t, query
from .reader import WorkbookHandle, read_workbook
from .session import shared_dir
from .sources.datasource import register
from .sources.formats import open_workbook
from .sources.xlsx_writer import ErrorCell, Serial, SheetSpec, write_xlsx


def _values(rows: list[tuple]) -> str:
    """SQL for literal rows of texts and numbers."""
    shown = lambda v: "NULL::VARCHAR" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


def _book(spark: SparkSession, sf_dir: str) -> WorkbookHandle:
    return read_workbook(_nation_workbook(spark, sf_dir), spark)


def _at_path(spark: SparkSession, content: bytes, name: str = "book.xlsx") -> str:
    """A workbook's path in the shared folder, written through Hadoop's file systems."""
    path = f"{shared_dir(spark)}/gridlake/{uuid.uuid4().hex}/{name}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(there)
    out.write(bytearray(content))
    out.close()
    return path


def _outcome(f: Callable[[], object]) -> str:
    """What a call gives, or the kind and first line of its error."""
    try:
        return str(f())
    except WorkbookError as e:
        return f"{type(e).__name__}: {str(e).splitlines()[0]}"


def _cases(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    return spark.createDataFrame([(k, _outcome(f)) for k, f in cases.items()], "of string, outcome string")


def _told(**cases: str) -> str:
    return f"SELECT * FROM (VALUES {_values(list(cases.items()))}) t(of, outcome)"


_NATION = "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation"
_REGION = "SELECT r_regionkey::DOUBLE AS r_regionkey, r_name FROM region"


def _mixed_workbook() -> bytes:
    rows = [("flag", "n", "x", "text", "at", "span", "none"), (True, 3, 1.5, "a", Serial(44622.5), Serial(0.25, elapsed=True), None), (False, "x", 2.0, " ", None, None, None)]
    return write_xlsx([SheetSpec("typed", rows), SheetSpec("void", []), SheetSpec("bad", [("v",), (ErrorCell("#NAME?"),)])])


# Ways in


@query(_NATION)
def open_path(spark, sf_dir):
    return read_workbook(_at_path(spark, _nation_workbook(spark, sf_dir)), spark).load_sheet("nation").to_spark()


@query(_told(bytes="nation", nothing="InvalidParametersError: source must be a string or bytes", number="InvalidParametersError: source must be a string or bytes", path="nation", text="nation"))
def source_dispatch(spark, sf_dir):
    content = _nation_workbook(spark, sf_dir)
    path = _at_path(spark, content)
    local = path.removeprefix("file://")
    first = lambda source: read_workbook(source, spark).sheet_names[0]
    return _cases(
        spark,
        {"text": lambda: first(path), "path": lambda: first(Path(local) if local.startswith("/") else path), "bytes": lambda: first(content), "number": lambda: first(3), "nothing": lambda: first(None)},
    )


@query(f"SELECT 'eager' AS way, * FROM ({_NATION}) UNION ALL SELECT 'kept', * FROM ({_NATION})")
def load_eager(spark, sf_dir):
    book = _book(spark, sf_dir)
    kept = book.load_sheet("nation", eager=True)
    eager = spark.createDataFrame(book.load_sheet_eager("nation"))
    return eager.select(F.lit("eager").alias("way"), "*").unionByName(spark.createDataFrame(kept.to_arrow()).select(F.lit("kept").alias("way"), "*"))


@query(f"SELECT 'idx' AS way, * FROM ({_NATION}) UNION ALL SELECT 'name', * FROM ({_NATION})")
def load_by_name_and_idx(spark, sf_dir):
    book = _book(spark, sf_dir)
    ways = {"name": book.load_sheet_by_name("nation"), "idx": book.load_sheet_by_idx(0)}
    name, idx = (s.to_spark().select(F.lit(w).alias("way"), "*") for w, s in ways.items())
    return name.unionByName(idx)


@query("SELECT (SELECT count(*) FROM nation) AS lazy, (SELECT count(*) FROM nation) AS kept, true AS equal")
def scan_kept_and_lazy(spark, sf_dir):
    """Rows that stay in Spark's cache are those that each action would parse again."""
    book = _book(spark, sf_dir)
    lazy, kept = book.load_sheet(0), book.load_sheet(0).keep()
    a, b = lazy.to_arrow(), kept.to_arrow()
    kept.release()
    return spark.createDataFrame([(a.num_rows, b.num_rows, a.equals(b))], "lazy long, kept long, equal boolean")


@query("SELECT 'nation' AS sheet, count(*) + 1 AS n_rows FROM nation UNION ALL SELECT 'shifted', count(*) + 5 FROM nation UNION ALL SELECT 'region', count(*) + 2 FROM region")
def format_workbook(spark, sf_dir):
    register(spark)
    path = _at_path(spark, _nation_workbook(spark, sf_dir))
    return spark.read.format("workbook").load(path).groupBy("sheet").agg(F.count("*").alias("n_rows"))


@query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) WHERE i BETWEEN 11 AND 60")
def pushed_down_rows(spark, sf_dir):
    """Rows and columns that are not asked for never leave the parser."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderkey").limit(2000).collect()
    content = write_xlsx([SheetSpec("orders", [("o_orderkey", "o_orderstatus", "o_totalprice"), *map(tuple, rows)])])
    return read_workbook(content, spark).load_sheet(0, use_columns=["o_orderkey", "o_totalprice"], skip_rows=10, n_rows=50).to_spark()


def _ods() -> bytes:
    cell = lambda kind, value, shown="": f'<t:table-cell o:value-type="{kind}" {value}><x:p>{shown}</x:p></t:table-cell>'
    rows = [
        [cell("string", "", h) for h in ("n", "day", "span", "ok", "text")],
        [cell("float", 'o:value="1.5"'), cell("date", 'o:date-value="2023-06-01"'), cell("time", 'o:time-value="PT01H02M03S"'), cell("boolean", 'o:boolean-value="true"'), cell("string", "", "a &amp; b")],
    ]
    body = "".join(f"<t:table-row>{''.join(r)}</t:table-row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(
            "content.xml",
            f'<o:document-content xmlns:o="o" xmlns:t="t" xmlns:x="x"><o:body><o:spreadsheet><t:table t:name="S">{body}</t:table></o:spreadsheet></o:body></o:document-content>',
        )
    return out.getvalue()


@query("SELECT 1.5::DOUBLE AS n, '2023-06-01' AS day, 3723000::BIGINT AS span_ms, true AS ok, 'a & b' AS text")
def scan_ods(spark, sf_dir):
    sheet = read_workbook(_ods(), spark).load_sheet("S")
    df = sheet.to_spark()
    return df.select("n", F.col("day").cast("string").alias("day"), (F.col("span").cast("interval second").cast("decimal(20,3)") * 1000).cast("long").alias("span_ms"), "ok", "text")


# Ways out


@query(_NATION)
def sink_arrow_sheet(spark, sf_dir):
    return spark.createDataFrame(_book(spark, sf_dir).load_sheet("nation").to_arrow())


@query(_REGION)
def sink_arrow_table(spark, sf_dir):
    return spark.createDataFrame(_book(spark, sf_dir).load_table("regions").to_arrow())


@query(_NATION)
def sink_pandas(spark, sf_dir):
    return spark.createDataFrame(_book(spark, sf_dir).load_sheet("nation").to_pandas())


@query(_NATION)
def sink_polars(spark, sf_dir):
    """Through polars, or, where it is not installed, the Arrow data that it would be handed."""
    sheet = _book(spark, sf_dir).load_sheet("nation")
    try:
        return spark.createDataFrame(sheet.to_polars().to_arrow())
    except ImportError:
        return spark.createDataFrame(pa.Table.from_batches([pa.record_batch(sheet)]))


@query(f"SELECT * FROM (VALUES {_values([('r_regionkey', 'double'), ('r_name', 'string')])}) t(name, type)")
def sink_arrow_c_schema(spark, sf_dir):
    table = _book(spark, sf_dir).load_table("regions")
    return spark.createDataFrame([(f.name, str(f.type)) for f in pa.schema(table)], "name string, type string")


@query(_REGION)
def sink_arrow_c_array(spark, sf_dir):
    return spark.createDataFrame(pa.Table.from_batches([pa.record_batch(_book(spark, sf_dir).load_table("regions"))]))


@query("SELECT 0::BIGINT AS n_rows, 0::BIGINT AS n_columns, 0::BIGINT AS height, 0::BIGINT AS width")
def sink_empty(spark, sf_dir):
    sheet = read_workbook(_mixed_workbook(), spark).load_sheet("void")
    got = sheet.to_arrow()
    return spark.createDataFrame([(got.num_rows, got.num_columns, sheet.height, sheet.width)], "n_rows long, n_columns long, height long, width long")


@query("SELECT n_nationkey::DOUBLE AS n_nationkey, 'Expected float but got ''String(\"' || n_name || '\")''' AS detail, true AS is_null FROM nation")
def sink_arrow_with_errors(spark, sf_dir):
    table, errors = _book(spark, sf_dir).load_sheet("nation", dtypes={"n_name": "float"}).to_arrow_with_errors()
    keys, names = table.column("n_nationkey").to_pylist(), table.column("n_name").to_pylist()
    return spark.createDataFrame([(keys[e.offset_position[0]], e.detail, names[e.offset_position[0]] is None) for e in errors.errors], "n_nationkey double, detail string, is_null boolean")


@query(f"SELECT * FROM (VALUES {_values([('flag', 'boolean', 2, 'True'), ('n', 'string', 2, '3'), ('x', 'float', 2, '1.5'), ('text', 'string', 2, 'a'), ('at', 'datetime', 2, '2022-03-02 12:00:00'), ('span', 'duration', 2, '6:00:00'), ('none', 'string', 2, 'None')])}) t(name, dtype, n, first)")
def typed_vectors(spark, sf_dir):
    found = read_workbook(_mixed_workbook(), spark).load_sheet("typed").to_columns()
    return spark.createDataFrame([(c.name, c.dtype.value, len(c), str(c.into(c.dtype)[0])) for c in found], "name string, dtype string, n int, first string")


@query(
    _told(
        into_other='InvalidColumnError: column "a" is int and not string',
        into_own="[1, None]",
        lengths="InvalidColumnError: columns differ in length: [1, 2]",
        nulls="[None, None, None]",
        nulls_without_length='InvalidColumnError: column "a" of nulls needs a length',
        side_by_side="[{'a': 1, 'b': 'x'}]",
        wrong_length='InvalidColumnError: column "a" has 1 values and not 2',
    )
)
def typed_constructors(spark, sf_dir):
    two = TypedColumn("a", "int", [1, None])
    return _cases(
        spark,
        {
            "into_own": lambda: two.into("int"),
            "into_other": lambda: two.into("string"),
            "nulls": lambda: TypedColumn("a", "null", length=3).into("null"),
            "nulls_without_length": lambda: TypedColumn("a", "null"),
            "lengths": lambda: to_table([two, TypedColumn("b", "string", ["x"])]),
            "wrong_length": lambda: TypedColumn("a", "int", [1], 2),
            "side_by_side": lambda: to_table([TypedColumn("a", "int", [1]), TypedColumn("b", "string", ["x"])]).to_pylist(),
        },
    )


# Columns


@query(
    _told(
        **{
            ":": "InvalidParametersError: a column range cannot have both ends open: ':'",
            "A:A": "InvalidParametersError: empty range: 'A:A'",
            "A:B:E": "InvalidParametersError: a column range must have exactly 2 elements, got 3: 'A:B:E'",
            "B:A": "InvalidParametersError: end of range is before start: 'B:A'",
            "": "InvalidParametersError: a column cannot be empty",
            "a, b": "InvalidParametersError: a column must be made of letters, got ' B'",
            "D,A:B": "[0, 1, 3]",
            "D:,A": "[3, 4, 5, 0]",
        }
    )
)
def letter_ranges(spark, sf_dir):
    return _cases(spark, {x: lambda x=x: letter_positions(x, 5) for x in (":", "A:A", "A:B:E", "B:A", "", "a, b", "D,A:B", "D:,A")})


def _names(spark: SparkSession, sf_dir: str, **options) -> Callable[[], object]:
    return lambda: [c.name for c in _book(spark, sf_dir).load_sheet("nation", **options).selected_columns]


@query(
    _told(
        callable="['n_name']",
        empty="InvalidParametersError: list of selected columns is empty",
        indices="['n_regionkey', 'n_nationkey']",
        letters="['n_nationkey', 'n_regionkey']",
        mixed="['n_name', 'n_nationkey']",
        negative="InvalidParametersError: expected a column name or index, got -1",
        no_bool="InvalidParametersError: use_columns callable must return a bool, got 1",
        number="InvalidParametersError: use_columns must be a string, a list or a callable, got 3",
        unknown_index="ColumnNotFoundError: column at index 9 not found",
        unknown_name='ColumnNotFoundError: column with name "nope" not found',
    )
)
def selection_dispatch(spark, sf_dir):
    n = lambda x: _names(spark, sf_dir, use_columns=x)
    return _cases(
        spark,
        {
            "letters": n("A,C"), "indices": n([2, 0]), "mixed": n(["n_name", 0]), "callable": n(lambda c: c.name == "n_name"), "empty": n([]), "number": n(3), "negative": n([-1]),
            "no_bool": n(lambda c: 1), "unknown_name": n(["nope"]), "unknown_index": n([9]),
        },
    )


@query("SELECT 'Context:' AS line, 1 AS at UNION ALL SELECT '    0: available columns are: [''n_nationkey'', ''n_name'', ''n_regionkey'']', 2")
def column_not_found(spark, sf_dir):
    try:
        _names(spark, sf_dir, use_columns=["nope"])()
        lines = []
    except WorkbookError as e:
        lines = str(e).splitlines()[1:]
    return spark.createDataFrame([(x, i) for i, x in enumerate(lines, 1)], "line string, at int")


@query("SELECT 1::BIGINT AS ab, 'x' AS \"__UNNAMED__1\"")
def header_nul(spark, sf_dir):
    grid = grid_of(spark.range(1).withColumnRenamed("id", "_row"), F.col("_row"), [make_cell(C.INT, i=F.lit(1)), make_cell(C.STRING, s=F.lit("x"))], ["a\0b", "\0"])
    return LoadPlan.build(grid, LoadOptions.for_sheet()).dataframe()


@query(
    "SELECT 'sheet' AS of, 'nation' AS name, 3 AS width, 2 AS selected, (count(*) - 3)::INT AS height, count(*)::INT AS total_height, 4 AS data_offset, (count(*) + 1)::INT AS data_limit, '{0: ''int''}' AS dtypes FROM nation "
    "UNION ALL SELECT 'table', 'regions', 2, 2, 2, count(*)::INT, 0, 2, 'string' FROM region"
)
def accessors(spark, sf_dir):
    book = _book(spark, sf_dir)
    sheet = book.load_sheet("nation", skip_rows=3, use_columns="A:B", dtypes={0: "int"})
    table = book.load_table("regions", n_rows=2, dtypes="string")
    rows = [(k, x.name, x.width, len(x.selected_columns), x.height, x.total_height, x.offset, x.limit, str(x.specified_dtypes)) for k, x in (("sheet", sheet), ("table", table))]
    return spark.createDataFrame(rows, "of string, name string, width int, selected int, height int, total_height int, data_offset int, data_limit int, dtypes string")


@query(f"SELECT * FROM (VALUES {_values([('all', 25, 25), ('callable', 12, 25), ('capped', 7, 25), ('listed', 23, 25), ('skipped', 20, 25)])}) t(of, height, total)")
def heights(spark, sf_dir):
    book = _book(spark, sf_dir)
    how = {"all": {}, "skipped": {"skip_rows": 5}, "capped": {"n_rows": 7}, "listed": {"skip_rows": [0, 3, 99]}, "callable": {"skip_rows": lambda i: i % 2 == 0}}
    loaded = {k: book.load_sheet("nation", **o) for k, o in how.items()}
    assert all(x.to_spark().count() == x.height for x in loaded.values())
    return spark.createDataFrame([(k, x.height, x.total_height) for k, x in loaded.items()], "of string, height int, total int")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'void' AS type, true AS is_null FROM nation")
def null_column(spark, sf_dir):
    nation = _sheet(spark, sf_dir, "nation", "n_nationkey")
    plan = LoadPlan.build(nation, LoadOptions.for_sheet(use_columns=["n_nationkey", "n_name"], dtypes={"n_name": "null"}))
    df = plan.dataframe()
    return df.select("n_nationkey", F.lit(dict(df.dtypes)["n_name"]).alias("type"), F.col("n_name").isNull().alias("is_null"))


@query("SELECT * FROM (VALUES (2, 1, 1, 1, 'CellError(position=(2, 1), offset_position=(1, 1), row_offset=1, detail=\"Expected int but got ''String(\\\"x\\\")''\")')) t(\"row\", col, offset_row, offset_col, shown)".replace('\\"', '"'))
def cell_error_accessors(spark, sf_dir):
    _, errors = read_workbook(_mixed_workbook(), spark).load_sheet("typed", use_columns=["n"], dtypes={"n": "int"}).to_arrow_with_errors()
    shown = lambda e: repr(e).replace("'Expected int but got \\'String(\"x\")\\''", '"Expected int but got \'String("x")\'"')
    return spark.createDataFrame([(*e.position, *e.offset_position, shown(e)) for e in errors.errors], "row int, col int, offset_row int, offset_col int, shown string")


@query(f"SELECT * FROM (VALUES {_values([('defined name', 'DefinedName<name=\"Total\", formula=\"SUM(nation...\">'), ('reader', 'WorkbookHandle<bytes>'), ('sheet', 'Sheet<nation>'), ('table', 'Table<regions>')])}) t(of, shown)")
def representations(spark, sf_dir):
    book = _book(spark, sf_dir)
    of = {"reader": book, "sheet": book.load_sheet(0), "table": book.load_table("regions"), "defined name": book.defined_names()[0]}
    return spark.createDataFrame([(k, repr(v)) for k, v in of.items()], "of string, shown string")


# Options


@query(
    _told(
        sheet="header 0, sample 1000, coerce",
        table="header None, sample 1000, coerce",
        all_given="header 2, sample 5, strict",
        zero_sample="InvalidParametersError: schema_sample_rows cannot be 0, as it would prevent dtype inferring",
    )
)
def options(spark, sf_dir):
    shown = lambda o: f"header {o.header_row}, sample {o.schema_sample_rows}, {o.coercion.value}"
    every = {"header_row": 2, "schema_sample_rows": 5, "dtype_coercion": "strict", "n_rows": 3, "skip_rows": [1], "use_columns": "A", "dtypes": "int", "column_names": None, "skip_whitespace_tail_rows": True, "whitespace_as_null": True}
    return _cases(
        spark,
        {
            "sheet": lambda: shown(LoadOptions.for_sheet()),
            "table": lambda: shown(LoadOptions.for_table()),
            "all_given": lambda: shown(LoadOptions.for_sheet(**every)),
            "zero_sample": lambda: LoadOptions.for_sheet(schema_sample_rows=0),
        },
    )


@query(
    _told(
        bad_key="InvalidParametersError: dtypes must be keyed by column name or index, got 1.5",
        bad_kind="InvalidParametersError: unsupported object type for dtypes: 3",
        bad_name='InvalidParametersError: unsupported dtype: "number"',
        coerce="coerce", strict="strict",
        coercion_unknown='InvalidParametersError: unsupported dtype_coercion: "maybe"',
        mapping="{'a': 'int', 2: 'date'}", one="float", nothing="None",
    )
)
def dtype_arguments(spark, sf_dir):
    plain = lambda d: {k: v.value for k, v in d.items()} if isinstance(d, dict) else d.value if d else d
    d = lambda x: lambda: plain(parse_dtypes(x))
    return _cases(
        spark,
        {
            "one": d("float"), "mapping": d({"a": "int", 2: "date"}), "nothing": d(None), "bad_name": d("number"), "bad_key": d({1.5: "int"}), "bad_kind": d(3),
            "coerce": lambda: Coercion.parse("coerce").value, "strict": lambda: Coercion.parse("strict").value, "coercion_unknown": lambda: Coercion.parse("maybe"),
        },
    )


def _raises(row: int) -> bool:
    raise ValueError("no")


@query(
    _told(
        boolean="InvalidParametersError: skip_rows must be a non-negative int, a list of them or a callable, got True",
        callable="callable", listed="[1, 3]", negative="InvalidParametersError: skip_rows must be a non-negative int, a list of them or a callable, got -1",
        nothing="None", number="4", text="InvalidParametersError: skip_rows must be a non-negative int, a list of them or a callable, got 'x'",
        raises="InvalidParametersError: skip_rows callable failed on row 0: no",
        returns_no_bool="InvalidParametersError: skip_rows callable must return a bool, got None",
    )
)
def skip_arguments(spark, sf_dir):
    shown = lambda x: sorted(x) if isinstance(x, frozenset) else "callable" if callable(x) else x
    s = lambda x: lambda: shown(parse_skip_rows(x))
    cases = {"nothing": None, "number": 4, "listed": [3, 1, 3], "callable": lambda i: True, "negative": -1, "boolean": True, "text": "x"}
    load = lambda f: lambda: _book(spark, sf_dir).load_sheet(0, skip_rows=f).height
    return _cases(spark, {k: s(v) for k, v in cases.items()} | {"raises": load(_raises), "returns_no_bool": load(lambda i: None)})


@query(_told(boolean="InvalidParametersError: expected a name or a non-negative index, got True", index="2", name="nation", negative="InvalidParametersError: expected a name or a non-negative index, got -1"))
def index_or_name(spark, sf_dir):
    return _cases(spark, {k: lambda v=v: parse_idx_or_name(v) for k, v in {"index": 2, "name": "nation", "negative": -1, "boolean": True}.items()})


@query(f"SELECT * FROM (VALUES {_values([('name', 'generated'), ('name', 'looked_up'), ('name', 'provided'), ('dtype', 'guessed'), ('dtype', 'provided_by_index'), ('dtype', 'provided_by_name'), ('dtype', 'provided_for_all')])}) t(of, provenance)")
def provenance(spark, sf_dir):
    """Each way that a column can get its name and its dtype, read off loaded sheets."""
    book = _book(spark, sf_dir)
    loads = [{}, {"column_names": ["a"], "dtypes": "string"}, {"dtypes": {"n_name": "string", 0: "int"}}]
    found = [c for o in loads for c in book.load_sheet(0, **o).selected_columns]
    rows = {("name", NameFrom(c.column_name_from).value) for c in found} | {("dtype", DtypeFrom(c.dtype_from).value) for c in found}
    return spark.createDataFrame(sorted(rows), "of string, provenance string")


# Errors


@query(
    _told(
        arrow="ArrowError",
        base="WorkbookError",
        cannot_retrieve="CannotRetrieveCellDataError: could not retrieve data at (7,0)",
        cell="WorkbookCellError: column 0 holds an error cell",
        column="ColumnNotFoundError: column at index 9 not found",
        format="WorkbookFormatError: cannot open workbook",
        internal="InternalError: tables are only supported for XLSX workbooks",
        invalid_column='InvalidColumnError: column "a" of nulls needs a length',
        parameters="InvalidParametersError: Too many rows skipped. Max height is 26",
        sheet='SheetNotFoundError: sheet with name "nope" not found',
        table='InvalidParametersError: table "nope" not found',
        types="UnsupportedColumnTypeCombinationError: type coercion is strict and column contains ['float', 'string']",
    )
)
def errors(spark, sf_dir):
    from . import errors as E

    book, mixed = _book(spark, sf_dir), read_workbook(_mixed_workbook(), spark)
    grid = spark.range(2).select(F.col("id").alias("_row"), F.array(make_cell(C.INT, i=F.col("id"))).alias("cells"))
    cases = {
        "types": lambda: lattice(BITS[Dtype.FLOAT] | BITS[Dtype.STRING], 2, Coercion.STRICT),
        "cannot_retrieve": lambda: cell_dtype(grid, 7, 0),
        "cell": lambda: mixed.load_sheet("bad"),
        "format": lambda: open_workbook(b"not a workbook"),
        "sheet": lambda: book.load_sheet("nope"),
        "table": lambda: book.load_table("nope"),
        "column": lambda: book.load_sheet(0, use_columns=[9]),
        "parameters": lambda: book.load_sheet(0, skip_rows=99),
        "internal": lambda: read_workbook(_ods(), spark).table_names(),
        "invalid_column": lambda: TypedColumn("a", "null"),
        "arrow": lambda: E.ArrowError.__name__ if issubclass(E.ArrowError, E.WorkbookError) else "",
        "base": lambda: E.WorkbookError.__name__ if all(issubclass(getattr(E, n), E.WorkbookError) for n in dir(E) if n.endswith("Error")) else "",
    }
    short = F.when(F.col("of") == "format", F.substring_index("outcome", ":", 2)).otherwise(F.col("outcome"))
    return _cases(spark, cases).select("of", short.alias("outcome"))


@query(_told(empty="None", number="int", outside="CannotRetrieveCellDataError: could not retrieve data at (0,5)", error="WorkbookCellError: the cell at (1,0) holds an error"))
def cell_dtypes(spark, sf_dir):
    first = F.when(F.col("id") == 0, make_cell(C.INT, i=F.lit(1))).otherwise(make_cell(C.ERROR, s=F.lit("#NAME?")))
    grid = spark.range(2).select(F.col("id").alias("_row"), F.array(first, make_cell(C.EMPTY)).alias("cells"))
    at = lambda r, c: lambda: (d := cell_dtype(grid, r, c)) and d.value
    return _cases(spark, {"number": at(0, 0), "empty": at(0, 1), "outside": at(0, 5), "error": at(1, 0)})
