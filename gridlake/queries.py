"""Queries over the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import TableGrid, empty_cell, grid_from_table, grid_of, make_cell, numbered
from .errors import WorkbookError
from .functions import coerce as C
from .operators.columns import letter_index
from .operators.infer import BITS, cell_bit, lattice, masks
from .operators.rows import extent, last_filled
from .plans.options import Coercion, Dtype, LoadOptions
from .plans.plan import Grid, LoadPlan
from .reader import read_workbook
from .session import ship_package
from .sources.scan import binary, scan_all, scan_metadata
from .sources.xlsx_writer import SheetSpec, write_xlsx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sheet(spark: SparkSession, sf_dir: str, name: str, *keys: str, header: bool = True) -> TableGrid:
    return TableGrid(_t(spark, sf_dir, name), *keys, header=header)


def _load(grid: DataFrame | Grid, start_col: int = 0, **options) -> DataFrame:
    return LoadPlan.build(grid, LoadOptions.for_sheet(**options), start_col).dataframe()


# Scans


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def scan_all_columns(spark, sf_dir):
    return _load(_sheet(spark, sf_dir, "nation", "n_nationkey"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_shipdate FROM lineitem")
def scan_lineitem(spark, sf_dir):
    table = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    return _load(TableGrid(table, "l_orderkey", "l_linenumber"))


def _nation_workbook(spark: SparkSession, sf_dir: str) -> bytes:
    rows = _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    regions = _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    header = [("n_nationkey", "n_name", "n_regionkey")]
    region = [("r_regionkey", "r_name"), *map(tuple, regions)]
    return write_xlsx(
        [
            SheetSpec("nation", header + [tuple(r) for r in rows]),
            SheetSpec("shifted", header + [tuple(r) for r in rows], at=(4, 3), state="hidden"),
            SheetSpec("region", region, at=(1, 1), state="veryhidden", tables=[("regions", f"B2:C{len(region) + 1}", ["r_regionkey", "r_name"])]),
        ],
        [("Total", "SUM(nation!$A$2:$A$26)"), ("Constant", "3.4")],
    )


@query("SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation")
def scan_xlsx_roundtrip(spark, sf_dir):
    return read_workbook(_nation_workbook(spark, sf_dir), spark).load_sheet("nation").to_spark()


@query("SELECT n_nationkey::DOUBLE AS n_nationkey, n_regionkey::DOUBLE AS n_regionkey FROM nation")
def scan_xlsx_shifted(spark, sf_dir):
    return read_workbook(_nation_workbook(spark, sf_dir), spark).load_sheet(1, use_columns="D,F").to_spark()


@query("SELECT 'nation' AS sheet, count(*) AS n_rows FROM nation UNION ALL SELECT 'shifted', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def scan_all_sheets(spark, sf_dir):
    grid = scan_all(binary(spark, _nation_workbook(spark, sf_dir)))
    some = grid.filter(F.exists("cells", lambda c: c["k"] == C.FLOAT))
    return some.groupBy("sheet").agg(F.count("*").alias("n_rows"))


@query("SELECT * FROM (VALUES (0, 'nation', 'visible'), (1, 'shifted', 'hidden'), (2, 'region', 'veryhidden')) t(sheet_idx, name, visible)")
def sheet_meta(spark, sf_dir):
    return scan_metadata(binary(spark, _nation_workbook(spark, sf_dir))).select("sheet_idx", "name", "visible")


@query("SELECT 'regions' AS name, 'region' AS sheet, 'r_regionkey,r_name' AS columns, count(*)::INT AS n_rows FROM region")
def table_meta(spark, sf_dir):
    found = read_workbook(_nation_workbook(spark, sf_dir), spark).tables_dataframe()
    return found.withColumn("columns", F.array_join("columns", ","))


@query("SELECT * FROM (VALUES ('Total', 'SUM(nation!$A$2:$A$26)'), ('Constant', '3.4')) t(name, formula)")
def defined_names(spark, sf_dir):
    return read_workbook(_nation_workbook(spark, sf_dir), spark).defined_names_dataframe()


@query("SELECT r_regionkey::DOUBLE AS r_regionkey, r_name FROM region")
def load_table(spark, sf_dir):
    return read_workbook(_nation_workbook(spark, sf_dir), spark).load_table("regions").to_spark()


@query("SELECT r_name, r_regionkey::DOUBLE AS r_regionkey FROM region")
def load_table_reordered(spark, sf_dir):
    return read_workbook(_nation_workbook(spark, sf_dir), spark).load_table("regions", use_columns=["r_name", "r_regionkey"]).to_spark()


# Column selection and names


def _customer(spark, sf_dir, **options):
    return _load(_sheet(spark, sf_dir, "customer", "c_custkey"), **options)


@query("SELECT c_mktsegment, c_custkey FROM customer")
def select_names_order(spark, sf_dir):
    return _customer(spark, sf_dir, use_columns=["c_mktsegment", "c_custkey", "c_mktsegment"])


@query("SELECT c_acctbal, c_custkey FROM customer")
def select_indices(spark, sf_dir):
    return _customer(spark, sf_dir, use_columns=[3, 0])


@query("SELECT c_acctbal, c_name FROM customer")
def select_mixed(spark, sf_dir):
    return _customer(spark, sf_dir, use_columns=[3, "c_name"])


@query("SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer")
def letters_closed(spark, sf_dir):
    return _customer(spark, sf_dir, use_columns="C:D,A")


@query("SELECT c_acctbal, c_mktsegment FROM customer")
def letters_open(spark, sf_dir):
    return _customer(spark, sf_dir, use_columns="d:")


@query("SELECT c_custkey, c_name FROM customer")
def letters_from_start(spark, sf_dir):
    return _customer(spark, sf_dir, use_columns=":B")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def letters_except(spark, sf_dir):
    return _customer(spark, sf_dir, use_columns=":B,D:")


@query("SELECT c_name, c_nationkey::BIGINT AS c_nationkey FROM customer")
def select_predicate(spark, sf_dir):
    return _customer(spark, sf_dir, use_columns=lambda c: c.name.startswith("c_n"))


@query("SELECT * FROM (VALUES ('A', 0), ('Z', 25), ('AA', 26), ('AB', 27), ('ZZ', 701), ('XFD', 16383)) t(letters, position)")
def letter_to_index(spark, sf_dir):
    return spark.createDataFrame([(x, letter_index(x)) for x in ("A", "Z", "AA", "AB", "ZZ", "XFD")], "letters string, position int")


@query("""SELECT 'r_regionkey' AS "__UNNAMED__0", 'r_name' AS "__UNNAMED__1" UNION ALL SELECT r_regionkey::VARCHAR, r_name FROM region""")
def header_none(spark, sf_dir):
    return _load(_sheet(spark, sf_dir, "region", "r_regionkey"), header_row=None)


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
def header_provided(spark, sf_dir):
    return _load(_sheet(spark, sf_dir, "region", "r_regionkey"), column_names=["key", "name"], skip_rows=1)


@query("""SELECT r_regionkey::BIGINT AS key, r_name AS "__UNNAMED__1" FROM region""")
def header_provided_short(spark, sf_dir):
    return _load(_sheet(spark, sf_dir, "region", "r_regionkey"), column_names=["key"], skip_rows=1)


@query("SELECT n_regionkey::BIGINT AS region, n_nationkey::BIGINT AS nation FROM nation")
def header_provided_subset(spark, sf_dir):
    return _load(_sheet(spark, sf_dir, "nation", "n_nationkey"), column_names=["region", "nation"], use_columns=[2, 0], skip_rows=1)


@query("SELECT n_nationkey::BIGINT AS col, n_name AS col_1, n_regionkey::BIGINT AS col_1_1 FROM nation")
def dup_alias(spark, sf_dir):
    table = numbered(_t(spark, sf_dir, "nation"), "n_nationkey")
    return _load(grid_of(table, F.col("_row"), header=["col", "col", "col_1"]))


@query("""SELECT n_nationkey::BIGINT AS key, n_name AS "__UNNAMED__1", n_regionkey::BIGINT AS "__UNNAMED__2" FROM nation""")
def header_blank(spark, sf_dir):
    table = numbered(_t(spark, sf_dir, "nation"), "n_nationkey")
    return _load(grid_of(table, F.col("_row"), header=["ke\0y", " ", ""]))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS n_regionkey FROM nation")
def absolute_indices(spark, sf_dir):
    return _load(_sheet(spark, sf_dir, "nation", "n_nationkey"), start_col=7, use_columns=[7, 9])


# Row windows. The numbered orders: rows in the order of their keys.

_ORDERS = "(SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)"


def _orders(spark, sf_dir, **options):
    table = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return _load(TableGrid(table, "o_orderkey"), **options)


@query(f"SELECT o_orderkey, o_orderstatus FROM {_ORDERS} WHERE i >= 700")
def skip_n(spark, sf_dir):
    return _orders(spark, sf_dir, skip_rows=700)


@query(f"SELECT o_orderkey, o_orderstatus FROM {_ORDERS} WHERE i NOT IN (0, 3, 500)")
def skip_list(spark, sf_dir):
    return _orders(spark, sf_dir, skip_rows=[0, 3, 500])


@query(f"SELECT o_orderkey, o_orderstatus FROM {_ORDERS} WHERE i % 3 <> 1")
def skip_callable(spark, sf_dir):
    return _orders(spark, sf_dir, skip_rows=lambda i: i % 3 == 1)


@query(f"SELECT o_orderkey, o_orderstatus FROM {_ORDERS} WHERE i < 321")
def n_rows(spark, sf_dir):
    return _orders(spark, sf_dir, n_rows=321)


@query(f"SELECT o_orderkey, o_orderstatus FROM {_ORDERS} WHERE i >= 50 AND i < 150")
def skip_and_n_rows(spark, sf_dir):
    return _orders(spark, sf_dir, skip_rows=50, n_rows=100)


@query(f"SELECT o_orderkey, o_orderstatus FROM {_ORDERS} WHERE i < 100 AND i NOT IN (2, 4)")
def skip_list_and_n_rows(spark, sf_dir):
    return _orders(spark, sf_dir, skip_rows=[2, 4, 200], n_rows=100)


def _blank_around(spark, sf_dir) -> DataFrame:
    """Three empty rows, a header, the regions, then rows of blank text."""
    regions = grid_from_table(_t(spark, sf_dir, "region"), "r_regionkey").withColumn("_row", F.col("_row") + 3)
    tail = spark.range(4).select((F.col("id") + 9).alias("_row"), F.array(make_cell(C.STRING, s=F.lit(" \t")), empty_cell()).alias("cells"))
    head = spark.range(3).select(F.col("id").alias("_row"), F.array(empty_cell(), empty_cell()).alias("cells"))
    return head.unionByName(regions).unionByName(tail)


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def tail_trim(spark, sf_dir):
    return _load(_blank_around(spark, sf_dir), skip_whitespace_tail_rows=True)


@query("SELECT 3::BIGINT AS first, 12::BIGINT AS last, 2 AS width, 8::BIGINT AS last_filled")
def grid_extent(spark, sf_dir):
    grid = _blank_around(spark, sf_dir)
    e = extent(grid)
    return spark.createDataFrame([(e.first, e.last, e.width, last_filled(grid))], "first long, last long, width int, last_filled long")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source FROM documents")
def whitespace_as_null(spark, sf_dir):
    docs = numbered(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    text = F.when(F.col("doc_id") % 5 == 0, F.lit(" \t ")).otherwise(F.col("source"))
    grid = grid_of(docs, F.col("_row"), [make_cell(C.INT, i=F.col("doc_id")), make_cell(C.STRING, s=text)], ["doc_id", "source"])
    return _load(grid, whitespace_as_null=True)


# A column of mixed cells over part, by p_partkey % 8


def _mixed(spark, sf_dir) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    m = F.col("p_partkey") % 8
    size, price = F.col("p_size"), F.col("p_retailprice")
    cell = (
        F.when(m == 0, make_cell(C.INT, i=size))
        .when(m == 1, make_cell(C.FLOAT, d=price))
        .when(m == 2, make_cell(C.STRING, s=F.col("p_name")))
        .when(m == 3, make_cell(C.STRING, s=size.cast("string")))
        .when(m == 4, make_cell(C.BOOL, i=(size % 2)))
        .when(m == 5, make_cell(C.SERIAL, d=size + 0.5))
        .when(m == 6, empty_cell())
        .otherwise(make_cell(C.STRING, s=F.lit("2.5e1")))
    )
    return part.select("p_partkey", cell.alias("c"), (m == 6).alias("none"))


def _typed(dtype: Dtype, value: Callable[[Column], Column] | None = None):
    """Integers come with a flag instead of nulls, and dates as text: what a comparison through data frames keeps apart."""

    def run(spark, sf_dir):
        out = (value or (lambda c: C.coerce(c, dtype)))(F.col("c"))
        cols = [out.alias("value")]
        if dtype in (Dtype.INT, Dtype.DURATION):
            cols = [F.coalesce(out, F.lit(-1)).alias("value"), out.isNull().alias("is_null")]
        elif dtype == Dtype.DATE:
            cols = [out.cast("string").alias("value")]
        return _mixed(spark, sf_dir).select("p_partkey", *cols)

    return run


def _case(**by: str) -> str:
    cases = " ".join(f"WHEN p_partkey % 8 = {k[1:]} THEN {v}" for k, v in by.items())
    return f"SELECT p_partkey, CASE {cases} END AS value FROM part"


_SERIAL = "(TIMESTAMP '1899-12-30' + to_milliseconds(({0} * 86400000.0)::BIGINT) + CASE WHEN {0} < 60 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)"
_TEXT = "rtrim(rtrim(printf('%.9f', {0}), '0'), '.')"

for _name, _dtype, _value, _sql in (
    ("to_boolean", Dtype.BOOL, None, _case(m0="p_size <> 0", m1="p_retailprice <> 0", m4="p_size % 2 <> 0")),
    ("to_int", Dtype.INT, None, _case(m0="p_size::BIGINT", m1="trunc(p_retailprice)::BIGINT", m3="p_size::BIGINT", m4="(p_size % 2)::BIGINT")),
    ("to_float", Dtype.FLOAT, None, _case(m0="p_size::DOUBLE", m1="p_retailprice", m3="p_size::DOUBLE", m4="(p_size % 2)::DOUBLE", m7="25.0::DOUBLE")),
    (
        "to_string",
        Dtype.STRING,
        None,
        _case(m0="p_size::VARCHAR", m1=_TEXT.format("p_retailprice"), m2="p_name", m3="p_size::VARCHAR", m4="CASE WHEN p_size % 2 <> 0 THEN 'true' ELSE 'false' END", m5=f"strftime({_SERIAL.format('(p_size + 0.5)')}, '%Y-%m-%d %H:%M:%S')", m7="'2.5e1'"),
    ),
    ("to_datetime", Dtype.DATETIME, None, _case(m0=_SERIAL.format("p_size"), m1=f"({_SERIAL.format('p_retailprice')})", m5=_SERIAL.format("(p_size + 0.5)"))),
    ("to_date", Dtype.DATE, None, _case(m0=f"{_SERIAL.format('p_size')}::DATE", m1=f"{_SERIAL.format('p_retailprice')}::DATE", m5=f"{_SERIAL.format('(p_size + 0.5)')}::DATE")),
    ("to_duration_ms", Dtype.DURATION, C.duration_ms, _case(m5="((p_size + 0.5) * 86400000.0)::BIGINT")),
):
    if _dtype in (Dtype.INT, Dtype.DURATION):
        _sql = f"SELECT p_partkey, coalesce(value, -1) AS value, value IS NULL AS is_null FROM ({_sql})"
    elif _dtype == Dtype.DATE:
        _sql = f"SELECT p_partkey, value::VARCHAR AS value FROM ({_sql})"
    QUERIES[_name], ORACLES[_name] = _typed(_dtype, _value), _sql


@query("SELECT l_orderkey, l_linenumber, rtrim(rtrim(printf('%.9f', l_extendedprice), '0'), '.') AS price, rtrim(rtrim(printf('%.9f', l_discount), '0'), '.') AS discount FROM lineitem")
def excel_float_text(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.float_text("l_extendedprice").alias("price"), C.float_text("l_discount").alias("discount"))


@query(f"SELECT p_partkey, {_SERIAL.format('(p_size + p_partkey % 100)')} AS at, {_SERIAL.format('(p_size + p_partkey % 100)')}::DATE::VARCHAR AS day FROM part")
def serial_to_datetime(spark, sf_dir):
    days = (F.col("p_size") + F.col("p_partkey") % 100).cast("double")
    return _t(spark, sf_dir, "part").select("p_partkey", C.serial_to_datetime(days).alias("at"), C.serial_to_date(days).cast("string").alias("day"))


# Inference


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 8 WHEN 5 THEN 16 WHEN 6 THEN 0 ELSE 4 END AS bit FROM part")
def infer_cell(spark, sf_dir):
    return _mixed(spark, sf_dir).select("p_partkey", cell_bit(F.col("c")).alias("bit"))


@query("SELECT count(*) AS n_rows, bit_or(CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 8 WHEN 5 THEN 16 WHEN 6 THEN 0 ELSE 4 END) AS mask FROM part")
def infer_mask(spark, sf_dir):
    n, found = masks(_mixed(spark, sf_dir).select(F.array("c").alias("cells")), [0])
    return spark.createDataFrame([(n, found[0])], "n_rows long, mask int")


_LATTICE = {
    ("int",): "int", ("int", "boolean"): "int", ("int", "float"): "float", ("boolean", "float", "int"): "float", ("boolean",): "boolean",
    ("string", "int"): "string", ("datetime", "date"): "string", ("datetime", "float"): "string", ("duration",): "duration", ("duration", "int"): "error", (): "string",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{'+'.join(sorted(k))}', '{v}')" for k, v in _LATTICE.items()) + ") t(parts, dtype)")
def infer_lattice(spark, sf_dir):
    def found(parts):
        try:
            return lattice(sum(BITS[Dtype(p)] for p in parts), 1).value
        except WorkbookError:
            return "error"

    return spark.createDataFrame([("+".join(sorted(k)), found(k)) for k in _LATTICE], "parts string, dtype string")


@query("SELECT * FROM (VALUES ('coerce', 'string'), ('strict', 'error')) t(mode, dtype)")
def infer_strict(spark, sf_dir):
    grid = _mixed(spark, sf_dir).select(F.array("c").alias("cells"))
    n, (mask,) = masks(grid, [0])

    def found(mode):
        try:
            return lattice(mask, n, mode).value
        except WorkbookError:
            return "error"

    return spark.createDataFrame([(m.value, found(m)) for m in Coercion], "mode string, dtype string")


def _late_text(spark, sf_dir, **options) -> DataFrame:
    """Whole numbers, then text from row 1200 on."""
    rows = spark.range(1500)
    cell = F.when(F.col("_row") < 1200, make_cell(C.INT, i=F.col("_row"))).otherwise(make_cell(C.STRING, s=F.lit("x")))
    return _load(grid_of(rows.withColumnRenamed("id", "_row"), F.col("_row"), [cell], ["v"]), **options)


@query("SELECT CASE WHEN i < 1200 THEN i ELSE -1 END AS v FROM range(1500) t(i)")
def infer_sampled(spark, sf_dir):
    return _late_text(spark, sf_dir).select(F.coalesce("v", F.lit(-1)).alias("v"))


@query("SELECT CASE WHEN i < 1200 THEN i::VARCHAR ELSE 'x' END AS v FROM range(1500) t(i)")
def infer_all_rows(spark, sf_dir):
    return _late_text(spark, sf_dir, schema_sample_rows=None)


@query("SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE n_regionkey END::BIGINT AS region FROM nation")
def infer_null_strings(spark, sf_dir):
    nation = numbered(_t(spark, sf_dir, "nation"), "n_nationkey")
    cell = F.when(F.col("n_nationkey") % 2 == 0, make_cell(C.STRING, s=F.lit("N/A"))).otherwise(make_cell(C.INT, i=F.col("n_regionkey")))
    return _load(grid_of(nation, F.col("_row"), [make_cell(C.INT, i=F.col("n_nationkey")), cell], ["key", "region"])).select("key", F.coalesce("region", F.lit(-1)).alias("region"))


def _part(spark, sf_dir, **options):
    table = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return _load(TableGrid(table, "p_partkey"), **options)


@query("SELECT p_partkey, p_name, p_size::VARCHAR AS p_size, trunc(p_retailprice)::BIGINT AS p_retailprice FROM part")
def dtype_override_index(spark, sf_dir):
    return _part(spark, sf_dir, dtypes={2: "string", 3: "int"})


@query("SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part")
def dtype_override_name(spark, sf_dir):
    return _part(spark, sf_dir, dtypes={"p_partkey": "float", "unknown": "int"})


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size, rtrim(rtrim(printf('%.9f', p_retailprice), '0'), '.') AS p_retailprice FROM part")
def dtype_override_all(spark, sf_dir):
    return _part(spark, sf_dir, dtypes="string")


@query(
    """SELECT i + 1 AS "row", 1 AS col, 1::BIGINT AS row_offset, 'Expected int but got ''' || CASE m WHEN 2 THEN 'String("' || p_name || '")' WHEN 5 THEN 'DateTime(' || (p_size + 0.5)::DOUBLE::VARCHAR || ')' ELSE 'String("2.5e1")' END || '''' AS detail
FROM (SELECT *, p_partkey % 8 AS m, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE m IN (2, 5, 7)"""
)
def cell_errors(spark, sf_dir):
    part = numbered(_mixed(spark, sf_dir), "p_partkey")
    grid = grid_of(part, F.col("_row"), [make_cell(C.INT, i=F.col("p_partkey")), F.col("c")], ["p_partkey", "v"])
    return LoadPlan.build(grid, LoadOptions.for_sheet(dtypes={"v": "int"})).errors()


@query("SELECT * FROM (VALUES ('c_custkey', 0, 'int', 'looked_up', 'guessed'), ('c_acctbal', 3, 'string', 'looked_up', 'provided_by_name')) t(name, absolute_index, dtype, column_name_from, dtype_from)")
def column_infos(spark, sf_dir):
    plan = LoadPlan.build(_sheet(spark, sf_dir, "customer", "c_custkey"), LoadOptions.for_sheet(use_columns=[0, 3], dtypes={"c_acctbal": "string"}))
    rows = [(c.name, c.absolute_index, c.dtype, c.column_name_from, c.dtype_from) for c in plan.selected]
    return spark.createDataFrame(rows, "name string, absolute_index int, dtype string, column_name_from string, dtype_from string")


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag")
def sheet_then_aggregate(spark, sf_dir):
    """A loaded sheet is a Catalyst plan like any other."""
    loaded = scan_lineitem(spark, sf_dir)
    return loaded.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.max("l_shipdate").alias("last"))
