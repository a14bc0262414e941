"""Header and row windows, inference, and the coercion of every kind of cell."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlake import queries
from gridlake.adapters import TableGrid, grid_from_table, numbered
from gridlake.errors import InvalidParametersError, UnsupportedColumnTypeCombinationError, WorkbookCellError
from gridlake.functions import coerce as C
from gridlake.operators.infer import BITS, BROKEN, lattice
from gridlake.plans.options import Coercion, Dtype, LoadOptions
from gridlake.plans.plan import LoadPlan

EMPTY = (C.EMPTY, None, None, None)


def text(s):
    return (C.STRING, s, None, None)


def num(x):
    return (C.FLOAT, None, float(x), None)


def grid(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), C.GRID)


def load(spark, rows, **options):
    plan = LoadPlan.build(grid(spark, rows), LoadOptions.for_sheet(**options))
    out = plan.dataframe(keep_row=True).orderBy("_row").drop("_row")
    return out.columns, [tuple(r) for r in out.collect()]


NO_HEADER = [[EMPTY, EMPTY]] * 2 + [[text(c), num(i)] for i, c in enumerate("abcdef")]
U, A = ["__UNNAMED__0", "__UNNAMED__1"], ["a", "0"]


@pytest.mark.parametrize(
    ("header_row", "skip_rows", "columns", "first"),
    [
        (0, None, A, "bcdef"),
        (None, 0, U, "__abcdef"),
        (None, None, U, "abcdef"),
        (0, 0, U, "_abcdef"),
        (0, 1, U, "abcdef"),
        (None, 2, U, "abcdef"),
        (None, 3, U, "bcdef"),
        (1, 0, U, "abcdef"),
        (2, 0, A, "bcdef"),
        (2, None, A, "bcdef"),
        (2, 1, A, "cdef"),
        (2, [1, 3], A, "bdf"),
        (2, [0], A, "cdef"),
        (None, [2, 4], U, "__bdef"),
        (2, [], A, "bcdef"),
        (2, [0, 1, 2, 3], A, "f"),
        (2, lambda x: x % 2 == 0, A, "ce"),
        (2, lambda x: x in (0, 4), A, "cde"),
        (2, lambda x: False, A, "bcdef"),
        (2, lambda x: x != 2, A, "d"),
    ],
)
def test_header_and_skip(spark, header_row, skip_rows, columns, first):
    got, rows = load(spark, NO_HEADER, header_row=header_row, skip_rows=skip_rows)
    assert got == columns
    assert "".join(r[0] or "_" for r in rows) == first


def test_skip_rejects(spark):
    with pytest.raises(InvalidParametersError, match="Max height is 6"):
        load(spark, NO_HEADER, header_row=2, skip_rows=7)
    with pytest.raises(InvalidParametersError):
        load(spark, NO_HEADER, header_row=2, skip_rows=lambda x: "no")
    with pytest.raises(InvalidParametersError):
        load(spark, NO_HEADER, header_row=2, skip_rows=lambda x: 1 / 0)


def test_n_rows_counts_before_the_list(spark):
    assert [r[0] for r in load(spark, NO_HEADER, n_rows=3, skip_rows=[0], header_row=2)[1]] == ["c", "d"]


def test_many_listed_rows(spark):
    rows = [[num(i)] for i in range(3000)]
    got = load(spark, rows, header_row=None, skip_rows=lambda i: i % 3 > 0)[1]
    assert [r[0] for r in got] == [float(i) for i in range(0, 3000, 3)]


def test_empty_sheet(spark):
    assert load(spark, []) == ([], [])


def test_whitespace(spark):
    rows = [[text("x"), text("y")], [num(1), text(" ")], [EMPTY, text("b")], [text(" \t "), EMPTY]]
    assert load(spark, rows, skip_whitespace_tail_rows=True, dtypes="string")[1] == [("1", " "), (None, "b")]
    assert load(spark, rows, whitespace_as_null=True)[1] == [(1.0, None), (None, "b"), (None, None)]


@pytest.mark.parametrize(
    ("parts", "dtype"),
    [
        (["int"], "int"), (["int", "boolean"], "int"), (["int", "float"], "float"), (["float", "boolean"], "float"), (["boolean"], "boolean"), (["string", "float"], "string"),
        (["datetime", "date"], "string"), (["datetime", "float"], "string"), (["duration"], "duration"), ([], "string"),
    ],
)
def test_lattice(parts, dtype):
    assert lattice(sum(BITS[Dtype(p)] for p in parts), 1).value == dtype


def test_lattice_errors(caplog):
    assert lattice(0, 0) == Dtype.NULL
    assert lattice(0, 3, column=4) == Dtype.STRING
    assert "Could not determine dtype for column 4, falling back to string" in caplog.text
    with pytest.raises(UnsupportedColumnTypeCombinationError):
        lattice(BITS[Dtype.DURATION] | BITS[Dtype.INT], 1)
    with pytest.raises(UnsupportedColumnTypeCombinationError, match="type coercion is strict"):
        lattice(BITS[Dtype.FLOAT] | BITS[Dtype.INT], 1, Coercion.STRICT)
    with pytest.raises(WorkbookCellError):
        lattice(BROKEN, 1)


def test_error_cells(spark):
    error = lambda code: (C.ERROR, code, None, None)
    assert load(spark, [[text("a")], [num(1)], [error("#N/A")], [error("#DIV/0!")]])[1] == [(1.0,), (None,), (None,)]
    with pytest.raises(WorkbookCellError):
        load(spark, [[text("a")], [error("#NAME?")]])


SERIAL = lambda x: (C.SERIAL, None, x, None)
CELLS = [
    EMPTY, text("foo"), num(-1), num(0), num(1), num(0), num(1), num(1.1), text("-1"), text("0"), text("1"), text("1.1"), (C.BOOL, None, None, 1), (C.BOOL, None, None, 0),
    SERIAL(45128.0), SERIAL(45128 + (12 * 60 + 20) / 1440), SERIAL((12 * 60 + 20) / 1440), text("07/21/2023"), text("7/21/2023  12:20:00 PM"), text("July 23rd"), text("12:20:00"), num(0.1),
]
D, T, H = dt.date, dt.datetime, dt.timedelta
NONE4 = [None] * 4
EXPECTED = {
    "int": [None, None, -1, 0, 1, 0, 1, 1, -1, 0, 1, None, 1, 0, None, None, None, *NONE4, 0],
    "float": [None, None, -1.0, 0.0, 1.0, 0.0, 1.0, 1.1, -1.0, 0.0, 1.0, 1.1, 1.0, 0.0, None, None, None, *NONE4, 0.1],
    "string": [
        None, "foo", "-1", "0", "1", "0", "1", "1.1", "-1", "0", "1", "1.1", "true", "false", "2023-07-21 00:00:00", "2023-07-21 12:20:00", "1899-12-31 12:20:00",
        "07/21/2023", "7/21/2023  12:20:00 PM", "July 23rd", "12:20:00", "0.1",
    ],
    "boolean": [None, None, True, False, True, False, True, True, *NONE4, True, False, None, None, None, *NONE4, True],
    "datetime": [
        None, None, T(1899, 12, 30), T(1899, 12, 31), T(1900, 1, 1), T(1899, 12, 31), T(1900, 1, 1), T(1900, 1, 1, 2, 24), *NONE4, None, None,
        T(2023, 7, 21), T(2023, 7, 21, 12, 20), T(1899, 12, 31, 12, 20), *NONE4, T(1899, 12, 31, 2, 24),
    ],
    "date": [
        None, None, D(1899, 12, 30), D(1899, 12, 31), D(1900, 1, 1), D(1899, 12, 31), D(1900, 1, 1), D(1900, 1, 1), *NONE4, None, None,
        D(2023, 7, 21), D(2023, 7, 21), D(1899, 12, 31), *NONE4, D(1899, 12, 31),
    ],
    "duration": [*[None] * 14, D(2023, 7, 22) - D(1899, 12, 31), T(2023, 7, 22, 12, 20) - T(1899, 12, 31), H(hours=12, minutes=20), *NONE4, None],
}


@pytest.mark.parametrize("dtype", EXPECTED)
def test_coercion(spark, dtype):
    plan = LoadPlan.build(grid(spark, [[text("Column")], *([c] for c in CELLS)]), LoadOptions.for_sheet(dtypes=dtype))
    got = [r[1] for r in plan.dataframe(keep_row=True).orderBy("_row").collect()]
    assert got == EXPECTED[dtype]
    errors = {r["row"] - r["row_offset"]: r["detail"] for r in plan.errors().collect()}
    assert set(errors) == {i for i, v in enumerate(EXPECTED[dtype]) if v is None and i}
    if 1 in errors:
        assert errors[1] == f"Expected {dtype} but got 'String(\"foo\")" + ("" if dtype == "boolean" else "'")


def test_iso_cells(spark):
    rows = [[text("d"), text("t"), text("x")], [(C.ISO, "2023-06-01", None, None), (C.ISO_DURATION, "PT01H02M03S", None, None), (C.ISO, "2023-06-01T02:03:04", None, None)]]
    plan = LoadPlan.build(grid(spark, rows), LoadOptions.for_sheet())
    assert [c.dtype for c in plan.selected] == ["date", "duration", "datetime"]
    assert tuple(plan.dataframe().first()) == (D(2023, 6, 1), H(hours=1, minutes=2, seconds=3), T(2023, 6, 1, 2, 3, 4))


@pytest.mark.parametrize(("x", "shown"), [(0.1, "0.1"), (29.02, "29.02"), (1234567.0, "1234567"), (0.1234567895, "0.123456789"), (1e-12, "0"), (-2.50, "-2.5"), (1e15, "1000000000000000")])
def test_float_text(spark, x, shown):
    assert spark.createDataFrame([(x,)], "x double").select(C.float_text("x")).first()[0] == shown


def test_serial_epoch(spark):
    got = spark.createDataFrame([(float(x),) for x in (59, 60, 61, 44333, 123456)], "x double").select(C.serial_to_date(C.F.col("x"))).collect()
    assert [r[0] for r in got] == [D(1900, 2, 28), D(1900, 2, 28), D(1900, 3, 1), D(2021, 5, 17), D(2238, 1, 3)]


def test_strict_numbers(spark):
    rows = [[text(s)] for s in (" 1 ", "1d", "1.5f", "NaN", "1e3", "+5", "1e400", "9223372036854775808")]
    got = load(spark, rows, header_row=None, dtypes="int")[1]
    assert [r[0] for r in got] == [None, None, None, None, None, 5, None, None]
    got = load(spark, rows, header_row=None, dtypes="float")[1]
    assert [r[0] for r in got][:6] == [None, None, None, None, 1000.0, 5.0]


def test_precedence_of_dtypes(spark):
    rows = [[text("a"), text("b"), text("c")], [num(1), num(2), num(3)]]
    plan = LoadPlan.build(grid(spark, rows), LoadOptions.for_sheet(dtypes={0: "int", "a": "string", "b": "string"}))
    assert [(c.dtype, c.dtype_from) for c in plan.selected] == [("int", "provided_by_index"), ("string", "provided_by_name"), ("float", "guessed")]


@pytest.mark.parametrize("bad", [{"dtypes": "decimal"}, {"dtypes": 3}, {"dtype_coercion": "maybe"}, {"skip_rows": -1}, {"skip_rows": "a"}, {"schema_sample_rows": 0}, {"use_columns": []}, {"use_columns": [1.5]}])
def test_options_rejected(spark, bad):
    with pytest.raises(InvalidParametersError):
        load(spark, NO_HEADER, **bad)


def test_numbered_on_many_partitions(spark):
    """Row numbers follow the keys on any number of partitions, whatever job asks for them."""
    n = 400_000
    keys = F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 977)
    df = spark.range(0, n, 1, 8).select(keys.alias("a"), F.concat(F.lit("é"), (F.col("id") * 7919 % n).cast("string")).alias("b")).repartition(8)
    want = {(r["a"], r["b"]): i for i, r in enumerate(df.orderBy("a", "b").toLocalIterator())}
    for _ in range(2):
        got = numbered(df, "a", "b", range_rows=30_000)
        pairs = got.select("a", "b", "_row").toPandas()
        assert len(pairs) == n
        assert all(want[None if a != a else int(a), b] == r for a, b, r in zip(pairs["a"], pairs["b"], pairs["_row"]))
    loaded = LoadPlan.build(grid_from_table(df.select("b"), "b"), LoadOptions.for_sheet(n_rows=100_000)).dataframe()
    first = sorted(b for _, b in want)[:100_000]
    assert sorted(r["b"] for r in loaded.collect()) == first
    assert numbered(df.filter("false"), "a").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lineitem(spark, folder):
    """A lineitem whose keys repeat, in several files."""
    day = F.timestamp_add("DAY", F.col("id") % 99, F.lit(dt.datetime(1995, 1, 1)))
    cols = {"l_orderkey": F.col("id") % 700, "l_linenumber": (F.col("id") % 3).cast("int"), "l_quantity": (F.col("id") % 50).cast("double"), "l_extendedprice": F.col("id") / 8}
    df = spark.range(0, 3000, 1, 4).select(*(c.alias(k) for k, c in cols.items()), F.when(F.col("id") % 2 == 0, "A").otherwise("N").alias("l_returnflag"), day.cast("timestamp_ntz").alias("l_shipdate"))
    df.write.parquet(f"{folder}/lineitem.parquet")
    return df


def test_all_rows_of_a_table_are_scanned(spark, tmp_path):
    """Loading a whole table sorts nothing, and no row passes through Python."""
    want = sorted(lineitem(spark, tmp_path).collect())
    loaded = queries.scan_lineitem(spark, str(tmp_path))
    assert not {"Window", "Sort", "PythonUDF", "EvalPython"} & set(plan_of(loaded).replace("[", " ").split())
    assert "float_text" not in plan_of(loaded)
    assert sorted(tuple(r) for r in loaded.collect()) == [tuple(r) for r in want]


def test_a_loaded_table_is_aggregated_without_a_sort(spark, tmp_path):
    """The only shuffle is that of the aggregate."""
    rows = [tuple(r) for r in lineitem(spark, tmp_path).collect()]
    got = queries.sheet_then_aggregate(spark, str(tmp_path))
    assert "Window" not in plan_of(got) and "float_text" not in plan_of(got)
    want = {flag: (sum(r[4] == flag for r in rows), sum(r[2] for r in rows if r[4] == flag), max(r[5] for r in rows if r[4] == flag)) for flag in "AN"}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_listed_rows_do_not_number_a_table(spark, tmp_path, monkeypatch):
    """First rows are left out by one key; rows that share it are still told apart."""
    monkeypatch.setattr("gridlake.adapters.numbered", None)
    for of, name in ((1, "unique"), (4, "repeated")):
        keys = F.expr(f"id * 7919 % 4000 div {of}")
        spark.range(0, 4000, 1, 4).select(keys.alias("o_orderkey"), F.lit("O").alias("o_orderstatus")).write.parquet(f"{tmp_path}/{name}/orders.parquet")
        got = [r[0] for r in queries.skip_list(spark, f"{tmp_path}/{name}").collect()]
        assert sorted(got) == [i // of for i in range(4000) if i not in (0, 3, 500)]
        assert sorted(r[0] for r in queries.skip_n(spark, f"{tmp_path}/{name}").collect()) == [i // of for i in range(700, 4000)]


@pytest.mark.parametrize("options", [{"skip_rows": [0, 3, 50]}, {"skip_rows": 20, "n_rows": 50}, {"header_row": None, "skip_rows": [0, 1], "dtypes": "string"}])
def test_parts_of_a_table(spark, options):
    """Parts of a table are those of its numbered grid, with null keys and a blank row too."""
    rows = [(None, None, None), (None, 0.5, None), *((i, i / 2, f"t{i}") for i in range(2, 100))]
    df = spark.createDataFrame(rows[::-1], "a long, b double, c string").coalesce(2)
    of = [LoadPlan.build(g, LoadOptions.for_sheet(**options)) for g in (TableGrid(df, "a", "b"), grid_from_table(df, "a", "b"))]
    for keep in (False, True):
        got, want = (sorted(map(repr, p.dataframe(keep).collect())) for p in of)
        assert got == want and of[0].found == of[1].found and of[0].selected == of[1].selected
