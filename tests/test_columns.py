import pytest

from gridlake.errors import ColumnNotFoundError, InvalidParametersError
from gridlake.operators.columns import aliased, letter_index, letter_positions, name_columns, select_columns


def names(columns):
    return [c.name for c in columns]


@pytest.fixture
def five():
    return name_columns(5, 0, list("abcde"), None, None)


@pytest.mark.parametrize(("letters", "index"), [("A", 0), ("Z", 25), ("AA", 26), ("AB", 27), ("XFD", 16383)])
def test_letter_index(letters, index):
    assert letter_index(letters) == index


@pytest.mark.parametrize("bad", ["", "1", "A B", "É"])
def test_letter_index_rejects(bad):
    with pytest.raises(InvalidParametersError):
        letter_index(bad)


@pytest.mark.parametrize(
    ("spec", "positions"),
    [("A,C:E", [0, 2, 3, 4]), ("C:D,A", [0, 2, 3]), ("b,a,b", [0, 1]), ("C:,A", [2, 3, 4, 0]), (":C,E:", [0, 1, 2, 4]), ("B:", [1, 2, 3, 4]), ("B:,C", [1, 2, 3, 4]), ("G:", [])],
)
def test_letter_positions(spec, positions):
    assert letter_positions(spec, 4) == positions


@pytest.mark.parametrize(
    ("spec", "message"), [("B:A", "end of range is before start"), ("A:A", "empty range"), ("A:B:E", "exactly 2 elements, got 3"), (":", "cannot have both"), ("A, B", "letters"), ("", "empty")]
)
def test_letter_positions_rejects(spec, message):
    with pytest.raises(InvalidParametersError, match=message):
        letter_positions(spec, 4)


def test_aliases():
    assert aliased(["col", "col", "col_1"]) == ["col", "col_1", "col_1_1"]
    assert aliased(["a"] * 3) == ["a", "a_1", "a_2"]


def test_header_names():
    assert names(name_columns(4, 0, ["a", None, " ", "b\0c"], None, None)) == ["a", "__UNNAMED__1", "__UNNAMED__2", "bc"]
    assert [c.column_name_from for c in name_columns(2, 0, ["a"], None, None)] == ["looked_up", "generated"]
    assert names(name_columns(2, 7, None, None, None)) == ["__UNNAMED__0", "__UNNAMED__1"]


def test_provided_names():
    assert names(name_columns(3, 0, None, ["x"], None)) == ["x", "__UNNAMED__1", "__UNNAMED__2"]
    assert names(name_columns(3, 0, None, ["x", "y"], [2, 0])) == ["y", "__UNNAMED__1", "x"]
    with pytest.raises(InvalidParametersError, match="same length"):
        name_columns(3, 0, None, ["x"], [2, 0])
    with pytest.raises(InvalidParametersError, match="indices"):
        name_columns(3, 0, None, ["x"], ["a"])
    with pytest.raises(InvalidParametersError):
        name_columns(1, 0, None, ["x", "y"], None)


def test_selection(five):
    assert names(select_columns(five, ["d", 1, "d"])) == ["d", "b"]
    assert names(select_columns(five, lambda c: c.index % 2 == 0)) == ["a", "c", "e"]
    with pytest.raises(ColumnNotFoundError, match="available columns"):
        select_columns(five, ["z"])
    with pytest.raises(InvalidParametersError):
        select_columns(five, lambda c: 1)


def test_absolute_positions():
    columns = name_columns(3, 7, list("abc"), None, None)
    assert names(select_columns(columns, "H,J")) == ["a", "c"]
    with pytest.raises(ColumnNotFoundError):
        select_columns(columns, ":C")
