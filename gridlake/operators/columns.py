"""Column names and column selection; plan-time work over at most some thousands of columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from ..errors import ColumnNotFoundError, InvalidParametersError
from ..plans.options import ColumnInfoNoDtype, NameFrom

UNNAMED = "__UNNAMED__"


def letter_index(letters: str) -> int:
    """Position of a column letter: A is 0, Z 25, AA 26."""
    if not re.fullmatch("[A-Z]+", letters):
        raise InvalidParametersError(f"a column must be made of letters, got {letters!r}" if letters else "a column cannot be empty")
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _range_of(spec: str, last: int) -> range:
    """Positions of one element of a letter list; ``last`` ends an open one."""
    ends = spec.split(":")
    if len(ends) == 1:
        n = letter_index(spec)
        return range(n, n + 1)
    if len(ends) != 2:
        raise InvalidParametersError(f"a column range must have exactly 2 elements, got {len(ends)}: {spec!r}")
    start, end = ends
    if not start and not end:
        raise InvalidParametersError(f"a column range cannot have both ends open: {spec!r}")
    a = letter_index(start) if start else 0
    if not end:
        return range(a, last + 1)
    b = letter_index(end)
    if start and b < a:
        raise InvalidParametersError(f"end of range is before start: {spec!r}")
    if start and a == b:
        raise InvalidParametersError(f"empty range: {spec!r}")
    return range(a, b + 1)


def letter_positions(spec: str, last: int) -> list[int]:
    """Absolute positions of a letter list such as ``A,C:E``, ``B:`` or ``:C,E:``.

    Without an open range they come sorted; with one they keep the list's order. Repeats collapse.
    """
    parts = spec.upper().split(",")
    found = list(dict.fromkeys(i for p in parts for i in _range_of(p, last)))
    open_ended = any(p.startswith(":") or p.endswith(":") for p in parts)
    return found if open_ended else sorted(found)


def aliased(names: Sequence[str]) -> list[str]:
    """Names made unique from left to right: the first free of ``name``, ``name_1``, ``name_2``, ..."""
    taken: set[str] = set()
    out = []
    for name in names:
        free, n = name, 0
        while free in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free)
        out.append(free)
    return out


def name_columns(width: int, start_col: int, header: Sequence[str | None] | None, provided: Sequence[str] | None, selection: object) -> list[ColumnInfoNoDtype]:
    """All columns of a range with their names.

    ``header``: texts of the header row, if there is one. ``provided`` names win over it: they go to the columns in order, or, if the columns
    are selected by position, to these in the order of the selection.
    """
    names: list[tuple[str, NameFrom]] = [(f"{UNNAMED}{i}", NameFrom.GENERATED) for i in range(width)]
    if provided is not None:
        chosen = positions(selection, start_col + width - 1)
        if chosen is None:
            if len(provided) > width:
                raise InvalidParametersError(f"{len(provided)} column names were given for {width} columns")
            at = range(len(provided))
        else:
            if len(chosen) != len(provided):
                raise InvalidParametersError(f"column_names and use_columns must have the same length, got {len(provided)} and {len(chosen)}")
            at = [i - start_col for i in chosen]
        for i, name in zip(at, provided):
            if not 0 <= i < width:
                raise ColumnNotFoundError(f"column at index {i + start_col} not found")
            names[i] = (name, NameFrom.PROVIDED)
    elif header is not None:
        for i, text in enumerate(header[:width]):
            text = None if text is None else text.replace("\0", "")
            if text is not None and text.strip():
                names[i] = (text, NameFrom.LOOKED_UP)
    unique = aliased([n for n, _ in names])
    return [ColumnInfoNoDtype(n, i, i + start_col, source.value) for i, (n, (_, source)) in enumerate(zip(unique, names))]


def positions(selection: object, last: int) -> list[int] | None:
    """Absolute positions that a selection names outright; None for all columns or a callable. Names cannot be mixed in here."""
    if selection is None or callable(selection) and not isinstance(selection, (str, list, tuple)):
        return None
    if isinstance(selection, str):
        return letter_positions(selection, last)
    if any(isinstance(x, str) for x in selection):
        raise InvalidParametersError("use_columns can only hold indices when column_names are given")
    return list(dict.fromkeys(selection))


def check_selection(selection: object) -> None:
    """Reject a selection that no sheet can satisfy, before the sheet is read."""
    if isinstance(selection, str):
        letter_positions(selection, 1 << 14)
    elif isinstance(selection, (list, tuple)):
        if not selection:
            raise InvalidParametersError("list of selected columns is empty")
        for x in selection:
            if not isinstance(x, str) and (isinstance(x, bool) or not isinstance(x, int) or x < 0):
                raise InvalidParametersError(f"expected a column name or index, got {x!r}")
    elif selection is not None and not callable(selection):
        raise InvalidParametersError(f"use_columns must be a string, a list or a callable, got {selection!r}")


def select_columns(columns: list[ColumnInfoNoDtype], selection: object, to_info: Callable[[ColumnInfoNoDtype], object] = lambda c: c) -> list[ColumnInfoNoDtype]:
    """The selected of all ``columns``, in the order that the selection gives them; repeats collapse."""
    if selection is None:
        return list(columns)
    if isinstance(selection, (str, list, tuple)):
        last = columns[-1].absolute_index if columns else -1
        wanted = letter_positions(selection, last) if isinstance(selection, str) else selection
        by_name = {c.name: c for c in columns}
        by_index = {c.absolute_index: c for c in columns}
        out: dict[int, ColumnInfoNoDtype] = {}
        for x in wanted:
            found = by_name.get(x) if isinstance(x, str) else by_index.get(x)
            if found is None:
                what = f'column with name "{x}"' if isinstance(x, str) else f"column at index {x}"
                raise ColumnNotFoundError(f"{what} not found").with_context(f"available columns are: {[c.name for c in columns]}")
            out.setdefault(found.index, found)
        return list(out.values())
    out = []
    for c in columns:
        keep = selection(to_info(c))
        if not isinstance(keep, bool):
            raise InvalidParametersError(f"use_columns callable must return a bool, got {keep!r}")
        if keep:
            out.append(c)
    return out
