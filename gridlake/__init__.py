"""A Spark-native analytics engine over workbook grids."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_EXPORTS = {
    "reader": ("read_workbook", "read_excel", "WorkbookHandle", "Sheet", "Table", "CellError", "CellErrors"),
    "plans.options": ("ColumnInfo", "ColumnInfoNoDtype", "Dtype", "LoadOptions"),
    "functions.vectors": ("TypedColumn",),
    "sources.formats": ("DefinedName",),
    "sources.datasource": ("WorkbookSource", "register"),
    "errors": (
        "WorkbookError", "UnsupportedColumnTypeCombinationError", "CannotRetrieveCellDataError", "WorkbookCellError", "WorkbookFormatError", "SheetNotFoundError",
        "ColumnNotFoundError", "ArrowError", "InvalidParametersError", "InvalidColumnError", "InternalError",
    ),
}
_WHERE = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = ["__version__", *sorted(_WHERE)]


def __getattr__(name: str):
    """Exports load when used, so that Python workers import only what they run."""
    if name in _WHERE:
        return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
