"""Errors, all under ``WorkbookError``."""

from __future__ import annotations


class WorkbookError(Exception):
    """Base of all errors; a message and a stack of contexts, the innermost first."""

    def __init__(self, message: str):
        super().__init__(message)
        self.message, self.contexts = message, []

    def with_context(self, context: str) -> WorkbookError:
        self.contexts.append(context)
        return self

    def __str__(self) -> str:
        if not self.contexts:
            return self.message
        return self.message + "\nContext:\n" + "\n".join(f"    {i}: {c}" for i, c in enumerate(self.contexts))


class UnsupportedColumnTypeCombinationError(WorkbookError):
    """The dtypes of a column cannot be reconciled."""


class CannotRetrieveCellDataError(WorkbookError):
    """There is no cell at a position."""


class WorkbookCellError(WorkbookError):
    """A cell holds an error that is not treated as missing."""


class WorkbookFormatError(WorkbookError):
    """The file is not a workbook that can be read."""


class SheetNotFoundError(WorkbookError):
    """No such sheet."""


class ColumnNotFoundError(WorkbookError):
    """No such column."""


class ArrowError(WorkbookError):
    """Conversion to Arrow failed."""


class InvalidParametersError(WorkbookError):
    """An argument cannot be used."""


class InvalidColumnError(WorkbookError):
    """A column could not be made."""


class InternalError(WorkbookError):
    """What was asked is not supported for this workbook."""
