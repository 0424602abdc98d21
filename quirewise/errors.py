"""Errors raised for bad *requests*.

Bad rows or files never raise: they travel in reject tables with an ``error`` column.
Request errors derive from ``ValueError`` so callers can catch them without importing us.
"""


class RequestError(ValueError):
    """The request itself cannot be planned."""


class ConditionError(RequestError):
    """A filter condition is incomplete, names no column, or has an unusable value."""


class SheetError(RequestError):
    """A workbook needs a sheet name, or the named sheet does not exist."""


class UnsupportedFileType(RequestError):
    """Strict ingest met an extension nobody can read."""
