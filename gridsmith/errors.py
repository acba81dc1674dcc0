"""Errors of the toolkit; all are ValueErrors with a readable message."""

from __future__ import annotations


class GridError(ValueError):
    """Base of all errors raised on purpose."""


class UnsupportedFormat(GridError):
    def __init__(self, what: str):
        super().__init__(f"Unsupported format: {what}")


class ColumnNotFound(GridError):
    def __init__(self, missing: list[str], available: list[str]):
        super().__init__(f"Columns not found: {missing}. Available columns: {available}")
        self.missing, self.available = missing, available


class InvalidArgument(GridError):
    pass


class SchemaMismatch(GridError):
    def __init__(self, what: str):
        super().__init__(f"Schema mismatch: {what}")


class StatisticsError(GridError):
    pass


class FileError(GridError):
    pass
