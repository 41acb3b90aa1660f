"""Errors that a user of the dialect can meet; the message says what was wrong."""

from __future__ import annotations


class EngineError(Exception):
    prefix = ""

    def __init__(self, what: str = ""):
        super().__init__(f"{self.prefix}{what}")


class SyntaxFault(EngineError):
    prefix = "Syntax error: "


class TableNotFound(EngineError):
    prefix = "Table not found: "


class TableExists(EngineError):
    prefix = "Table already exists: "


class ColumnNotFound(EngineError):
    prefix = "Column not found: "


class AmbiguousColumn(EngineError):
    prefix = "Ambiguous column: "


class IndexNotFound(EngineError):
    prefix = "Index not found: "


class IndexExists(EngineError):
    prefix = "Index already exists: "


class DuplicateKey(EngineError):
    prefix = "Duplicate key for unique index: "


class ValueCountMismatch(EngineError):
    prefix = "Invalid value count"


class StringTooLong(EngineError):
    prefix = "String is too long: "


class NullViolation(EngineError):
    prefix = "Column may not be null: "


class IncompatibleTypes(EngineError):
    prefix = "Incompatible type: "


class IllegalAggregation(EngineError):
    prefix = "Aggregation illegal: "


class IllegalSubquery(EngineError):
    prefix = "Subquery illegal: "


class LoadFault(EngineError):
    prefix = "Load failed: "


class NoJoinStrategy(EngineError):
    prefix = "No join strategy is enabled"


class TransactionAbort(EngineError):
    prefix = "abort: "
