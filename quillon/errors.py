"""Errors of the engine, and the translation of Spark's run-time errors into them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException


class EngineError(Exception):
    """Base of all errors that the engine reports."""


class SourceIOError(EngineError):
    """A source cannot be found or read."""


class CsvError(EngineError):
    """A record of a CSV source is malformed; ``line`` is its 1-based record number, 0 if unknown."""

    def __init__(self, line: int, message: str):
        self.line, self.message = line, message
        super().__init__(f"CSV error at line {line}: {message}" if line else f"CSV error: {message}")


class SqlSyntaxError(EngineError):
    """The query text is malformed; ``span`` is a half-open range of bytes in it."""

    def __init__(self, span: tuple[int, int], message: str):
        self.span, self.message = span, message
        super().__init__(f"syntax error at {span[0]}..{span[1]}: {message}")


class UnknownColumnError(EngineError):
    """A name is no column of the input."""

    def __init__(self, name: str):
        self.name = name
        super().__init__(f"unknown column '{name}'")


class SqlTypeError(EngineError):
    """An operator, clause or cast does not accept a type or a value."""


class DivisionByZeroError(EngineError):
    """A division or remainder by zero."""


class NumericOverflowError(EngineError):
    """An integer result outside 64 bits."""


class SchemaError(EngineError):
    """Column names repeat, or data and schema do not fit."""


class InternalError(EngineError):
    """A state that the engine rules out."""


#: Prefixes of the messages that lowered expressions raise, and their errors.
RAISED = {"TYPE": SqlTypeError, "OVERFLOW": NumericOverflowError, "CSV": None}
_CONDITIONS = {
    "DIVIDE_BY_ZERO": DivisionByZeroError,
    "REMAINDER_BY_ZERO": DivisionByZeroError,
    "ARITHMETIC_OVERFLOW": NumericOverflowError,
    "CAST_OVERFLOW": SqlTypeError,
    "CAST_INVALID_INPUT": SqlTypeError,
    "PATH_NOT_FOUND": SourceIOError,
    "MALFORMED_RECORD_IN_PARSING": None,
    "MALFORMED_CSV_RECORD": None,
}
_RAISED = re.compile(r"(TYPE|OVERFLOW|CSV):(?:(\d+):)?([^\n]*)")


def translated(error: PySparkException | Py4JJavaError) -> EngineError | None:
    """The engine's error for one of Spark's, or None if it has no counterpart."""
    text = str(error)
    condition = (error.getCondition() or "").split(".")[0] if isinstance(error, PySparkException) else ""
    if found := _RAISED.search(text):
        kind, line, message = found[1], found[2], found[3].strip().rstrip("'\"")
        message = message.split(" SQLSTATE")[0]
        return CsvError(int(line or 0), message) if kind == "CSV" else RAISED[kind](message)
    for name in (condition, *re.findall(r"\[([A-Z_]+)(?:\.[A-Z_]+)*\]", text)):
        if name in _CONDITIONS:
            kind = _CONDITIONS[name]
            return kind(text.splitlines()[0]) if kind else CsvError(0, "a record has another number of fields than the header")
    return None


@contextmanager
def translating() -> Iterator[None]:
    """Raise the engine's errors in place of Spark's."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as error:
        if (ours := translated(error)) is None:
            raise
        raise ours from error
