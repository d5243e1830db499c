"""What can go wrong in an expression, at compile time or for one document."""

from __future__ import annotations


class PathError(Exception):
    """kind tells the class of failure; path and position are given where known."""

    kind = "EvaluationError"

    def __init__(self, message: str, path: str | None = None, position: int | None = None) -> None:
        super().__init__(message)
        self.path, self.position = path, position


class ParseError(PathError):
    kind = "ParseError"


class PathTypeError(PathError):
    kind = "TypeError"


class SingletonError(PathError):
    kind = "SingletonError"


class InvalidPathError(PathError):
    kind = "InvalidPathError"


class FunctionNotFoundError(PathError):
    kind = "FunctionNotFoundError"


class InvalidArgumentsError(PathError):
    kind = "InvalidArgumentsError"


class InvalidOperationError(PathError):
    kind = "InvalidOperationError"


class DivisionByZeroError(PathError):
    kind = "DivisionByZeroError"


class ExpressionTimeoutError(PathError):
    kind = "TimeoutError"


class CollectionSizeError(PathError):
    kind = "CollectionSizeError"


class NotCompilable(Exception):
    """The expression has no column form over this schema; the row interpreter can run it."""
