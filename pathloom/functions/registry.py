"""Functions of the row interpreter by name.

A function gets the call (interpreter, input collection, argument collections) and returns a collection.
register() adds one from outside; type_args names arguments that are type names and aren't evaluated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int
    run: Callable
    type_args: tuple[int, ...] = ()
    column: Callable | None = None


REGISTRY: dict[str, Function] = {}


def register(name: str, least: int, most: int, run: Callable, type_args: tuple[int, ...] = (), column: Callable | None = None) -> None:
    """column, if given, builds the Spark form: (compiler, input, arguments) to a collection column."""
    REGISTRY[name] = Function(name, least, most, run, type_args, column)


def has(name: str) -> bool:
    return name in REGISTRY


def names() -> list[str]:
    return sorted(REGISTRY)


def function(name: str, least: int = 0, most: int | None = None):
    """Decorator: run(call, items, *arguments)."""

    def add(run: Callable) -> Callable:
        register(name, least, least if most is None else most, run)
        return run

    return add


def unique(items: list, equal) -> list:
    """First of equal items, in order."""
    out: list = []
    for x in items:
        if not any(equal(x, y) for y in out):
            out.append(x)
    return out
