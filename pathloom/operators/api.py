"""Expressions over DataFrames.

``compile_path`` gives a CompiledPath for a column: a Spark column where the schema allows it.
``evaluate`` adds the result to a DataFrame; documents kept as JSON text without a schema, and what has
no column form, go through the row interpreter in Arrow batches.
"""

from __future__ import annotations

import json
import threading
import uuid
import warnings
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.interpreter import Options, evaluate_json
from pathloom.plans.compiler import Items, Settings, array, compile_items
from pathloom.plans.errors import ExpressionTimeoutError, NotCompilable, PathError, PathTypeError
from pathloom.plans.syntax import Node, parse
from pathloom.plans.types import Model
from pathloom.plans.values import show


@dataclass(frozen=True)
class CompiledPath:
    """An expression compiled for one column."""

    source: str
    items: Items

    def column(self) -> Column:
        """The collection as it is: a nullable scalar, or an array."""
        return self.items.c

    def array(self) -> Column:
        """The collection as an array; empty for an empty one."""
        return array(self.items).c if self.items.kind != "Empty" else F.array().cast("array<string>")

    def exists(self) -> Column:
        i = self.items
        return F.lit(False) if i.kind == "Empty" else F.size(i.c) > 0 if i.many else i.c.isNotNull()

    def count(self) -> Column:
        i = self.items
        return (F.lit(0) if i.kind == "Empty" else F.size(i.c) if i.many else F.when(i.c.isNotNull(), 1).otherwise(0)).cast("bigint")

    def first(self) -> Column:
        return F.try_element_at(self.items.c, F.lit(1)) if self.items.many else self.items.c

    def to_boolean(self) -> Column:
        """The first item; false for an empty collection."""
        return F.coalesce(self.first(), F.lit(False)) if self.items.kind == "Boolean" else F.lit(False)

    def to_string(self) -> Column:
        """The first item as a string; '' for an empty collection."""
        from pathloom.plans.columns import to_text
        from pathloom.plans.compiler import Compiler

        return F.coalesce(to_text(Compiler(Settings()), self.items), F.lit(""))

    def to_strings(self) -> Column:
        from pathloom.plans.columns import to_text
        from pathloom.plans.compiler import Compiler, replace

        if self.items.kind == "Empty":
            return F.array().cast("array<string>")
        k, items = Compiler(Settings()), array(self.items)
        return F.transform(items.c, lambda v: to_text(k, replace(items, c=v, many=False)))

    def apply(self, df: DataFrame, to: str = "result") -> DataFrame:
        return df.withColumn(to, self.column())

    def __str__(self) -> str:
        return self.source


def constant(value: Any) -> Items:
    """A variable's value as a collection."""
    if isinstance(value, Items):
        return value
    kind, data = {bool: ("Boolean", T.BooleanType()), int: ("Integer", T.LongType()), float: ("Decimal", T.DoubleType()), str: ("String", T.StringType())}[type(value)]
    return Items(kind, F.lit(value).cast(data), data)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class ExpressionCache:
    """Compiled paths, least recently used out first, with hits and misses."""

    def __init__(self, limit: int = 1000) -> None:
        self.limit, self.hits, self.misses = limit, 0, 0
        self.kept: OrderedDict[tuple, CompiledPath] = OrderedDict()
        self.makers: dict[tuple, Callable] = {}  # they hold the models, whose ids are in the keys

    def get(self, key: tuple, make: Callable[[], CompiledPath]) -> CompiledPath:
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
            return self.kept[key]
        self.misses += 1
        made = self.kept[key] = make()
        self.makers[key] = make
        while len(self.kept) > self.limit:
            self.makers.pop(self.kept.popitem(last=False)[0], None)
        return made

    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0

    def clear(self) -> None:
        self.kept.clear()
        self.makers.clear()
        self.hits = self.misses = 0


DEFAULT_CACHE = ExpressionCache()


def compile_path(
    expression: str,
    schema: T.DataType,
    col: str | Column | None = None,
    *,
    model: Model | None = None,
    resource_type: str = "",
    variables: dict[str, Any] | None = None,
    spec: bool = False,
    on_error: str = "null",
    max_collection_size: int = 0,
    null_elements: bool = True,
    member_of: Callable | None = None,
    profiles: dict[str, list[str]] | None = None,
    cache: ExpressionCache | None = DEFAULT_CACHE,
) -> CompiledPath:
    """Compiles for a column of that schema (a DataFrame's schema with col=None: its rows are the documents).

    spec asks for the language standard's behaviour where the default keeps that of existing engines.
    on_error: "null" gives an empty result for a document that fails, "raise" fails the query.
    null_elements=False promises that arrays of structs hold no null elements; scans then read only the
    fields of nested arrays that the expression names.
    """
    settings = Settings(model=model, variables={k: constant(v) for k, v in (variables or {}).items()}, spec=spec, on_error=on_error, limit=max_collection_size, resource_type=resource_type, null_elements=null_elements, member_of=member_of)
    if profiles:
        settings.variables["__profiles__"] = {url: [parse(e) for e in tests] for url, tests in profiles.items()}

    def make() -> CompiledPath:
        if col is None:
            c = F.struct(*[F.col(f"`{f}`") for f in schema.fieldNames()])
        else:
            c = F.col(col) if isinstance(col, str) else col
        return CompiledPath(expression, compile_items(expression, schema, c, settings))

    if cache is None or variables or member_of or profiles or isinstance(col, Column):
        return make()
    return cache.get((expression, schema.json(), col, id(model), resource_type, spec, on_error, max_collection_size, null_elements), make)


def must_compile(expression: str, schema: T.DataType, col: str | Column | None = None, **options) -> CompiledPath:
    """compile_path; any failure is a ValueError."""
    try:
        return compile_path(expression, schema, col, **options)
    except (PathError, NotCompilable) as e:
        raise ValueError(f"{expression}: {e}") from e


def interpret(df: DataFrame, expression: str, col: str = "resource", to: str = "result", options: Options | None = None, errors_to: str | None = None) -> DataFrame:
    """df with the collection as an array of strings, evaluated on JSON text by the row interpreter.

    A document that fails gives null; errors_to names a column for the failure.
    """
    parse(expression)  # syntax errors show here, not in a task
    options = options or Options()

    @F.pandas_udf("result array<string>, error string")
    def run(texts):
        import pandas as pd

        results, errors = [], []
        for text in texts:
            try:
                results.append([show(v) for v in evaluate_json(text, expression, options)])
                errors.append(None)
            except PathError as e:
                results.append(None)
                errors.append(f"{e.kind}: {e}")
        return pd.DataFrame({"result": results, "error": pd.Series(errors, dtype=object)})

    path = fresh(df, "path")
    out = df.withColumn(path, run(F.col(col))).withColumn(to, F.col(f"{path}.result"))
    return (out.withColumn(errors_to, F.col(f"{path}.error")) if errors_to else out).drop(path)


def evaluate(df: DataFrame, expression: str, col: str | None = "resource", to: str = "result", *, schema: T.StructType | str | None = None, options: Options | None = None, **compile_options) -> DataFrame:
    """df with the collection that expression gives for each document.

    col names the column of documents (None: the rows).  A struct compiles to a column.  JSON text is
    parsed by schema, if one is given, and compiles too; without schema it goes through the row
    interpreter, with a warning, as does a struct for which the expression has no column form, or text
    that only its value shows to be a date.
    """
    if col is not None and isinstance(df.schema[col].dataType, T.StringType):
        if schema is None:
            return interpret(df, expression, col, to, options)
        name = fresh(df, "parsed")
        parsed = df.withColumn(name, F.from_json(col, schema))
        try:
            return compile_path(expression, parsed.schema[name].dataType, name, **compile_options).apply(parsed, to).drop(name)
        except (NotCompilable, PathTypeError) as e:
            _by_rows(expression, e)
            return interpret(df, expression, col, to, options)
    schema = df.schema if col is None else df.schema[col].dataType
    try:
        return compile_path(expression, schema, col, **compile_options).apply(df, to)
    except (NotCompilable, PathTypeError) as e:
        _by_rows(expression, e)
        name = fresh(df, "document")
        document = F.struct(*[F.col(f"`{f}`") for f in schema.fieldNames()]) if col is None else F.col(col)
        return interpret(df.withColumn(name, F.to_json(document)), expression, name, to, options).drop(name)


def _by_rows(expression: str, why: Exception) -> None:
    """Tell that an expression goes through the row interpreter, whose result is an array of strings."""
    warnings.warn(f"{expression}: {why}; the row interpreter evaluates it and gives an array of strings", stacklevel=3)


def evaluate_many(df: DataFrame, expressions: dict[str, str], col: str | None = "resource", **compile_options) -> DataFrame:
    """df with one column for each named expression; they share one scan."""
    schema = df.schema if col is None else df.schema[col].dataType
    return df.select("*", *[compile_path(e, schema, col, **compile_options).column().alias(n) for n, e in expressions.items()])


def where(df: DataFrame, expression: str, col: str | None = None, **compile_options) -> DataFrame:
    """The rows whose expression is true; plain comparisons reach the scan as pushed filters."""
    schema = df.schema if col is None else df.schema[col].dataType
    path = compile_path(expression, schema, col, **compile_options)
    return df.filter(path.items.c if path.items.kind == "Boolean" and not path.items.many else path.to_boolean())


def traced(df: DataFrame, expression: str, col: str | None = None, **compile_options) -> tuple[DataFrame, Observation]:
    """df with an observation that counts, for each trace('name') of expression, the items that pass it.

    The counts are there once an action on the DataFrame has run.
    """
    schema = df.schema if col is None else df.schema[col].dataType
    counts = []

    def visit(node: Node, base: str) -> None:
        if node.kind == "path":
            visit(node.parts[0], base)
            step = node.parts[1]
            if step.kind == "call" and step.value == "trace" and step.parts and step.parts[0].kind == "literal":
                before = compile_path(node.parts[0].text, schema, col, **compile_options)
                counts.append(F.sum(before.count()).alias(str(step.parts[0].value[1])))

    visit(parse(expression), "")
    observation = Observation("trace")
    return df.observe(observation, F.count(F.lit(1)).alias("documents"), *counts), observation


def within(spark, seconds: float, action: Callable[[], Any]) -> Any:
    """The result of an action whose Spark jobs are cancelled, with an ExpressionTimeoutError, after so many seconds."""
    group, over = f"path-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "path expressions", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    except Exception as e:
        if over.is_set():
            raise ExpressionTimeoutError(f"the jobs took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setJobGroup("", "")


def from_rows(rows: list[dict], spark) -> DataFrame:
    """Python documents as a DataFrame of JSON texts."""
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "resource string")
