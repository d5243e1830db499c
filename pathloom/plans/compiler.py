"""Compiles a syntax tree to Spark columns over a known schema.

A collection is either a nullable scalar (at most one item, which keeps filters, joins and code
generation open to Catalyst) or an array without nulls.  Types are settled here: choice elements, type
tests, units and precisions cost nothing at run time.  What has no column form raises NotCompilable,
and the caller can fall back to the row interpreter.

Errors of single documents (several items where one is due, a division by zero) give an empty result,
or raise with on_error="raise".
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.registry import REGISTRY
from pathloom.functions.scalars import FALSE, TRUE, pattern
from pathloom.plans import units
from pathloom.plans.errors import FunctionNotFoundError, InvalidArgumentsError, InvalidPathError, NotCompilable, PathTypeError
from pathloom.plans.syntax import Node, parse
from pathloom.plans.types import CHOICE_SUFFIXES, EXTENSION_VALUES, STABLE, TEMPORAL, Model, matches
from pathloom.plans.values import FIELDS

LONG, DECIMAL, STRING = T.LongType(), T.DecimalType(38, 18), T.StringType()
#: The date of a text and the time after it.
TEXT_DATE = r"^(\d{4}(?:-\d{2}(?:-\d{2})?)?)((?<=-\d{2}-\d{2})T\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
QUANTITY = T.StructType([T.StructField("value", DECIMAL), T.StructField("unit", STRING)])
KINDS = {T.BooleanType: "Boolean", T.StringType: "String", T.DateType: "Date", T.TimestampType: "DateTime", T.TimestampNTZType: "DateTime"}
#: Functions and operators of one item each, besides the conversions.
SINGLE = frozenset("upper lower length trim startsWith endsWith contains indexOf substring matches replace replaceMatches split toChars abs ceiling floor truncate round sqrt exp ln log power hasValue getValue".split())
SINGLE_OPERATORS = frozenset("= != ~ !~ < <= > >= + - * / div mod &".split())
#: Functions that look at whole objects, so that arrays of structs keep all fields.
WHOLE = frozenset("children descendants distinct isDistinct intersect exclude union combine subsetOf supersetOf toString resolve conformsTo first single last".split())


@dataclass(frozen=True)
class Items:
    """A collection: column c of Spark type data (of one item), its expression type kind, and whether it is an array."""

    kind: str
    own: Column | None  # None: null, made when asked for, as columns need a session
    data: T.DataType
    many: bool = False
    name: str = ""  # document type, where it says more than kind
    raw: Column | None = None  # an array of the source as it stands there

    @property
    def c(self) -> Column:
        return F.lit(None) if self.own is None else self.own

    @property
    def type_name(self) -> str:
        return self.name or self.kind


def replace(x, **changes):
    """dataclasses.replace, with c for the column of Items."""
    if "c" in changes:
        changes["own"] = changes.pop("c")
        changes.setdefault("raw", None)
    return dataclasses.replace(x, **changes)


EMPTY = Items("Empty", None, T.NullType())


@dataclass(frozen=True)
class Scope:
    root: Items
    this: Items
    index: Column | None = None
    total: Items | None = None


@dataclass
class Settings:
    model: Model | None = None
    variables: dict[str, Items] = field(default_factory=dict)
    spec: bool = False
    on_error: str = "null"
    limit: int = 0
    resource_type: str = ""
    null_elements: bool = True
    member_of: Callable[[str, Items], Column] | None = None


class SeveralTypes(NotCompilable):
    """A choice element whose fields have different types, of which a document has one.

    A type test picks one; what takes a single item is compiled for each of them.  Where there may be
    several elements, pick gives the choices of the first, the last or the only one.
    """

    def __init__(self, name: str, choices: list[Items], pick: Callable[[str], list[Items]] | None = None) -> None:
        super().__init__(f"{name} is of several types")
        self.name, self.choices, self.pick = name, choices, pick

    def single(self, which: str = "only") -> list[Items]:
        return self.pick(which) if self.pick else self.choices


def of(data: T.DataType, c: Column, name: str = "", nulls: bool = True) -> Items:
    """A column by its Spark type.  Arrays lose null elements (unless nulls says that there are none); inner arrays are flattened."""
    if isinstance(data, T.ArrayType):
        inner = data.elementType
        if isinstance(inner, T.ArrayType):
            return of(inner, F.flatten(F.filter(F.coalesce(c, F.array().cast(data)), lambda x: x.isNotNull())), name, nulls)
        one, raw = of(inner, c, name, nulls), c
        c = F.coalesce(c, F.array().cast(data))
        if data.containsNull and (nulls or not isinstance(inner, T.StructType)):
            c = F.filter(c, lambda x: x.isNotNull())
        return replace(one, c=c, many=True, raw=raw)
    if isinstance(data, T.IntegralType):
        return Items("Integer", c, data, name=name)
    if isinstance(data, (T.DecimalType, T.FractionalType)):
        return Items("Decimal", c, data, name=name)
    if isinstance(data, T.StructType):
        return Items("Object", c, data, name=name or object_type(data))
    if type(data) in KINDS:
        kind = KINDS[type(data)]
        if kind == "String" and name.lower() in TEMPORAL:
            kind = TEMPORAL[name.lower()]
        return Items(kind, c, data, name=name if kind == "String" else "")
    raise NotCompilable(f"no expression type for {data.simpleString()}")


def object_type(data: T.StructType) -> str:
    """The type that a struct's fields show."""
    f = set(data.fieldNames())
    if "value" in f and f & {"unit", "code", "system"}:
        return "Quantity"
    for name, test in (("Coding", {"system", "code"} <= f), ("CodeableConcept", "coding" in f), ("Reference", "reference" in f), ("Period", bool(f & {"start", "end"})), ("Range", bool(f & {"low", "high"})), ("Ratio", bool(f & {"numerator", "denominator"})), ("Attachment", "contentType" in f), ("HumanName", bool(f & {"family", "given"})), ("Address", bool(f & {"city", "line"}))):
        if test:
            return name
    return "Object"


def array(x: Items) -> Items:
    """x as an array."""
    if x.many:
        return x
    if x.kind == "Empty":
        return replace(x, c=F.array(), many=True)
    return replace(x, c=F.filter(F.array(x.c), lambda v: v.isNotNull()), many=True)


def names(node: Node, out: set[str] | None = None, calls: set[str] | None = None) -> tuple[set[str], set[str]]:
    """All member names and all function names of a tree."""
    out, calls = (set() if out is None else out), (set() if calls is None else calls)
    if node.kind == "member":
        out.add(node.value)
    if node.kind == "call":
        calls.add(node.value)
    if node.kind == "binary" and node.value in ("=", "!=", "~", "!~", "|", "in", "contains"):
        calls.add("=")
    for p in node.parts:
        names(p, out, calls)
    return out, calls


class Compiler:
    def __init__(self, settings: Settings, used: set[str] | None = None) -> None:
        self.settings, self.used = settings, used

    # helpers

    def fail(self, message: str, data: T.DataType) -> Column:
        if self.settings.on_error == "raise":
            return F.raise_error(F.lit(message)).cast(data)
        return F.lit(None).cast(data)

    def one(self, x: Items) -> Items:
        """The only item; more are an error."""
        if not x.many:
            return x
        n = F.size(x.c)
        return replace(x, c=F.when(n == 1, F.try_element_at(x.c, F.lit(1))).when(n > 1, self.fail("one item is expected", x.data)), many=False)

    def head(self, x: Items) -> Items:
        """The first item."""
        return replace(x, c=F.try_element_at(x.c, F.lit(1)), many=False) if x.many else x

    def truth(self, x: Items) -> Column:
        """The first item if it is Boolean, else null."""
        return self.head(x).c if x.kind == "Boolean" else F.lit(None).cast("boolean")

    def sure(self, x: Items) -> Column:
        return F.coalesce(self.truth(x), F.lit(False))

    def has(self, x: Items) -> Column:
        return F.lit(False) if x.kind == "Empty" else F.size(x.c) > 0 if x.many else x.c.isNotNull()

    @staticmethod
    def boolean(c: Column) -> Items:
        return Items("Boolean", c, T.BooleanType())

    @staticmethod
    def integer(c: Column) -> Items:
        return Items("Integer", c.cast("bigint"), LONG)

    @staticmethod
    def string(c: Column) -> Items:
        return Items("String", c, STRING)

    @staticmethod
    def decimal(c: Column, data: T.DataType = DECIMAL) -> Items:
        return Items("Decimal", c.cast(data), data)

    def run(self, node: Node, scope: Scope) -> Items:
        return getattr(self, "_" + node.kind)(node, scope)

    # terms

    def _literal(self, node: Node, scope: Scope) -> Items:
        kind, v = node.value
        if kind == "empty":
            return EMPTY
        if kind == "boolean":
            return self.boolean(F.lit(v))
        if kind == "string":
            return self.string(F.lit(v))
        if kind == "number":
            if "." not in v and int(v) < 2**63:
                return self.integer(F.lit(int(v)))
            whole, _, digits = v.partition(".")
            data = T.DecimalType(min(38, max(1, len(whole) + len(digits))), min(18, len(digits)))
            return Items("Decimal", F.lit(v).cast(data), data)
        if kind == "quantity":
            return Items("Quantity", F.struct(F.lit(v[0]).cast(DECIMAL).alias("value"), F.lit(v[1]).alias("unit")), QUANTITY, name=f"unit:{v[1]}")
        if kind == "date":
            return Items("Date", F.lit(v).cast("date"), T.DateType()) if len(v) == 10 else Items("Date", F.lit(v), STRING)
        if kind == "time":
            return Items("Time", F.lit(v), STRING)
        if v.endswith("Z") or v[-6:-5] in ("+", "-"):
            return Items("DateTime", F.lit(v).cast("timestamp"), T.TimestampType())
        return Items("DateTime", F.lit(v + "Z").cast("timestamp"), T.TimestampType(), name=f"precision:{3 + v.count(':') + 1 + ('.' in v)}")

    def _dollar(self, node: Node, scope: Scope) -> Items:
        if node.value == "$this":
            return scope.this
        if node.value == "$index":
            return self.integer(F.lit(0) if scope.index is None else scope.index)
        return scope.total or EMPTY

    def _variable(self, node: Node, scope: Scope) -> Items:
        if node.value in self.settings.variables:
            return self.settings.variables[node.value]
        if node.value in ("resource", "rootResource", "context"):
            return scope.root
        if node.value == "ucum":
            return self.string(F.lit("http://unitsofmeasure.org"))
        raise InvalidPathError(f"%{node.value} isn't defined")

    def _member(self, node: Node, scope: Scope) -> Items:
        return self.member(scope.this, node.value)

    def member(self, x: Items, name: str) -> Items:
        if x.kind == "Empty" or not isinstance(x.data, T.StructType):
            return EMPTY
        model = self.settings.model
        if name[:1].isupper() and name not in x.data.fieldNames():
            own = x.name if x.name not in ("", "Object") else self.settings.resource_type
            if "resourceType" in x.data.fieldNames() and not self.settings.resource_type:
                kind = (lambda c: c.getField("resourceType"))
                test = (lambda c: kind(c) == name) if name != "Resource" and name != "DomainResource" else (lambda c: kind(c).isNotNull() & ~kind(c).isin("Bundle", "Binary", "Parameters")) if name == "DomainResource" else (lambda c: kind(c).isNotNull())
                return replace(x, c=F.filter(x.c, test) if x.many else F.when(test(x.c), x.c))
            if own in ("", "Object", name) or matches(own, name, model):
                return x
            return EMPTY
        fields, path = x.data.fieldNames(), f"{x.name}.{name}"
        if model:
            path = model.resolve_path.get(path, path)
        if name in fields:
            return self.field(x, name, (model.type_of.get(path) or "") if model else "")
        choices = [c[:1].upper() + c[1:] for c in (model.choice_types.get(path, []) if model else CHOICE_SUFFIXES)]
        found = [self.field(x, name + c, c) for c in choices if name + c in fields]
        if not found:
            return EMPTY
        if len(found) == 1:
            return found[0]
        if not x.many and len({(f.kind, str(f.data), f.many) for f in found}) == 1 and not found[0].many:
            return replace(found[0], c=F.coalesce(*[f.c for f in found]))
        raise self.several(x, name, {f.name: k for f, k in self.choice_fields(x, name, choices)})

    @staticmethod
    def choice_fields(x: Items, name: str, choices: list[str]) -> list[tuple[T.StructField, str]]:
        return [(x.data[name + c], c) for c in choices if name + c in x.data.fieldNames()]

    def several(self, x: Items, name: str, fields: dict[str, str]) -> SeveralTypes:
        """x's fields (with their document types) as the choices of one element."""

        def found(y: Items) -> list[Items]:
            return [self.field(y, f, kind) for f, kind in fields.items()]

        if not x.many:
            return SeveralTypes(name, found(x))

        def pick(which: str) -> list[Items]:
            some = F.filter(x.c, lambda e: F.coalesce(*[F.when(e.getField(f).isNotNull(), F.lit(True)) for f in fields], F.lit(False)))
            if which == "only":
                return found(self.one(replace(x, c=some)))
            return found(replace(x, c=F.try_element_at(some, F.lit(1 if which == "first" else -1)), many=False))

        return SeveralTypes(name, found(x), pick)

    def for_each_choice(self, name: str, choices: list[Items], run: Callable[[Items], Items]) -> Items:
        """What run gives for the choice that a document has, if its results are of one type; a choice that run doesn't take fails."""
        if any(x.many for x in choices):
            raise SeveralTypes(name, choices)
        results: list[tuple[Column, Items | None]] = []
        for x in choices:
            try:
                results.append((self.has(x), run(x)))
            except PathTypeError:
                results.append((self.has(x), None))
        known = [r for _, r in results if r is not None and r.kind != "Empty"]
        if not known:
            if any(r is not None for _, r in results):
                return EMPTY
            raise PathTypeError(f"no type of {name} is taken here")
        if len({(r.kind, str(r.data), r.many) for r in known}) > 1:
            if any(r.many for r in known):
                raise SeveralTypes(name, known)
            raise SeveralTypes(name, [replace(r, c=F.when(has, r.c)) for has, r in results if r is not None and r.kind != "Empty"])
        # a document without any choice has what an empty one of a taken type gives
        shape = known[0]
        none = F.array().cast(T.ArrayType(shape.data)) if shape.many else F.lit(None).cast(shape.data)
        c = None
        for has, r in results:
            value = none if r is not None and r.kind == "Empty" else r.c if r is not None else none if shape.many else self.fail("a type that isn't taken here", shape.data)
            c = F.when(has, value) if c is None else c.when(has, value)
        names_ = {r.name for r in known}
        return replace(shape, c=c.otherwise(shape.c), name=shape.name if len(names_) == 1 else "")

    def field(self, x: Items, name: str, document_type: str) -> Items:
        data = x.data[name].dataType
        nulls = self.settings.null_elements
        return of(T.ArrayType(data) if x.many else data, x.c.getField(name), document_type, nulls)

    def prune(self, x: Items) -> Items:
        """An array of structs with the fields that the expression names, so that the scan reads no others.

        A null element would become a struct of nulls, so this needs null_elements=False.
        """
        if not (x.many and isinstance(x.data, T.StructType) and self.used is not None and x.raw is not None and not self.settings.null_elements):
            return x
        kept = [f for f in x.data.fields if f.name in self.used or any(f.name.startswith(u) for u in self.used)]
        if not kept or len(kept) == len(x.data.fields):
            return x
        data = T.StructType(kept)
        return replace(x, c=F.coalesce(F.arrays_zip(*[x.raw.getField(f.name).alias(f.name) for f in kept]), F.array().cast(T.ArrayType(data))), data=data)

    def _path(self, node: Node, scope: Scope) -> Items:
        step = node.parts[1]
        try:
            base = self.run(node.parts[0], scope)
        except SeveralTypes as e:
            if step.kind == "call" and step.value in ("ofType", "as", "is") and len(step.parts) == 1:
                return self.choose(step.value, e.choices, step.parts[0].text)
            if step.kind == "call" and step.value in ("exists", "empty") and not step.parts:
                some = F.lit(False)
                for x in e.choices:
                    some = some | self.has(x)
                return self.boolean(some if step.value == "exists" else ~some)
            if step.kind == "call" and step.value in ("first", "last") and not step.parts:
                raise SeveralTypes(e.name, e.single(step.value)) from None
            if step.kind == "call" and step.value == "count" and e.pick:
                total = F.lit(0)
                for x in e.choices:
                    total = total + F.size(x.c)
                return self.integer(total)
            if step.kind == "member" and e.pick:
                found = [f for f in (self.run(step, replace(scope, this=x)) for x in e.choices) if f.kind != "Empty"]
                if len(found) > 1:
                    raise
                return found[0] if found else EMPTY
            if e.pick and not (step.kind == "call" and (step.value in SINGLE or step.value.startswith(("to", "convertsTo")))):
                raise
            return self.for_each_choice(e.name, e.single(), lambda x: self.run(step, replace(scope, this=x)))
        if step.kind == "call" and step.value in ("where", "select", "exists", "all", "aggregate") and node.parts[0].kind in ("member", "path"):
            base = self.prune(base)
        return self.run(step, replace(scope, this=base))

    def _index(self, node: Node, scope: Scope) -> Items:
        x, i = self.run(node.parts[0], scope), self.run(node.parts[1], scope)
        if i.kind == "Empty" or x.kind == "Empty":
            return EMPTY
        if i.kind != "Integer":
            raise PathTypeError("an index is an Integer")
        n = self.head(i).c
        return replace(x, c=F.when(n >= 0, F.try_element_at(x.c, (n + 1).cast("int"))), many=False) if x.many else replace(x, c=F.when(n == 0, x.c))

    # operators

    def _unary(self, node: Node, scope: Scope) -> Items:
        x = self.one(self.run(node.parts[0], scope))
        if x.kind == "Empty" or node.value == "+":
            return x
        if x.kind not in ("Integer", "Decimal"):
            raise PathTypeError(f"can't negate {x.kind}")
        return replace(x, c=-x.c)

    def choose(self, op: str, choices: list[Items], wanted: str) -> Items:
        """A type test on a choice element of several types."""
        if op == "is":
            answers = [F.when(self.has(x), self.type_test("is", x, wanted).c) for x in choices]
            return self.boolean(F.coalesce(*answers))
        kept = [k for k in (self.type_test("as", x, wanted) for x in choices) if k.kind != "Empty"]
        if len(kept) > 1:
            raise SeveralTypes(wanted, kept)
        return kept[0] if kept else EMPTY

    def _type(self, node: Node, scope: Scope) -> Items:
        try:
            return self.type_test(node.value, self.run(node.parts[0], scope), node.parts[1].value)
        except SeveralTypes as e:
            return self.choose(node.value, e.choices, node.parts[1].value)

    def type_test(self, op: str, x: Items, wanted: str) -> Items:
        if x.kind == "Empty":
            return EMPTY
        resource = isinstance(x.data, T.StructType) and "resourceType" in x.data.fieldNames()
        if resource:
            bare = wanted.rsplit(".", 1)[-1]
            model = self.settings.model

            def test(c: Column) -> Column:
                kind = c.getField("resourceType")
                if bare == "Resource":
                    return kind.isNotNull()
                if bare == "DomainResource":
                    return kind.isNotNull() & ~kind.isin("Bundle", "Binary", "Parameters")
                below = [k for k in model.parent_type if model.is_subtype(k, bare)] if model else []
                return F.coalesce(F.lower(kind) == bare.lower(), F.lit(False)) | (kind.isin(*below) if below else F.lit(False))
        else:
            known = x.name if x.kind in ("String", "Object") and x.name else x.kind
            answer = matches(known, wanted, self.settings.model) or (x.kind != "Object" and known == x.kind and STABLE.get(wanted.lower()) == x.kind)

            def test(c: Column) -> Column:
                return F.lit(answer)

        if op == "is":
            return self.boolean(F.when(self.has(x), test(self.one(x).c)))
        if not resource:
            return x if answer else EMPTY
        return replace(x, c=F.filter(x.c, test)) if x.many else replace(x, c=F.when(test(x.c), x.c))

    def _binary(self, node: Node, scope: Scope) -> Items:
        op, sides = node.value, []
        for k, p in enumerate(node.parts):
            try:
                sides.append(self.run(p, scope))
            except SeveralTypes as e:
                if op not in SINGLE_OPERATORS:
                    raise
                other = node.parts[1 - k]
                return self.for_each_choice(e.name, e.single(), lambda x, k=k, other=other: self.operate(op, *((x, self.run(other, scope)) if k == 0 else (self.run(other, scope), x))))
        return self.operate(op, *sides)

    def operate(self, op: str, a: Items, b: Items) -> Items:
        if op in ("and", "or", "xor", "implies"):
            x, y = self.truth(a), self.truth(b)
            if op == "and":
                return self.boolean(x & y)
            if op == "or":
                return self.boolean(x | y)
            if op == "xor":
                return self.boolean(x != y)
            if a.kind in ("Boolean", "Empty") and b.kind in ("Boolean", "Empty"):
                return self.boolean(~x | y)
            return self.boolean(F.when(F.coalesce(x == F.lit(False), F.lit(False)) | F.coalesce(y, F.lit(False)), F.lit(True)).when(self.has(a) & self.has(b), F.lit(False)))
        if op == "|":
            return self.union(a, b)
        if op in ("in", "contains"):
            items, x = (b, a) if op == "in" else (a, b)
            x = self.one(x)
            if x.kind == "Empty":
                return self.boolean(F.lit(None))
            return self.boolean(F.when(x.c.isNotNull(), self.among(x, array(items))))
        if op == "&":
            return self.string(F.concat(*[F.coalesce(self.head(x).c, F.lit("")) if x.kind == "String" else F.lit("") for x in (a, b)]))
        if op in ("=", "!=", "~", "!~"):
            if op in ("~", "!~"):
                return self.equivalent(a, b, op == "~")
            lonely = [replace(x, c=F.when(F.size(x.c) == 1, F.try_element_at(x.c, F.lit(1))), many=False) if x.many else x for x in (a, b)]
            if any(x.kind == "Empty" for x in lonely):
                return self.boolean(F.lit(None))
            same = self.equal(*lonely)
            both = lonely[0].c.isNotNull() & lonely[1].c.isNotNull()
            same = F.when(both, F.lit(False)) if same is None else same
            return self.boolean(same if op == "=" else ~same)
        a, b = self.one(a), self.one(b)
        if a.kind == "Empty" or b.kind == "Empty":
            return EMPTY
        return self.order(op, a, b) if op in ("<", "<=", ">", ">=") else self.arithmetic(op, a, b)

    # equality and order

    def numbers(self, a: Items, b: Items) -> tuple[Column, Column]:
        """Two numbers of one Spark type: bigint, decimal or, with a double, double."""
        if a.kind == b.kind == "Integer":
            return a.c.cast("bigint"), b.c.cast("bigint")
        if any(isinstance(x.data, (T.DoubleType, T.FloatType)) for x in (a, b)):
            return a.c.cast("double"), b.c.cast("double")
        return tuple(x.c.cast(T.DecimalType(20, 0)) if x.kind == "Integer" else x.c for x in (a, b))

    def equal(self, a: Items, b: Items) -> Column | None:
        """a = b with nulls for empty, or None if they can't be equal."""
        if {a.kind, b.kind} <= {"Integer", "Decimal"}:
            x, y = self.numbers(a, b)
            return x == y
        if a.kind != b.kind:
            return None
        if a.kind == "Quantity":
            return self.quantities(a, b, lambda x, y: x == y, F.lit(False))
        if a.kind in ("Date", "DateTime", "Time"):
            less, same, _ = self.instants(a, b)
            return F.when(a.c.isNotNull() & b.c.isNotNull(), F.coalesce(same, F.lit(False)))
        if a.kind == "Object":
            return F.to_json(a.c) == F.to_json(b.c) if a.data != b.data else a.c == b.c
        return a.c == b.c

    def among(self, x: Items, items: Items) -> Column:
        if items.kind == "Empty":
            return F.lit(False)
        if x.kind == items.kind and x.kind not in ("Quantity", "DateTime", "Date", "Time", "Decimal") and x.data == items.data:
            return F.array_contains(items.c, x.c)
        if self.equal(x, replace(items, many=False)) is None:
            return F.lit(False)
        return F.exists(items.c, lambda y: F.coalesce(self.equal(x, replace(items, c=y, many=False)), F.lit(False)))

    def equivalent(self, a: Items, b: Items, wanted: bool) -> Items:
        if a.kind == "Empty" or b.kind == "Empty":
            none = ~self.has(a) & ~self.has(b)
            return self.boolean(none if wanted else ~none)
        few = F.lit(True)
        for x in (a, b):
            if x.many:
                few = few & (F.size(x.c) <= 1)
        a1, b1 = self.head(a), self.head(b)
        if a.kind == b.kind == "String":
            norm = lambda c: F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), " +", " ")
            same = norm(a1.c) == norm(b1.c)
        elif a.kind == b.kind == "Quantity":
            same = self.quantities(a1, b1, lambda x, y: F.abs(x - y) <= F.lit(1e-10) * F.greatest(F.abs(x), F.abs(y)), F.lit(False), real=True)
        else:
            same = self.equal(a1, b1)
            same = F.lit(False) if same is None else same
        none = a1.c.isNull() & b1.c.isNull()
        yes = few & (none | F.coalesce(same & a1.c.isNotNull() & b1.c.isNotNull(), F.lit(False)))
        return self.boolean(yes if wanted else ~yes)

    def unit_of(self, x: Items) -> str | None:
        return x.name.removeprefix("unit:") if x.name.startswith("unit:") else None

    def normal(self, x: Items, beside: Items | None = None) -> tuple[Column, Column]:
        """Value (double) and unit in the canonical unit.

        If the unit beside it is known, only units of that dimension matter.
        """
        unit, value = x.c.getField("unit"), x.c.getField("value").cast("double")
        known = self.unit_of(x)
        if known is not None:
            return value * F.lit(units.factor(known)), F.lit(units.canonical(known))
        table = {**{u.lower(): r for u, r in reversed(units.UNITS.items())}, **units.UNITS}
        other = self.unit_of(beside) if beside is not None else None
        if other is not None:
            table = {u: r for u, r in table.items() if r[0] == units.canonical(other)}
        if not table:
            return value, unit
        factors = F.create_map(*[F.lit(v) for u, r in table.items() for v in (u, r[1])])
        canon = F.create_map(*[F.lit(v) for u, r in table.items() for v in (u, r[0])])
        pick = lambda m, d: F.coalesce(F.try_element_at(m, unit), F.try_element_at(m, F.lower(unit)), d)
        return value * pick(factors, F.lit(1.0)), pick(canon, unit)

    def quantities(self, a: Items, b: Items, test: Callable[[Column, Column], Column], apart: Column, real: bool = False) -> Column:
        """test on the values if the units are equal or one is empty, else on the normal values; apart where those units differ."""
        u, v = (F.coalesce(x.c.getField("unit"), F.lit("")) for x in (a, b))
        x, y = ((q.c.getField("value").cast("double") if real else q.c.getField("value")) for q in (a, b))
        (p, s), (q, t) = self.normal(a, b), self.normal(b, a)
        plain = (F.lower(u) == F.lower(v)) if real else (u == v)
        known = F.when(plain | (u == "") | (v == ""), test(x, y)).when(s == t, test(p, q)).otherwise(apart)
        return F.when(a.c.isNotNull() & b.c.isNotNull(), known)

    def text(self, x: Items) -> Column:
        """A Date or Time in its written form, which sorts by time."""
        return F.date_format(x.c, "yyyy-MM-dd") if isinstance(x.data, T.DateType) else x.c

    def instants(self, a: Items, b: Items) -> tuple[Column, Column, Column]:
        """a < b, a = b, a > b; null where precision leaves it open (a = b: false there)."""
        if a.kind == "DateTime":
            x, y = a.c.cast("timestamp"), b.c.cast("timestamp")
            p = [int(q.name.removeprefix("precision:")) if q.name.startswith("precision:") else 0 for q in (a, b)]
            if any(p) and p[0] != p[1]:
                unit = FIELDS[min(k for k in p if k) - 1]
                x, y = F.date_trunc(unit, x), F.date_trunc(unit, y)
                return F.when(x != y, x < y), F.lit(False), F.when(x != y, x > y)
            return x < y, x == y, x > y
        if isinstance(a.data, T.DateType) and isinstance(b.data, T.DateType):
            return a.c < b.c, a.c == b.c, a.c > b.c
        s, t = self.text(a), self.text(b)
        n = F.least(F.length(s), F.length(t))
        x, y = F.substring(s, F.lit(1), n), F.substring(t, F.lit(1), n)
        open_ = (x == y) & (F.length(s) != F.length(t))
        return F.when(~open_, x < y), s == t, F.when(~open_, x > y)

    def order(self, op: str, a: Items, b: Items) -> Items:
        run = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        a, b = (self.as_quantity(x) if "Quantity" in (a.kind, b.kind) or (x.kind == "Object" and x.name == "Quantity") else x for x in (a, b))
        if {a.kind, b.kind} <= {"Integer", "Decimal"}:
            return self.boolean(run(*self.numbers(a, b)))
        if a.kind != b.kind or a.kind in ("Object", "Boolean"):
            raise PathTypeError(f"can't compare {a.type_name} with {b.type_name}")
        if a.kind == "String":
            return self.boolean(run(a.c, b.c))
        if a.kind == "Quantity":
            return self.boolean(self.quantities(a, b, run, self.fail("units differ", T.BooleanType())))
        less, same, more = self.instants(a, b)
        found = {"<": less, "<=": less | same, ">": more, ">=": more | same}[op]
        return self.boolean(F.when(a.c.isNotNull() & b.c.isNotNull(), found))

    def as_quantity(self, x: Items) -> Items:
        """An object with a value and a unit or code as Quantity."""
        if x.kind == "Object" and isinstance(x.data, T.StructType) and "value" in x.data.fieldNames():
            unit = [x.c.getField(f) for f in ("unit", "code") if f in x.data.fieldNames()]
            value = x.c.getField("value")
            return Items("Quantity", F.when(value.isNotNull(), F.struct(value.cast(DECIMAL).alias("value"), F.coalesce(*unit, F.lit("")).alias("unit"))), QUANTITY)
        return x

    # arithmetic

    def arithmetic(self, op: str, a: Items, b: Items) -> Items:
        if {a.kind, b.kind} <= {"Integer", "Decimal"}:
            return self.number_arithmetic(op, a, b)
        if op == "+" and a.kind == b.kind == "String":
            return self.string(F.concat(a.c, b.c))
        if op in ("+", "-") and b.kind == "Quantity":
            unit = self.unit_of(b)
            if unit is not None and (a.kind in ("Date", "DateTime") or (a.kind == "String" and unit.removesuffix("s") in (*FIELDS, "week"))):
                return self.shifted(a, F.try_element_at(F.array(b.c.getField("value").cast("bigint")), F.lit(1)) * (1 if op == "+" else -1), unit)
            if a.kind == "Quantity":
                u, v = (F.coalesce(x.c.getField("unit"), F.lit("")) for x in (a, b))
                x, y = a.c.getField("value"), b.c.getField("value")
                total = F.struct((x + y if op == "+" else x - y).cast(DECIMAL).alias("value"), F.when(u == "", v).otherwise(u).alias("unit"))
                return Items("Quantity", F.when((u == v) | (u == "") | (v == ""), total).when(a.c.isNotNull() & b.c.isNotNull(), self.fail("units differ", QUANTITY)), QUANTITY)
        raise PathTypeError(f"{op} doesn't take {a.type_name} and {b.type_name}")

    def number_arithmetic(self, op: str, a: Items, b: Items) -> Items:
        x, y = self.numbers(a, b)
        whole, real = a.kind == b.kind == "Integer", any(isinstance(q.data, (T.DoubleType, T.FloatType)) for q in (a, b))
        if op in ("div", "mod"):
            if not whole:
                raise PathTypeError(f"{op} takes Integers")
            zero = F.when(y == 0, self.fail("division by zero", LONG))
            safe = F.when(y != 0, y)
            return self.integer(zero.otherwise(F.call_function("div", x, safe) if op == "div" else x % safe))
        if op == "/":
            if real:
                return Items("Decimal", F.when(y != 0, x / F.when(y != 0, y)).when(y == 0, self.fail("division by zero", T.DoubleType())), T.DoubleType())
            scale = 0 if b.kind == "Integer" else b.data.scale
            left = x.cast(T.DecimalType(38 - scale, 16))
            return self.decimal(F.when(y != 0, F.try_divide(left, F.when(y != 0, y))).when(y == 0, self.fail("division by zero", DECIMAL)), T.DecimalType(38, 16))
        run = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        if whole:
            return self.integer(run(x, y))
        if real:
            return Items("Decimal", run(x, y), T.DoubleType())
        (p, s), (q, t) = ((20, 0) if i.kind == "Integer" else (i.data.precision, i.data.scale) for i in (a, b))
        if op == "*":
            digits, scale = p + q + 1, s + t
        else:
            scale = max(s, t)
            digits = max(p - s, q - t) + scale + 1
        if digits > 38:  # as Spark: whole digits first, six places at least
            scale = max(38 - (digits - scale), min(scale, 6))
        return self.decimal(run(x, y), T.DecimalType(min(digits, 38), scale))

    def shifted(self, a: Items, n: Column, unit: str) -> Items:
        """A Date or DateTime n calendar units later; days that a month lacks run over into the next one."""
        unit = "millisecond" if unit == "ms" else unit.removesuffix("s")
        if isinstance(a.data, T.StringType):
            return self.shifted_text(a, n, unit)
        day = a.c.cast("date")
        if unit in ("month", "year"):
            first = F.add_months(F.trunc(day, "month"), (n * (12 if unit == "year" else 1)).cast("int"))
            moved = F.date_add(first, F.dayofmonth(day) - 1)
        elif unit in ("day", "week"):
            moved = F.date_add(day, (n * (7 if unit == "week" else 1)).cast("int"))
        elif a.kind == "DateTime" and unit in FIELDS:
            return replace(a, c=F.timestamp_micros(F.unix_micros(a.c.cast("timestamp")) + n * {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000}[unit]), data=T.TimestampType())
        else:
            return a
        if a.kind == "Date":
            return replace(a, c=moved)
        rest = F.unix_micros(a.c.cast("timestamp")) - F.unix_micros(F.date_trunc("day", a.c.cast("timestamp")))
        return replace(a, c=F.timestamp_micros(F.unix_micros(moved.cast("timestamp")) + rest), data=T.TimestampType())

    def shifted_text(self, a: Items, n: Column, unit: str) -> Items:
        """A date as text (of a year, a month or a day), or a date and time, n units later, as precise as it was; other text fails."""
        if unit not in ("year", "month", "week", "day"):
            if a.kind == "Date":
                return a
            raise NotCompilable("times of day as text")
        date, rest = F.regexp_extract(a.c, TEXT_DATE, 1), F.regexp_extract(a.c, TEXT_DATE, 2)
        january = F.concat(F.substring(date, 1, 4), F.lit("-01-01")).try_cast("date")
        month, day = (F.coalesce(F.substring(date, at, 2).try_cast("int"), F.lit(1)) for at in (6, 9))
        months, days = (n * (12 if unit == "year" else 1), 0) if unit in ("month", "year") else (0, n * (7 if unit == "week" else 1))
        moved = F.date_add(F.add_months(january, (month - 1 + months).cast("int")), (day - 1 + days).cast("int"))
        text = F.concat(F.substring(F.date_format(moved, "yyyy-MM-dd"), F.lit(1), F.length(date)), rest)
        # only months run over into other years
        able = F.year(moved).between(1, 9999) & (F.lit(unit == "month") | month.between(1, 12))
        known = F.when(a.c.isNotNull() & (date == ""), self.fail("text that isn't a date", STRING)).when(able, text).otherwise(a.c)
        return Items("Date" if a.kind == "String" else a.kind, known, STRING)

    # sets

    def together(self, a: Items, b: Items) -> tuple[Items, Items]:
        """Two arrays of one type."""
        if a.kind == "Empty":
            a = replace(b, c=F.array().cast(T.ArrayType(b.data)), many=True)
        if b.kind == "Empty":
            b = replace(a, c=F.array().cast(T.ArrayType(a.data)), many=True)
        a, b = array(a), array(b)
        if a.data != b.data:
            if {a.kind, b.kind} <= {"Integer", "Decimal"}:
                data = LONG if a.kind == b.kind == "Integer" else DECIMAL
                a, b = (replace(x, kind="Decimal" if data is DECIMAL else "Integer", data=data, c=F.transform(x.c, lambda v: v.cast(data))) for x in (a, b))
            elif a.kind == b.kind == "Date":
                a, b = (replace(x, data=STRING, c=F.transform(x.c, lambda v, x=x: self.text(replace(x, c=v)))) for x in (a, b))
            else:
                raise NotCompilable(f"a collection of {a.type_name} and {b.type_name}")
        return a, b

    def distinct(self, x: Items) -> Items:
        if not x.many:
            return x
        if x.kind == "Quantity":
            raise NotCompilable("distinct quantities")
        return replace(x, c=F.array_distinct(x.c))

    def union(self, a: Items, b: Items) -> Items:
        if a.kind == b.kind == "Empty":
            return EMPTY
        a, b = self.together(a, b)
        return replace(a, c=F.concat(a.c, self.distinct(replace(b, c=F.filter(b.c, lambda y: ~self.among(replace(b, c=y, many=False), a)))).c))

    # calls

    def _call(self, node: Node, scope: Scope) -> Items:
        f = REGISTRY.get(node.value)
        if f is None:
            raise FunctionNotFoundError(f"there is no function {node.value}", path=node.value)
        if not f.least <= len(node.parts) <= f.most:
            raise InvalidArgumentsError(f"{node.value} takes {f.least} to {f.most} arguments, not {len(node.parts)}")
        special = getattr(self, "_do_" + node.value, None)
        if special and node.parts:
            return special(scope, *node.parts)
        if f.column is not None:
            return f.column(self, scope.this, *[self.run(p, scope) for k, p in enumerate(node.parts) if k not in f.type_args])
        from pathloom.plans.columns import COLUMNS

        if node.value not in COLUMNS:
            raise NotCompilable(f"{node.value} has no column form")
        return COLUMNS[node.value](self, scope.this, *[self.run(p, scope) for p in node.parts])

    def each(self, scope: Scope, body: Node, c: Column, index: Column | None, total: Items | None = None) -> Items:
        return self.run(body, replace(scope, this=replace(scope.this, c=c, many=False), index=index, total=total or scope.total))

    def guarded(self, x: Items) -> Items:
        if self.settings.limit and x.many:
            return replace(x, c=F.when(F.size(x.c) <= self.settings.limit, x.c).otherwise(F.raise_error(F.lit(f"a collection has over {self.settings.limit} items")).cast(T.ArrayType(x.data))))
        return x

    def _do_where(self, scope: Scope, body: Node) -> Items:
        x = self.guarded(scope.this)
        if x.kind == "Empty":
            return x
        scope = replace(scope, this=x)
        if x.many:
            return replace(x, c=F.filter(x.c, lambda v, i: self.sure(self.each(scope, body, v, i))))
        return replace(x, c=F.when(x.c.isNotNull() & self.sure(self.each(scope, body, x.c, F.lit(0))), x.c))

    def _do_exists(self, scope: Scope, body: Node) -> Items:
        x = scope.this
        if x.kind == "Empty":
            return self.boolean(F.lit(False))
        if not x.many:
            return self.boolean(x.c.isNotNull() & self.sure(self.each(scope, body, x.c, F.lit(0))))
        if _uses_index(body):
            return self.boolean(F.size(self._do_where(scope, body).c) > 0)
        return self.boolean(F.exists(x.c, lambda v: self.sure(self.each(scope, body, v, None))))

    def _do_all(self, scope: Scope, body: Node) -> Items:
        x = scope.this
        if x.kind == "Empty":
            return self.boolean(F.lit(True))

        def test(c: Column, i: Column | None) -> Column:
            found = self.each(scope, body, c, i)
            return self.sure(found) if found.kind == "Boolean" or self.settings.spec else self.has(found)

        if not x.many:
            return self.boolean(F.when(x.c.isNull(), F.lit(True)).otherwise(test(x.c, F.lit(0))))
        if _uses_index(body):
            return self.boolean(F.size(F.filter(x.c, lambda v, i: ~test(v, i))) == 0)
        return self.boolean(F.forall(x.c, lambda v: test(v, None)))

    def _do_select(self, scope: Scope, body: Node) -> Items:
        x = self.guarded(scope.this)
        if x.kind == "Empty":
            return x
        scope = replace(scope, this=x)
        if not x.many:
            found = self.each(scope, body, x.c, F.lit(0))
            return found if found.kind == "Empty" else replace(found, c=F.when(x.c.isNotNull(), found.c).otherwise(F.array().cast(T.ArrayType(found.data)) if found.many else F.lit(None)))
        kind = self.each(scope, body, F.try_element_at(x.c, F.lit(1)), F.lit(0))
        if kind.kind == "Empty":
            return EMPTY
        if body.kind == "dollar" and body.value == "$this":
            return x
        if kind.many:
            return replace(kind, c=F.flatten(F.transform(x.c, lambda v, i: self.each(scope, body, v, i).c)))
        return replace(kind, many=True, c=F.filter(F.transform(x.c, lambda v, i: self.each(scope, body, v, i).c), lambda v: v.isNotNull()))

    def _do_repeat(self, scope: Scope, body: Node) -> Items:
        if self.settings.spec:
            raise NotCompilable("repetition")
        self.run(body, scope)
        return scope.this

    def _do_aggregate(self, scope: Scope, body: Node, start: Node | None = None) -> Items:
        first = self.head(self.run(start, scope)) if start else EMPTY
        x = array(scope.this)
        if x.kind == "Empty":
            return first
        one = replace(scope, this=x)
        result = self.each(one, body, F.try_element_at(x.c, F.lit(1)), F.lit(0), first)
        for _ in range(3):  # the accumulator's type settles
            again = self.each(one, body, F.try_element_at(x.c, F.lit(1)), F.lit(0), replace(result, c=F.lit(None).cast(result.data), many=False))
            if (again.kind, again.data) == (result.kind, result.data):
                break
            result = again if again.kind != "Decimal" else self.decimal(again.c)
        if result.many or result.kind == "Empty":
            raise NotCompilable("an accumulator of several items")
        data = DECIMAL if result.kind == "Decimal" and not isinstance(result.data, T.DoubleType) else result.data
        zero = first.c.cast(data) if first.kind != "Empty" else F.lit(None).cast(data)
        state = lambda c: Items(result.kind, c, data, name=result.name)
        if _uses_index(body):
            pairs = F.transform(x.c, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
            c = F.aggregate(pairs, zero, lambda acc, p: self.each(one, body, p["v"], p["i"], state(acc)).c.cast(data))
        else:
            c = F.aggregate(x.c, zero, lambda acc, v: self.each(one, body, v, None, state(acc)).c.cast(data))
        return state(c)

    def _do_is(self, scope: Scope, name: Node) -> Items:
        return self.type_test("is", scope.this, name.text)

    def _do_as(self, scope: Scope, name: Node) -> Items:
        return self.type_test("as", scope.this, name.text)

    _do_ofType = _do_as  # noqa: N815

    def _do_iif(self, scope: Scope, test: Node, yes: Node, no: Node | None = None) -> Items:
        t, a, b = self.sure(self.run(test, scope)), self.run(yes, scope), self.run(no, scope) if no else EMPTY
        if a.kind == b.kind == "Empty":
            return EMPTY
        if a.many or b.many or (a.data != b.data and "Empty" not in (a.kind, b.kind)):
            a, b = self.together(a, b)
        shape = b if a.kind == "Empty" else a
        return replace(shape, c=F.when(t, a.c).otherwise(b.c))


def _uses_index(node: Node) -> bool:
    return (node.kind == "dollar" and node.value == "$index") or any(map(_uses_index, node.parts))


def compile_tree(node: Node, root: Items, settings: Settings) -> Items:
    used, calls = names(node)
    whole = bool(calls & WHOLE)
    return Compiler(settings, None if whole else used).run(node, Scope(root, root))


def compile_items(expression: str, data: T.DataType, c: Column, settings: Settings | None = None) -> Items:
    """The collection that expression gives on a column c of Spark type data."""
    settings = settings or Settings()
    return compile_tree(parse(expression), of(data, c, settings.resource_type, settings.null_elements), settings)


__all__ = ["EXTENSION_VALUES", "FALSE", "TRUE", "Compiler", "Items", "Settings", "compile_items", "pattern"]
