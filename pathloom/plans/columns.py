"""Functions as Spark columns: (compiler, input, arguments) to a collection."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.scalars import FALSE, TRUE, pattern
from pathloom.plans import units
from pathloom.plans.compiler import DECIMAL, EMPTY, EXTENSION_VALUES, LONG, QUANTITY, STRING, Compiler, Items, array, of, replace
from pathloom.plans.errors import InvalidArgumentsError, NotCompilable
from pathloom.plans.values import FIELDS

COLUMNS: dict = {}


def column(*names: str):
    def add(f):
        for n in names:
            COLUMNS[n] = f
        return f

    return add


def literal(c: Column):
    """The value of a literal column, or None."""
    try:
        j = c._jc.node()  # noqa: SLF001
        while j.getClass().getSimpleName() == "Cast":
            j = j.child()
        return j.value() if j.getClass().getSimpleName() == "Literal" else None
    except Exception:
        return None


def to_text(k: Compiler, x: Items) -> Column:
    """The first item as a string."""
    x = k.head(x)
    if x.kind == "Empty":
        return F.lit(None).cast("string")
    if x.kind == "Object":
        return F.to_json(x.c)
    if x.kind == "Quantity":
        unit = F.coalesce(x.c.getField("unit"), F.lit(""))
        return F.trim(F.concat(number_text(x.c.getField("value")), F.lit(" "), F.when(F.contains(unit, F.lit(" ")), F.concat(F.lit("'"), unit, F.lit("'"))).otherwise(unit)))
    if isinstance(x.data, T.DecimalType) and x.data.scale:
        return number_text(x.c)
    if x.kind == "Date":
        return k.text(x)
    if x.kind == "DateTime":
        return F.date_format(x.c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return x.c.cast("string")


def number_text(c: Column) -> Column:
    """A decimal without zeros at the end of its fraction."""
    s = c.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


# existence


@column("empty")
def _empty(k, x):
    return k.boolean(~k.has(x))


@column("exists")
def _exists(k, x):
    return k.boolean(k.has(x))


@column("count")
def _count(k, x):
    return k.integer(F.lit(0) if x.kind == "Empty" else F.size(x.c) if x.many else F.when(x.c.isNotNull(), 1).otherwise(0))


def _of_all(name: str, value: bool, every: bool):
    @column(name)
    def run(k, x):
        if x.kind == "Empty":
            return k.boolean(F.lit(every))
        if x.kind != "Boolean":
            return k.boolean(~k.has(x) if every else F.lit(False))
        items = array(x).c
        test = lambda v: v == F.lit(value)
        return k.boolean(F.forall(items, test) if every else F.exists(items, test))


_of_all("allTrue", True, True)
_of_all("anyTrue", True, False)
_of_all("allFalse", False, True)
_of_all("anyFalse", False, False)


@column("distinct")
def _distinct(k, x):
    return k.distinct(x)


@column("isDistinct")
def _is_distinct(k, x):
    return k.boolean(F.size(x.c) == F.size(k.distinct(x).c) if x.many else F.lit(True))


def _subset(k, x, other):
    if x.kind == "Empty":
        return k.boolean(F.lit(True))
    a = array(x)
    return k.boolean(F.forall(a.c, lambda v: k.among(replace(a, c=v, many=False), array(other))) if other.kind != "Empty" else F.size(a.c) == 0)


column("subsetOf")(_subset)


@column("supersetOf")
def _superset(k, x, other):
    return _subset(k, other, x)


# subsetting


@column("first")
def _first(k, x):
    return k.head(x)


@column("last")
def _last(k, x):
    return replace(x, c=F.try_element_at(x.c, F.lit(-1)), many=False) if x.many else x


@column("tail")
def _tail(k, x):
    return replace(x, c=F.slice(x.c, F.lit(2), F.greatest(F.size(x.c) - 1, F.lit(0)))) if x.many else EMPTY


def _argument(k, n: Items) -> Column:
    if n.kind != "Integer":
        raise InvalidArgumentsError("an Integer is expected")
    return F.greatest(k.head(n).c.cast("int"), F.lit(0))


@column("skip")
def _skip(k, x, n):
    x = array(x)
    return x if x.kind == "Empty" else replace(x, c=F.slice(x.c, _argument(k, n) + 1, F.size(x.c)))


@column("take")
def _take(k, x, n):
    x = array(x)
    return x if x.kind == "Empty" else replace(x, c=F.slice(x.c, F.lit(1), _argument(k, n)))


@column("single")
def _single(k, x):
    if not x.many:
        return replace(x, c=F.when(x.c.isNotNull(), x.c).otherwise(k.fail("one item is expected", x.data))) if x.kind != "Empty" else x
    return replace(x, c=F.when(F.size(x.c) == 1, F.try_element_at(x.c, F.lit(1))).otherwise(k.fail("one item is expected", x.data)), many=False)


@column("intersect")
def _intersect(k, x, other):
    if "Empty" in (x.kind, other.kind):
        return EMPTY
    a, b = k.together(x, other)
    if a.kind in ("Quantity", "Object"):
        raise NotCompilable("intersecting objects")
    return replace(a, c=F.array_intersect(a.c, b.c))


@column("exclude")
def _exclude(k, x, other):
    if x.kind == "Empty" or other.kind == "Empty":
        return x
    x, other = array(x), array(other)
    return replace(x, c=F.filter(x.c, lambda v: ~k.among(replace(x, c=v, many=False), other)))


@column("combine")
def _combine(k, x, other):
    if x.kind == other.kind == "Empty":
        return EMPTY
    a, b = k.together(x, other)
    return replace(a, c=F.concat(a.c, b.c))


@column("union")
def _union(k, x, other):
    return k.union(x, other)


# aggregates


def _sum_type(x: Items) -> T.DataType:
    return LONG if x.kind == "Integer" else T.DoubleType() if isinstance(x.data, (T.DoubleType, T.FloatType)) else T.DecimalType(38, x.data.scale)


@column("sum")
def _sum(k, x):
    if x.kind == "Empty":
        return k.integer(F.lit(0))
    if x.kind not in ("Integer", "Decimal"):
        return EMPTY if not x.many else k.integer(F.when(F.size(x.c) == 0, 0))
    data = _sum_type(x)
    return Items(x.kind, F.aggregate(array(x).c, F.lit(0).cast(data), lambda a, v: F.try_add(a, v.cast(data)).cast(data)), data)


@column("avg")
def _avg(k, x):
    if x.kind not in ("Integer", "Decimal"):
        return EMPTY
    x = array(x)
    total = _sum(k, x)
    data = T.DoubleType() if isinstance(total.data, T.DoubleType) else T.DecimalType(38, 16)
    left = total.c.cast(data)
    return Items("Decimal", F.when(F.size(x.c) > 0, (left / F.size(x.c).cast(T.DecimalType(10, 0) if data != T.DoubleType() else "double")).cast(data)), data)


def _extreme(name: str, run):
    @column(name)
    def extreme(k, x):
        if x.kind in ("Empty", "Boolean", "Quantity", "Object"):
            return EMPTY
        return replace(x, c=run(x.c), many=False) if x.many else x


_extreme("min", F.array_min)
_extreme("max", F.array_max)


# tree, type, Boolean


@column("children")
def _children(k, x):
    if not isinstance(x.data, T.StructType):
        return EMPTY
    parts = [array(k.field(x, f.name, "")) for f in x.data.fields]
    if len({str(p.data) for p in parts}) != 1:
        raise NotCompilable("children of several types")
    return replace(parts[0], c=F.concat(*[p.c for p in parts]), name="")


@column("hasValue")
def _has_value(k, x):
    return k.boolean(F.lit(False) if x.kind in ("Empty", "Object", "Quantity") else k.has(x))


@column("getValue")
def _get_value(k, x):
    return EMPTY if x.kind in ("Object", "Quantity") else x


@column("not")
def _not(k, x):
    return k.boolean(~k.truth(x)) if x.kind == "Boolean" else EMPTY


@column("trace")
def _trace(k, x, *_):
    return x


# strings


def _on_text(name: str, run, kind: str = "String"):
    @column(name)
    def on_text(k, x, *arguments):
        if x.kind == "Empty" or any(a.kind == "Empty" for a in arguments):
            return EMPTY
        c = run(k, to_text(k, x), *[to_text(k, a) for a in arguments])
        return {"String": k.string, "Boolean": k.boolean, "Integer": k.integer}[kind](c)


_on_text("startsWith", lambda k, s, x: F.startswith(s, x), "Boolean")
_on_text("endsWith", lambda k, s, x: F.endswith(s, x), "Boolean")
_on_text("contains", lambda k, s, x: F.contains(s, x), "Boolean")
_on_text("lower", lambda k, s: F.lower(s))
_on_text("upper", lambda k, s: F.upper(s))
_on_text("trim", lambda k, s: F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
_on_text("length", lambda k, s: F.char_length(s) if k.settings.spec else F.octet_length(s), "Integer")


def _index_of(k, s, x):
    at = F.call_function("locate", x, s)
    return (at - 1) if k.settings.spec else F.when(at > 0, F.octet_length(F.substring(s, F.lit(1), at - 1))).when(at == 0, F.lit(-1))


_on_text("indexOf", _index_of, "Integer")
_on_text("replace", lambda k, s, x, y: F.when(x == "", F.regexp_replace(s, F.lit("(?s)(?=.)|$"), F.regexp_replace(y, r"([\\$])", r"\\$1"))).otherwise(F.replace(s, x, y)))


@column("substring")
def _substring(k, x, start, length=None):
    if "Empty" in (x.kind, start.kind) or (length is not None and length.kind == "Empty"):
        return EMPTY
    s, a = to_text(k, x), k.head(start).c.cast("int")
    if start.kind != "Integer" or (length is not None and length.kind != "Integer"):
        return EMPTY
    size = F.char_length(s) if k.settings.spec else F.octet_length(s)
    n = size if length is None else k.head(length).c.cast("int")
    if k.settings.spec:
        part = F.substring(s, a + 1, n)
    else:
        raw = F.encode(s, "utf-8")
        part = F.when(size == F.char_length(s), F.substring(s, a + 1, n)).otherwise(F.make_valid_utf8(F.substring(raw, a + 1, n).cast("string")))
    return k.string(F.when((a >= 0) & (a < size) & (n >= 0), part))


@column("toChars")
def _chars(k, x):
    return EMPTY if x.kind == "Empty" else Items("String", F.coalesce(F.regexp_extract_all(to_text(k, x), F.lit("(?s)."), F.lit(0)), F.array().cast("array<string>")), STRING, many=True)


@column("split")
def _split(k, x, separator):
    if "Empty" in (x.kind, separator.kind):
        return EMPTY
    s, by = to_text(k, x), to_text(k, separator)
    quoted = F.concat(F.lit(r"\Q"), F.replace(by, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    parts = F.when(by == "", F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))).otherwise(F.split(s, quoted, F.lit(-1)))
    return Items("String", F.coalesce(parts, F.array().cast("array<string>")), STRING, many=True)


@column("join")
def _join(k, x, separator=None):
    if x.kind == "Empty":
        return k.string(F.lit(""))
    x = array(x)
    by = F.lit("") if separator is None else F.coalesce(to_text(k, separator), F.lit(""))
    items = x.c if x.kind == "String" else F.transform(x.c, lambda v: to_text(k, replace(x, c=v, many=False)))
    return k.string(F.call_function("array_join", items, by))


def _java(source: str) -> str:
    pattern(source)
    return re.sub(r"\(\?P<", "(?<", source)


@column("matches")
def _matches(k, x, p):
    if "Empty" in (x.kind, p.kind):
        return EMPTY
    source = literal(p.c)
    return k.boolean(F.rlike(to_text(k, x), F.lit(_java(source)) if isinstance(source, str) else to_text(k, p)))


@column("replaceMatches")
def _replace_matches(k, x, p, to):
    if "Empty" in (x.kind, p.kind, to.kind):
        return EMPTY
    source, new = literal(p.c), literal(to.c)
    if not isinstance(source, str) or not isinstance(new, str):
        raise NotCompilable("a pattern that isn't literal")
    names = re.findall(r"\(\?P?<(\w+)>", source)
    new = re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: f"\0{{{m[1] or m[2]}}}", new.replace("\\", "\\\\"))
    new = re.sub(r"\0\{(\w+)\}", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}" if m[1] in names else "", new.replace("$", r"\$"))
    return k.string(F.regexp_replace(to_text(k, x), F.lit(_java(source)), F.lit(new)))


# math


def _number(name: str, whole, run, kind: str = "Decimal"):
    """whole: for Integers (None: as real numbers); run: on a double, null for no result."""

    @column(name)
    def on_number(k, x, *arguments):
        x = k.head(x)
        if x.kind not in ("Integer", "Decimal"):
            return EMPTY
        if x.kind == "Integer" and whole is not None:
            return k.integer(whole(x.c))
        more = []
        for a in arguments:
            if a.kind not in ("Integer", "Decimal"):
                return EMPTY
            more.append(k.head(a).c.cast("double"))
        c = run(x.c.cast("double") if kind == "Decimal" else x.c, *more)
        return k.integer(c) if kind == "Integer" else Items("Decimal", F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c), T.DoubleType())


_number("abs", lambda c: F.abs(c), lambda c: F.abs(c))
_number("ceiling", lambda c: c, lambda c: F.ceil(c), "Integer")
_number("floor", lambda c: c, lambda c: F.floor(c), "Integer")
_number("truncate", lambda c: c, lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)), "Integer")
_number("exp", None, lambda c: F.exp(c))
_number("ln", None, lambda c: F.when(c > 0, F.ln(c)))
_number("log", None, lambda c, b: F.when((c > 0) & (b > 0) & (b != 1), F.ln(c) / F.when(b != 1, F.ln(b))))
_number("power", None, lambda c, y: F.pow(c, y))
_number("sqrt", None, lambda c: F.when(c >= 0, F.sqrt(c)))


@column("round")
def _round(k, x, places=None):
    x = k.head(x)
    if x.kind == "Integer":
        return x
    if x.kind != "Decimal":
        return EMPTY
    n = 0 if places is None else literal(places.c)
    if not isinstance(n, int):
        raise NotCompilable("a precision that isn't literal")
    data = T.DecimalType(38, min(n, 18))
    return EMPTY if n < 0 else Items("Decimal", F.round(x.c.cast(DECIMAL) if isinstance(x.data, (T.DoubleType, T.FloatType)) else x.c, n).cast(data), data)


# conversion


@column("toBoolean")
def to_boolean(k, x):
    x = k.head(x)
    if x.kind == "Boolean":
        return x
    if x.kind == "String":
        s = F.lower(x.c)
        return k.boolean(F.when(s.isin(*sorted(TRUE)), True).when(s.isin(*sorted(FALSE)), False))
    if x.kind in ("Integer", "Decimal"):
        return k.boolean(F.when(x.c == 1, True).when(x.c == 0, False))
    return EMPTY


@column("toInteger")
def to_integer(k, x):
    x = k.head(x)
    if x.kind in ("Boolean", "Integer"):
        return k.integer(x.c.cast("bigint"))
    if x.kind == "Decimal":
        return k.integer(F.when(x.c < 0, F.ceil(x.c)).otherwise(F.floor(x.c)))
    if x.kind == "String":
        return k.integer(F.when(F.rlike(x.c, F.lit(r"^[+-]?[0-9]+\z")), x.c.try_cast("bigint")))
    return EMPTY


@column("toDecimal")
def to_decimal(k, x):
    x = k.head(x)
    if x.kind == "Decimal":
        return x
    if x.kind == "Boolean":
        return k.decimal(x.c.cast("int"))
    if x.kind == "Integer":
        return k.decimal(x.c, T.DecimalType(38, 0))
    if x.kind == "String":
        return k.decimal(F.when(F.rlike(x.c, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")), x.c.try_cast(DECIMAL)))
    return EMPTY


@column("toString")
def to_string(k, x):
    return EMPTY if x.kind == "Empty" else k.string(to_text(k, x))


_DATE_TEXT = r"^\d{4}(-\d{2}(-\d{2})?)?\z"
_DATETIME_TEXT = r"^\d{4}(-\d{2}(-\d{2}(T(\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?)?)?)?(Z|[+-]\d{2}:\d{2})?\z"
_TIME_TEXT = r"^T?\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?\z"


@column("toDate")
def to_date(k, x):
    x = k.head(x)
    if x.kind == "Date":
        return x
    if x.kind == "DateTime":
        return Items("Date", x.c.cast("date"), T.DateType())
    if x.kind == "String":
        return Items("Date", F.when(F.rlike(x.c, F.lit(_DATE_TEXT)), x.c), STRING)
    return EMPTY


@column("toDateTime")
def to_datetime(k, x):
    x = k.head(x)
    if not k.settings.spec:
        return x if x.kind == "String" else EMPTY
    if x.kind in ("DateTime", "Date"):
        return Items("DateTime", x.c.cast("timestamp"), T.TimestampType())
    return Items("DateTime", F.when(F.rlike(x.c, F.lit(_DATETIME_TEXT)), F.try_to_timestamp(x.c)), T.TimestampType()) if x.kind == "String" else EMPTY


@column("toTime")
def to_time(k, x):
    x = k.head(x)
    if not k.settings.spec:
        return x if x.kind == "String" else EMPTY
    return x if x.kind == "Time" else Items("Time", F.when(F.rlike(x.c, F.lit(_TIME_TEXT)), F.regexp_replace(x.c, "^T", "")), STRING) if x.kind == "String" else EMPTY


@column("toQuantity")
def to_quantity(k, x, unit=None):
    x = k.head(x)
    if x.kind == "Quantity":
        return x
    if x.kind in ("Integer", "Decimal"):
        by = F.lit("") if unit is None else F.coalesce(to_text(k, unit), F.lit(""))
        return Items("Quantity", F.when(x.c.isNotNull(), F.struct(x.c.cast(DECIMAL).alias("value"), by.alias("unit"))), QUANTITY)
    if x.kind == "String":
        form = r"^\s*([+-]?\d+(?:\.\d+)?)\s*(?:'([^']*)'|([A-Za-z%\[/][^\s']*))?\s*\z"
        part = lambda n: F.regexp_extract(x.c, form, n)
        return Items("Quantity", F.when(F.rlike(x.c, F.lit(form)), F.struct(part(1).try_cast(DECIMAL).alias("value"), F.concat(part(2), part(3)).alias("unit"))), QUANTITY)
    return EMPTY


def _converts(name: str, convert, can=None):
    @column(f"convertsTo{name}")
    def test(k, x, *arguments):
        if x.kind == "Empty":
            return k.boolean(F.lit(False))
        if can is not None and not (k.settings.spec and name in ("Date", "DateTime", "Time")):
            return k.boolean(k.has(x) & can(k, x))
        return k.boolean(k.has(convert(k, x)))


_converts("Boolean", to_boolean)
_converts("Integer", to_integer)
_converts("Decimal", to_decimal)
_converts("String", to_string, lambda k, x: F.lit(x.kind in ("String", "Boolean", "Integer", "Decimal")))
for _name, _to in (("Date", to_date), ("DateTime", to_datetime), ("Time", to_time)):
    _converts(_name, _to, lambda k, x: F.lit(x.kind == "String"))


@column("convertsToQuantity")
def _converts_to_quantity(k, x, unit=None):
    if x.kind == "Empty" or (x.kind == "Object"):
        return k.boolean(F.lit(False))
    found = to_quantity(k, x)
    if unit is None or x.kind in ("Integer", "Decimal"):
        return k.boolean(k.has(found))
    wanted = literal(unit.c)
    if not isinstance(wanted, str):
        raise NotCompilable("a unit that isn't literal")
    _, own = k.normal(found)
    return k.boolean(k.has(found) & F.coalesce(own == units.canonical(wanted), F.lit(False)))


# boundaries and temporal parts


def _boundary(high: bool):
    def run(k, x, precision=None):
        x = k.head(x)
        if x.kind == "Integer":
            return x
        if x.kind in ("Decimal", "Quantity"):
            value = x.c if x.kind == "Decimal" else x.c.getField("value")
            p = literal(precision.c) if precision is not None else x.data.scale if isinstance(x.data, T.DecimalType) and x.kind == "Decimal" else None
            if not isinstance(p, int):
                raise NotCompilable("the written precision of a number")
            if precision is None and p == 0:
                return EMPTY
            half = F.lit("0." + "0" * p + "5").cast(T.DecimalType(38, p + 1))
            value = (value.cast(T.DecimalType(36, max(p + 1, 2))) + (half if high else -half)).cast(T.DecimalType(38, p + 1))
            return Items("Decimal", value, T.DecimalType(38, p + 1)) if x.kind == "Decimal" else replace(x, c=F.struct(value.cast(DECIMAL).alias("value"), x.c.getField("unit").alias("unit")))
        if x.kind == "Date":
            if isinstance(x.data, T.DateType):
                return x
            first = F.to_date(F.concat(x.c, F.substring(F.lit("0000-01-01"), F.length(x.c) + 1, F.lit(10))))
            end = F.when(F.length(x.c) == 4, F.last_day(F.add_months(first, 11))).when(F.length(x.c) == 7, F.last_day(first)).otherwise(first)
            return Items("Date", end if high else first, T.DateType())
        if x.kind == "Time":
            full = "00:59:59.999" if high else "00:00:00.000"
            return replace(x, c=F.concat(x.c, F.substring(F.lit(full), F.length(x.c) + 1, F.lit(12))))
        if x.kind == "DateTime" and not x.name:
            return x
        raise NotCompilable(f"the boundary of {x.type_name}")

    return run


column("lowBoundary")(_boundary(False))
column("highBoundary")(_boundary(True))


def _component(n: int, name: str):
    @column(name)
    def part(k, x):
        x = k.head(x)
        if x.kind == "Date" and n < 3:
            if isinstance(x.data, T.DateType):
                return k.integer((F.year, F.month, F.dayofmonth)[n](x.c))
            return k.integer(F.substring(x.c, (1, 6, 9)[n], (4, 2, 2)[n]).try_cast("int"))
        if x.kind == "DateTime":
            if name == "millisecond":
                return k.integer(F.unix_millis(x.c.cast("timestamp")) % 1000)
            return k.integer((F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)[n](x.c))
        if x.kind == "Time" and n >= 3:
            return k.integer(F.coalesce(F.substring(x.c, (1, 4, 7, 10)[n - 3], (2, 2, 2, 3)[n - 3]).try_cast("int"), F.when(x.c.isNotNull(), 0)))
        return EMPTY


for _n, _field in enumerate(FIELDS):
    _component(_n, _field)


@column("now")
def _now(k, x):
    return Items("DateTime", F.current_timestamp(), T.TimestampType())


@column("today")
def _today(k, x):
    return Items("Date", F.current_date(), T.DateType())


@column("timeOfDay")
def _time_of_day(k, x):
    return Items("Time", F.date_format(F.current_timestamp(), "HH:mm:ss.SSS"), STRING)


# documents


@column("extension")
def _extension(k, x, url):
    found = k.member(x, "extension")
    if found.kind == "Empty" or url.kind != "String":
        return EMPTY
    found, wanted = array(found), k.head(url).c
    return replace(found, c=F.filter(found.c, lambda e: e.getField("url") == wanted))


@column("hasExtension")
def _has_extension(k, x, url):
    return k.boolean(k.has(_extension(k, x, url)))


@column("getExtensionValue")
def _extension_value(k, x, url):
    found = _extension(k, x, url)
    if found.kind == "Empty":
        return EMPTY
    fields = [f for f in EXTENSION_VALUES if f in found.data.fieldNames()]
    kinds = {str(found.data[f].dataType) for f in fields}
    if not fields:
        return EMPTY
    if len(kinds) > 1:
        raise k.several(found, "value", {f: f.removeprefix("value") for f in fields})
    values = F.filter(F.transform(found.c, lambda e: F.coalesce(*[e.getField(f) for f in fields])), lambda v: v.isNotNull())
    return of(T.ArrayType(found.data[fields[0]].dataType, False), values)


@column("getReferenceKey")
def _reference_key(k, x, part=None):
    if x.kind == "Empty":
        return EMPTY
    ref = x if x.kind == "String" else k.member(x, "reference")
    if ref.kind == "Empty":
        return EMPTY
    wanted = literal(part.c) if part is not None and part.kind != "Empty" else None
    form = r"([^/]+)/+([^/]+)/*$"

    def key(c: Column) -> Column:
        kind, id_ = F.regexp_extract(c, form, 1), F.regexp_extract(c, form, 2)
        return F.when(kind != "", kind if wanted == "type" else id_ if wanted == "id" else F.concat(kind, F.lit("/"), id_))

    return k.string(key(ref.c)) if not ref.many else Items("String", F.filter(F.transform(ref.c, key), lambda v: v.isNotNull()), STRING, many=True)


@column("resolve")
def _resolve(k, x):
    raise NotCompilable("resolve() over a table is a join: pathloom.operators.references.resolve")


@column("memberOf")
def _member_of(k, x, url):
    if k.settings.member_of is None:
        return EMPTY
    source = literal(url.c)
    if not isinstance(source, str):
        raise NotCompilable("a value set that isn't literal")
    return k.boolean(k.settings.member_of(source, x))


@column("conformsTo")
def _conforms_to(k, x, url):
    profiles = k.settings.variables.get("__profiles__")
    source = literal(url.c)
    if profiles is None or source not in profiles:
        return EMPTY
    from pathloom.plans.compiler import Scope

    one = k.head(x)
    tests = [k.sure(k.run(t, Scope(one, one))) for t in profiles[source]]
    c = F.lit(True)
    for t in tests:
        c = c & t
    return k.boolean(F.when(one.c.isNotNull(), c))
