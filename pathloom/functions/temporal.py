"""Components, clock and boundaries of temporal values."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pathloom.functions.registry import function
from pathloom.plans.values import FIELDS, Date, DateTime, Dec, Quantity, Time, month_end


def _component(k: int, name: str) -> None:
    @function(name)
    def run(call, items):
        x = items[0] if items else None
        if isinstance(x, Time):
            parts = (0, 0, 0, *x.parts)
            return [parts[k] if k < len(parts) else 0] if k > 2 else []
        if isinstance(x, DateTime) and k > 2:
            return [x.parts[k] if k < len(x.parts) else 0]
        return [x.parts[k]] if isinstance(x, (Date, DateTime)) and k < len(x.parts) and (k < 3) else []


for _k, _name in enumerate(FIELDS):
    _component(_k, _name)


def clock(now: datetime) -> tuple[DateTime, Date, Time]:
    offset = now.utcoffset()
    parts = (now.year, now.month, now.day, now.hour, now.minute, now.second, now.microsecond // 1000)
    return DateTime(parts, int(offset.total_seconds()) // 60 if offset is not None else 0), Date(parts[:3]), Time(parts[3:])


@function("now")
def _now(call, items):
    return [clock(call.now)[0]]


@function("today")
def _today(call, items):
    return [clock(call.now)[1]]


@function("timeOfDay")
def _time_of_day(call, items):
    return [clock(call.now)[2]]


def _boundary(x, precision: int | None, high: bool) -> list:
    if isinstance(x, bool):
        return []
    if isinstance(x, int):
        return [x]
    if isinstance(x, (Dec, Quantity)):
        value, written = (x.value, x.places()) if isinstance(x, Dec) else (x.value, max(0, -x.value.as_tuple().exponent))
        p = written if precision is None else precision
        if p == 0 and precision is None:
            return []
        half = Decimal(5).scaleb(-p - 1)
        value = value + half if high else value - half
        return [Dec(value) if isinstance(x, Dec) else Quantity(value, x.unit)]
    if isinstance(x, Date):
        y, mo, d = (*x.parts, *((12, 31) if high else (1, 1))[len(x.parts) - 1 :])
        if high and len(x.parts) < 3:
            d = month_end(y, mo)
        return [Date((y, mo, d))]
    if isinstance(x, DateTime):
        fill = (0, 12, 31, 23, 59, 59, 999) if high else (0, 1, 1, 0, 0, 0, 0)
        parts = [*x.parts, *fill[len(x.parts) :]]
        if high and len(x.parts) < 3:
            parts[2] = month_end(parts[0], parts[1])
        return [DateTime(tuple(parts), x.offset if x.offset is not None else (-12 if high else 14) * 60)]
    if isinstance(x, Time):
        return [Time((*x.parts, *((0, 59, 59, 999) if high else (0, 0, 0, 0))[len(x.parts) :]))]
    return []


def _precision(argument) -> int | None:
    return argument[0] if argument and isinstance(argument[0], int) and not isinstance(argument[0], bool) else None


@function("lowBoundary", 0, 1)
def _low(call, items, precision=()):
    return _boundary(items[0], _precision(precision), False) if items else []


@function("highBoundary", 0, 1)
def _high(call, items, precision=()):
    return _boundary(items[0], _precision(precision), True) if items else []
