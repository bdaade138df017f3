"""Type strings of models, and time grains."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ModelError

_SIMPLE = {
    T.BooleanType(): ("boolean", "bool"), T.ByteType(): ("byte", "i8", "int8"), T.ShortType(): ("short", "i16", "int16"),
    T.IntegerType(): ("integer", "int", "i32", "int32"), T.LongType(): ("long", "bigint", "i64", "int64"), T.FloatType(): ("float", "f32", "float32"),
    T.DoubleType(): ("double", "number", "f64", "float64"), T.StringType(): ("string", "varchar"), T.BinaryType(): ("binary",), T.DateType(): ("date",),
    T.TimestampNTZType(): ("timestamp",),
}
_BY_NAME = {n: t for t, names in _SIMPLE.items() for n in names}

#: From fine to coarse: a rank for choosing tables, not divisibility.
GRAINS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def parse_type(text: str) -> T.DataType:
    """The Spark type of a model's type string."""
    name = text.strip().lower()
    if name in _BY_NAME:
        return _BY_NAME[name]
    if m := re.fullmatch(r"decimal\s*(?:\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\))?", name):
        p, s = int(m[1] or 38), int(m[2] or (0 if m[1] else 18))
        if not 1 <= p <= 38 or not 0 <= s <= p:
            raise ModelError("MODEL_E_TYPE", f"decimal({p},{s}) is out of range")
        return T.DecimalType(p, s)
    if m := re.fullmatch(r"(time|timestamp)\s*\(\s*(\d)\s*\)", name):
        if int(m[2]) > 6:
            raise ModelError("MODEL_E_TYPE", f"{name}: at most 6 digits")
        return T.TimestampNTZType() if m[1] == "timestamp" else T.TimeType(int(m[2]))
    if name == "time":
        return T.TimeType(6)
    raise ModelError("MODEL_E_TYPE", f"unknown type {text!r}")


def is_temporal(t: T.DataType | None) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def rank(grain: str) -> int:
    if grain not in GRAINS:
        raise ModelError("MODEL_E_GRAIN", f"unknown grain {grain!r}")
    return GRAINS.index(grain)


def finer_or_equal(a: str, b: str) -> bool:
    """Whether a table at grain a can answer for grain b: weeks don't divide months, quarters or years."""
    return rank(a) <= rank(b) and not (a == "week" and b in ("month", "quarter", "year"))


def truncate(c: Column, grain: str, to: T.DataType | None) -> Column:
    """c cut to the start of its grain, in its own kind of time rather than the session's."""
    rank(grain)
    if isinstance(to, T.DateType) and rank(grain) >= rank("day"):
        return c.cast("date") if grain == "day" else F.trunc(c.cast("date"), grain)
    return F.date_trunc(grain, c).cast(to if to is not None and is_temporal(to) else "timestamp_ntz")


_WIDER = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType())
_DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 20}
_TIMES = (T.DateType(), T.TimestampNTZType(), T.TimestampType())


def widest(name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: nulls take the other's, numbers and times the wider one's; others must agree."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    for order in (_WIDER, _TIMES):
        if a in order and b in order:
            return order[max(order.index(a), order.index(b))]
    if any(isinstance(x, T.DecimalType) for x in (a, b)) and all(isinstance(x, T.DecimalType) or x in _WIDER for x in (a, b)):
        if any(isinstance(x, (T.FloatType, T.DoubleType)) for x in (a, b)):
            return T.DoubleType()
        parts = [(x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType) else (_DIGITS[x], 0) for x in (a, b)]
        whole, scale = (max(x) for x in zip(*parts, strict=True))
        return T.DecimalType(min(whole + scale, 38), scale)
    raise ModelError("PLAN_E_TYPE", f"{name}: {a.simpleString()} and {b.simpleString()} have no common type")
