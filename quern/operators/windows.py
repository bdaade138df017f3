"""Windows over results: accessors such as revenue.previous, ranks, and frames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError

_ACCESSOR = re.compile(r"^(?P<field>.+)\.(?P<how>previous|next|delta|percent_change|first|last|lag\(\d+\)|lead\(\d+\))$")


def split(name: str) -> tuple[str, str | None]:
    """A field and its accessor, if it has one."""
    m = _ACCESSOR.match(name)
    return (m["field"], m["how"]) if m else (name, None)


def accessor(x: Column, how: str, partition: list[str], axis: str) -> Column:
    """x of another period, or against it; the axis orders periods within the other dimensions."""
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in partition]).orderBy(F.col(f"`{axis}`").asc_nulls_first())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if m := re.fullmatch(r"(lag|lead)\((\d+)\)", how):
        return getattr(F, m[1])(x, int(m[2])).over(w)
    if how == "previous":
        return F.lag(x, 1).over(w)
    if how == "next":
        return F.lead(x, 1).over(w)
    if how in ("first", "last"):
        return getattr(F, how)(x).over(whole)
    before = F.lag(x, 1).over(w)
    return x - before if how == "delta" else F.try_divide((x - before).cast("double"), before.cast("double"))


_RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def window(df: DataFrame, name: str, function: str, partition: list[str], order: list[Column], of: Column | None = None, frame: tuple[str, int | None, int | None] | None = None, n: int = 1) -> DataFrame:
    """df with a window column. frame: (rows, range or groups, from, to) in offsets from the row; None is unbounded.

    Spark has no frames over groups of peers; they are ranges over the dense rank, which is the group's number.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    if function in _RANKS:
        return df.withColumn(name, _RANKS[function]().over(w))
    if function in ("lag", "lead"):
        return df.withColumn(name, getattr(F, function)(of, n).over(w))
    build = {"first_value": F.first, "last_value": F.last, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}.get(function)
    if build is None:
        raise RequestError("PLAN_E_WINDOW", f"unknown window function {function}")
    if frame is not None:
        kind, lo, hi = frame
        lo = Window.unboundedPreceding if lo is None else lo
        hi = Window.unboundedFollowing if hi is None else hi
        if kind == "groups":
            df = df.withColumn("__group", F.dense_rank().over(w))
            return df.withColumn(name, build(of).over(Window.partitionBy(*partition).orderBy("__group").rangeBetween(lo, hi))).drop("__group")
        w = w.rowsBetween(lo, hi) if kind == "rows" else w.rangeBetween(lo, hi)
    return df.withColumn(name, build(of).over(w))
