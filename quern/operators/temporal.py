"""Time: which rows a temporal shape means, joins as of a time, and gaps in series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..model import Temporal
from ..types import rank, truncate


def _time(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp_ntz")


def select_rows(df: DataFrame, t: Temporal, column, as_of=None, between=None, keys=(), grain: str | None = None, name: str = "") -> DataFrame:
    """Rows that a request means: ranges of events, one snapshot, versions valid at a time (those of today if none is given).

    A range of snapshots that is asked for at a coarser grain than theirs gives the last one of each period. A time before
    the first snapshot is an error, raised when the rows are computed.
    """
    axis = column(t.axis)
    if t.shape == "snapshot":
        if between is not None:
            df = df.filter((axis >= _time(between[0])) & (axis < _time(between[1])))
            if grain is None or t.grain is None or rank(grain) <= rank(t.grain):
                return df
            period = truncate(axis, grain, None)
            last = df.groupBy(period.alias("__period")).agg(F.max(axis).alias("__last"))  # a row a period
            return df.join(last, axis == F.col("__last"), "left_semi")
        seen = df.filter(axis <= _time(as_of)) if as_of is not None else df
        latest = F.max(axis)
        if as_of is not None:
            latest = F.when(F.count(axis) == 0, F.raise_error(F.lit(f"PLAN_E_1730: {name} has no snapshot at or before {as_of}")).cast("timestamp")).otherwise(latest)
        return df.join(F.broadcast(seen.agg(latest.alias("__latest"))), axis == F.col("__latest"), "left_semi")  # one row
    if t.shape == "scd":
        if t.scd_type == "type1":
            return df
        until = column(t.until)
        end = F.lit(None).cast("timestamp_ntz") if t.open_ended in (None, "none") else _time(t.open_ended)
        still = until.isNull() | until.eqNullSafe(end)
        if between is not None:
            return df.filter((axis < _time(between[1])) & (still | (until > _time(between[0]))))
        if as_of is not None:
            return df.filter((axis <= _time(as_of)) & (still | (until > _time(as_of))))
        if t.current is not None:
            return df.filter(column(t.current).cast("boolean"))
        return last_versions(df, keys, axis) if t.open_ended == "none" else df.filter(still)
    if between is not None:
        df = df.filter((axis >= _time(between[0])) & (axis < _time(between[1])))
    return df


def last_versions(df: DataFrame, keys: list[Column], axis: Column) -> DataFrame:
    """Of each key the rows at its last time, found by a partial aggregate."""
    if not keys:
        raise RequestError("PLAN_E_1731", "versions without an open end need a primary key to tell which are the last")
    last = df.groupBy(*[k.alias(f"__k{n}") for n, k in enumerate(keys)]).agg(F.max(axis).alias("__last"))
    on = [k.eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)] + [axis == F.col("__last")]
    return df.join(last, reduce(lambda a, b: a & b, on), "left_semi")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, take: list[str], until: str | None = None) -> DataFrame:
    """Each left row with `take` of the last right row of its key at or before its time (and, with until, still valid then).

    Both sides go by key in one order of time, and the last right row seen is carried forward: one shuffle, no join of
    ranges. Of right rows at one time the greatest `take` counts. Rows without a match get nulls.
    """
    both = [*on, "__time", "__side", "__left", "__right"]
    a = left.select(*on, F.col(left_time).alias("__time"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"), F.lit(None).alias("__right"))
    kept = list(dict.fromkeys([*([until] if until else []), *take]))
    b = right.select(*on, F.col(right_time).alias("__time"), F.lit(0).alias("__side"), F.lit(None).alias("__left"), F.struct(*[F.col(c).alias(f"r_{c}") for c in kept]).alias("__right"))
    w = Window.partitionBy(*on).orderBy("__time", "__side", "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = a.select(*both).unionByName(b.select(*both)).withColumn("__hit", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    hit = F.col("__hit")
    if until:
        hit = F.when(hit[f"r_{until}"].isNull() | (hit[f"r_{until}"] > F.col("__time")), hit)
    return line.select("__left.*", *[hit[f"r_{c}"].alias(c) for c in take])


def latest(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(axis).desc())
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_in_period(df: DataFrame, axis: str, grain: str, keys: list[str]) -> DataFrame:
    """The last snapshot of each period, for each key."""
    period = truncate(F.col(axis), grain, df.schema[axis].dataType)
    last = df.groupBy(*keys, period.alias("__period")).agg(F.max(axis).alias("__last"))
    on = [df[k].eqNullSafe(last[k]) for k in keys] + [df[axis] == last["__last"]]
    out = on[0]
    for c in on[1:]:
        out = out & c
    return df.join(last, out, "left_semi")


def fill_gaps(df: DataFrame, axis: str, grain: str, keys: list[str]) -> DataFrame:
    """df with a row for each missing period between a key's first and last, its other columns null. Null keys are a key; null times stay."""
    step = {"quarter": "3 months"}.get(grain, f"1 {grain}")
    q = lambda c: F.col(f"`{c}`")
    spans = df.groupBy(*map(q, keys)).agg(F.min(q(axis)).alias("__a"), F.max(q(axis)).alias("__z"))
    every = spans.filter("__a is not null").select(*[q(c).alias(f"__k{n}") for n, c in enumerate(keys)], F.explode(F.sequence("__a", "__z", F.expr(f"interval {step}"))).alias("__at"))
    on = reduce(lambda a, b: a & b, [q(c).eqNullSafe(F.col(f"__k{n}")) for n, c in enumerate(keys)] + [q(axis) == F.col("__at")])
    own = {c: F.col(f"__k{n}") for n, c in enumerate(keys)} | {axis: F.col("__at")}
    filled = every.join(df, on, "left").select(*[own[c].alias(c) if c in own else q(c) for c in df.columns])
    return filled.unionByName(df.filter(q(axis).isNull()))
