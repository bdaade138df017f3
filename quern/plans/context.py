"""What a plan knows while it is built."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..expr import Node, build, fields, fold, lit, substitute
from ..model import Dimension, Kind, Measure
from ..sources import Sources, location, token
from ..types import is_temporal, truncate

#: Columns of row frames: a measure's input, a key of a join, an untouched copy of an axis.
INPUT, AXIS = "__m_{}", "__x_{}"


@dataclass(frozen=True)
class Plan:
    """One request against one kind, or a part of it. dims are those that rows need, whether selected or not."""

    sources: Sources
    dims: dict[str, Dimension]
    measures: dict[str, Measure]
    group: tuple[str, ...] = ()
    filters: tuple[Node, ...] = ()
    grains: dict[str, str] = field(default_factory=dict)
    axes: tuple[str, ...] = ()
    as_of: Any = None
    between: tuple | None = None
    fanout: str = "guard"
    history: bool = False
    notes: list[str] = field(default_factory=list)

    def note(self, text: str) -> None:
        self.notes.append(text)

    def part(self, **changes) -> Plan:
        return replace(self, **changes)


@dataclass(frozen=True)
class Frame:
    """Rows with semantic names. done: request filters and grains are in them already."""

    df: DataFrame
    done: bool = False


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def finish(p: Plan, f: Frame) -> DataFrame:
    """Rows with the request's filters, its grains, and copies of axes from before the grains."""
    df = f.df
    if f.done:
        return df
    for n in p.filters:
        df = df.filter(build(n, quoted))
    cols = {AXIS.format(a): quoted(a) for a in p.axes}
    for d, g in p.grains.items():
        if d in df.columns:
            t = p.dims[d].data_type if d in p.dims else None
            cols[d] = truncate(quoted(d), g, t or df.schema[d].dataType)
    return df.withColumns(cols) if cols else df


def typed_null(t) -> Column:
    return F.lit(None).cast(t) if t is not None else F.lit(None)


class Leaf:
    """Names of a dataset, turned into columns of what is stored."""

    def __init__(self, k: Kind, df: DataFrame, at: str | None = None):
        self.k, self.df, self.at = k, df, at
        self.columns = {c.lower(): c for c in df.columns}

    def literals(self) -> dict[str, Node]:
        """Fields that the mapping fixes to a value."""
        return {n: _constant(v) for n, v in (self.k.mapping or {}).items() if isinstance(v, dict) and "lit" in v}

    def has(self, name: str, seen: frozenset = frozenset()) -> bool:
        if name in seen:
            return name.lower() in self.columns
        if name in (self.k.mapping or {}):
            return True
        d = self.k.dimensions.get(name)
        if d is not None and d.metadata:
            return True
        if d is not None and d.expr is not None:
            return all(self.has(f, seen | {name}) for f in fields(fold(substitute(d.expr, self.literals()))))
        if d is not None and d.buckets and d.bucket_of:
            return self.has(d.bucket_of, seen | {name})
        return name.lower() in self.columns

    def physical(self, name: str) -> Column:
        if name.lower() not in self.columns:
            raise RequestError("PLAN_E_COLUMN", f"{self.k.name} has no column {name}")
        return quoted(self.columns[name.lower()])

    def column(self, name: str, seen: frozenset = frozenset()) -> Column:
        if name in seen:
            return self.physical(name)
        inner = lambda f: self.column(f, seen | {name})
        d = self.k.dimensions.get(name)
        m = (self.k.mapping or {}).get(name)
        if m is not None:
            c = self._mapped(m, inner)
        elif d is not None and d.metadata:
            c = self.place(*d.metadata)
        elif d is not None and d.expr is not None:
            c = build(fold(substitute(d.expr, self.literals())), inner)
        elif d is not None and d.buckets and d.bucket_of:
            c = self.column(d.bucket_of, seen | {name})
        else:
            c = self.physical(name)
        if d is not None and d.buckets:
            c = bucket(c, d)
        return c.cast(d.data_type) if d is not None and d.data_type is not None else c

    def place(self, kind: str, index: int) -> Column:
        """A part of the source's location: known before reading where the author's path has it, else from each file's name."""
        known = token(self.at, kind, index)
        return location(kind, index) if known is None else F.lit(known)

    def known(self) -> dict[str, Node]:
        """Fields that have one value in all rows of the source."""
        out = dict(self.literals())
        for n, d in self.k.dimensions.items():
            if d.metadata and (v := token(self.at, *d.metadata)) is not None:
                out[n] = lit(v)
        return out

    def _mapped(self, m: Any, inner) -> Column:
        if isinstance(m, str):
            return self.physical(m)
        (tag, v), = m.items()
        if tag == "lit":
            return build(_constant(m), inner)
        if tag in ("col", "column"):
            return self.physical(v)
        if tag == "metadata":
            (how, n), = v.items()
            return self.place("path" if how.startswith("path") else "partition", int(n))
        from ..expr import parse

        return build(parse(v if tag == "expr" else m), self.physical)

    def provides(self, m: Measure) -> bool:
        if m.expr is not None:
            own = fields(m.expr)
            return all(self.has(f) or (f in self.columns) for f in own) and all(self.has(f) or f.lower() in self.columns for x in m.filters for f in fields(x))
        return m.name in (self.k.mapping or {}) or m.name.lower() in self.columns

    def input(self, m: Measure) -> Column:
        """A measure's value in a row; counts count 1, or what the table has counted already."""
        # a measure's own name is what it is mapped to
        x = build(m.expr, lambda f: self.column(f)) if m.expr is not None else self._mapped(self.k.mapping[m.name], self.column) if m.name in (self.k.mapping or {}) else self.physical(m.name)
        if m.agg == "count":
            x = x.cast("long") if self.k.pre_aggregated else F.when(x.isNotNull(), F.lit(1).cast("long"))
        elif self.k.pre_aggregated and m.agg not in ("sum", "min", "max"):
            raise RequestError("PLAN_E_2304", f"{self.k.name} holds totals: {m.agg} of {m.name} can't be had from them")
        for n in m.filters:
            x = F.when(build(n, lambda f: self.column(f)), x)
        return x


def _constant(v: dict) -> Node:
    from ..expr import parse

    n = parse({"lit": v["lit"]})
    return lit(n.value, n.option("type"))


def bucket(c: Column, d: Dimension) -> Column:
    """The first bucket whose lower <= value < upper; none, null."""
    out = None
    for b in d.buckets:
        hit = F.lit(True)
        if b.lower is not None:
            hit = hit & (c >= b.lower)
        if b.upper is not None:
            hit = hit & (c < b.upper)
        out = F.when(hit & c.isNotNull(), b.name) if out is None else out.when(hit & c.isNotNull(), b.name)
    return out


def temporal_dims(dims: dict[str, Dimension]) -> list[str]:
    return [n for n, d in dims.items() if d.kind == "temporal" or is_temporal(d.data_type)]
