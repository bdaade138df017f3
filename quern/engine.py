"""The engine: a model, its sources, and requests that become lazy DataFrames."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from .errors import QuernError, RequestError
from .expr import Node, build, fields, lit, parse
from .model import Kind, Measure, Model, load
from .operators import aggregate, relational, temporal, windows
from .plans import adhoc
from .plans.context import Plan, finish, quoted, temporal_dims
from .plans.kinds import rows
from .request import Request, request
from .sources import Sources


class Engine:
    """Answers requests against one model. frames: DataFrames that stand for datasets or tables, by name."""

    def __init__(self, spark: SparkSession, model: Model | dict | str, frames: dict[str, DataFrame] | None = None, catalogs: dict[str, str] | None = None, fanout: str = "guard"):
        self.spark, self.model = spark, model if isinstance(model, Model) else load(model)
        self.sources, self.fanout = Sources(spark, frames, catalogs), fanout

    # what the model has

    def schema(self) -> dict[str, dict[str, list[str]]]:
        return {k.name: {"kind": [k.kind], "dimensions": [*k.dimensions], "measures": [*k.measures], "metrics": [*k.metrics]} for k in self.model.kinds.values()}

    def validate(self, raw: dict | Request) -> list[str]:
        """What is wrong with a request; nothing if it can be answered."""
        try:
            self.query(raw)
        except (QuernError, AnalysisException) as e:  # Spark finds types that don't fit
            return [str(e)]
        return []

    def drift(self, stored: dict[str, dict]) -> list[str]:
        """How datasets' columns differ from stored ones ({dataset: {column: type, or [type, whether it may be null]}})."""
        out = []
        for name, was in stored.items():
            fields_now = self.sources.rows(self.model.kinds[name]).schema.fields
            now, may = {f.name: f.dataType.simpleString() for f in fields_now}, {f.name: f.nullable for f in fields_now}
            null = {c: t[1] for c, t in was.items() if not isinstance(t, str)}
            was = {c: t if isinstance(t, str) else t[0] for c, t in was.items()}
            out += [f"{name}: {c} {'may' if may[c] else 'can no longer'} be null" for c, n in null.items() if c in may and may[c] != n]
            out += [f"{name}: {c} is gone" for c in was if c not in now]
            out += [f"{name}: {c} is new" for c in now if c not in was]
            out += [f"{name}: {c} was {t}, is {now[c]}" for c, t in was.items() if c in now and now[c] != t]
        return out

    def columns(self, nullable: bool = False) -> dict[str, dict]:
        """Columns of datasets with their types, as drift() takes them; with nullable, also whether they may be null."""
        told = lambda f: [f.dataType.simpleString(), f.nullable] if nullable else f.dataType.simpleString()
        return {k.name: {f.name: told(f) for f in self.sources.rows(k).schema.fields} for k in self.model.kinds.values() if k.kind == "dataset"}

    # requests

    def query(self, raw: dict | Request) -> DataFrame:
        return self._plan(request(raw))[0]

    def explain(self, raw: dict | Request) -> str:
        """The plan's steps in words, then Spark's plan."""
        df, notes = self._plan(request(raw))
        return "\n".join(notes) + "\n" + df._jdf.queryExecution().toString()

    def _source(self, r: Request) -> Kind:
        if r.source is not None:
            k = self.model.kinds.get(r.source)
            if k is None:
                raise RequestError("PLAN_E_SOURCE", f"no kind {r.source}")
            return k
        wanted = {windows.split(n)[0] for n in r.select} | {f.field for f in r.filters}
        if "*" in wanted:
            raise RequestError("PLAN_E_SOURCE", "* needs a source")
        known = set().union(*(k.fields() for k in self.model.kinds.values()))
        if unknown := sorted(wanted - known):
            raise RequestError("PLAN_E_UNKNOWN", f"no field {unknown}")
        names = adhoc.cover(self.model, wanted)
        return self.model.kinds[names[0]] if len(names) == 1 else adhoc.joined(self.model, names)

    def _plan(self, r: Request) -> tuple[DataFrame, list[str]]:
        k = self._source(r)
        select = [n for s in r.select for n in ([*k.dimensions, *k.measures, *k.metrics] if s == "*" else [s])]
        for n in select:
            if windows.split(n)[0] not in k.fields() | {*k.primary}:
                raise RequestError("PLAN_E_UNKNOWN", f"{k.name} has no field {n}")
        for n in r.named:
            if n not in k.filters:
                raise RequestError("PLAN_E_FILTER", f"{k.name} has no filter {n}")
        is_dim = lambda n: n in k.dimensions or n in k.primary
        results = {*k.measures, *k.metrics}
        group = tuple(dict.fromkeys(b for n in select if is_dim(b := windows.split(n)[0])))
        for f in r.filters:
            if f.field not in results and not is_dim(f.field):
                raise RequestError("PLAN_E_UNKNOWN", f"{k.name} has no field {f.field}")
        below = tuple(f.predicate for f in r.filters if is_dim(f.field))
        above = [f.predicate for f in r.filters if not is_dim(f.field)] + [n for n in k.filters.values() if fields(n) & results - set(k.dimensions)]
        named = [windows.split(n)[0] for n in select] + [f for n in above for f in fields(n)]
        measures: dict[str, Measure] = {}
        for n in named:
            self._collect(k, n, (), measures)
        self._constraints(k, [n for n in named if n in results], {*group, *(f.field for f in r.filters if is_dim(f.field))})
        grains = dict(r.grains)
        times = [d for d in temporal_dims({n: d for n, d in k.dimensions.items() if n in group})]
        if r.grain:
            grains |= {d: r.grain for d in times if d not in grains}
        for d, g in grains.items():
            if d not in k.dimensions:
                raise RequestError("PLAN_E_GRAIN", f"{k.name} has no dimension {d}")
            if (allowed := k.dimensions[d].grains) and g not in allowed:
                raise RequestError("PLAN_E_GRAIN", f"{d} has no grain {g}")
        axes = tuple(dict.fromkeys(a for m in measures.values() for a in m.axes if a not in group or a in grains))
        from .model import Dimension

        dims = {n: k.dimensions.get(n, Dimension(n)) for n in dict.fromkeys([*group, *(f for n in below for f in fields(n)), *axes])}
        p = Plan(self.sources, dims, measures, group, below, grains, axes, r.as_of, r.between, self.fanout)
        df = aggregate.aggregate(p, finish(p, rows(p, k)))
        p.note(f"group by {', '.join(group) or 'nothing'}: {', '.join(measures) or 'distinct rows'}")
        if r.fill_gaps:
            df = self._filled(k, p, df)
        return self._above(r, k, p, df, select, above), p.notes

    def _filled(self, k: Kind, p: Plan, df: DataFrame) -> DataFrame:
        """The aggregate with a row for each period that a series misses between its first and last, without values."""
        axis = next(iter(temporal_dims({n: p.dims[n] for n in p.group})), None)
        if axis is None:
            raise RequestError("PLAN_E_GAPS", "filling gaps needs a temporal dimension in the request")
        grain = p.grains.get(axis) or next((x.temporal.grain for x in k.leaves() if x.temporal and x.temporal.grain), None)
        if grain is None:
            raise RequestError("PLAN_E_GAPS", f"filling gaps of {axis} needs its grain")
        p.note(f"fill gaps of {axis} by {grain}")
        return temporal.fill_gaps(df, axis, grain, [g for g in p.group if g != axis])

    def _collect(self, k: Kind, name: str, extra: tuple[Node, ...], out: dict[str, Measure], tag: str = "") -> None:
        """The measures that a field needs; those of a filtered metric under names of their own."""
        name = windows.split(name)[0]
        if name in k.measures:
            m = k.measures[name]
            own = f"{name}{tag}"
            out[own] = replace(m, name=own, expr=m.expr or (parse({"col": name}) if tag else None), filters=(*m.filters, *extra)) if tag else m
        elif name in k.metrics:
            x = k.metrics[name]
            results = {*k.measures, *k.metrics}
            push = tuple(n for n in x.filters if not fields(n) & results)
            if any(fields(n) & results and fields(n) - results for n in x.filters):
                raise RequestError("PLAN_E_FILTER", f"a filter of {name} mixes dimensions and measures")
            for f in fields(x.expr):
                self._collect(k, f, (*extra, *push), out, f"{tag}@{name}" if push else tag)

    def _value(self, k: Kind, p: Plan, name: str, tag: str = "") -> Column:
        """A measure's or metric's column above the aggregate."""
        base, how = windows.split(name)
        if how:
            axis = next(iter(temporal_dims({n: p.dims[n] for n in p.group})), None)
            if axis is None:
                raise RequestError("PLAN_E_ACCESSOR", f"{name} needs a temporal dimension in the request")
            return windows.accessor(self._value(k, p, base, tag), how, [g for g in p.group if g != axis], axis)
        if base in k.measures:
            return quoted(f"{base}{tag}")
        if base in k.metrics:
            x = k.metrics[base]
            results = {*k.measures, *k.metrics}
            own = f"{tag}@{base}" if any(not fields(n) & results for n in x.filters) else tag
            c = build(x.expr, lambda f: self._value(k, p, f, own))
            for n in x.filters:
                if fields(n) & results:
                    c = F.when(build(n, lambda f: self._value(k, p, f, own)), c)
            return c.cast(x.data_type) if x.data_type is not None else c
        if base not in p.group:
            raise RequestError("PLAN_E_DIMENSION", f"{base} must be selected to be used in a metric")
        return quoted(base)

    def _above(self, r: Request, k: Kind, p: Plan, df: DataFrame, select: list[str], above: list[Node]) -> DataFrame:
        if above:  # before windows, as filters of the aggregate
            df = df.filter(reduce(lambda a, b: a & b, [build(n, lambda f: self._value(k, p, f)) for n in above]))
        df = relational.project(df, [(n, self._value(k, p, n)) for n in select])
        if r.order_by:
            df = relational.sort(df, [(o.field, o.descending, o.nulls) for o in r.order_by])
        if r.limit is not None or r.offset:
            df = relational.fetch(df, r.limit, r.offset)
        return df

    def _constraints(self, k: Kind, names: list[str], scope: set[str]) -> None:
        for n in names:
            x = k.measures.get(n) or k.metrics.get(n)
            c = x.constraints
            if c.one_of and not scope & set(c.one_of):
                raise RequestError("PLAN_E_CONSTRAINT", f"{n} needs one of {list(c.one_of)}")
            if bad := sorted(scope & set(c.none_of)):
                raise RequestError("PLAN_E_CONSTRAINT", f"{n} can't be had by {bad}")
            if missing := sorted(set(c.all) - scope):
                raise RequestError("PLAN_E_CONSTRAINT", f"{n} needs {missing}")
            agg = getattr(x, "agg", None)
            if agg and (c.allowed and agg not in c.allowed or agg in c.prohibited):
                raise RequestError("PLAN_E_CONSTRAINT", f"{n} can't be aggregated by {agg}")


def answer(spark: SparkSession, model: dict, frames: dict[str, DataFrame], raw: dict[str, Any], **options) -> DataFrame:
    """One request against one model."""
    return Engine(spark, model, frames, **options).query(raw)


__all__ = ["Engine", "answer", "lit"]
