"""Rows of each kind. Every builder gives rows with semantic names, so kinds nest; aggregation happens once, above."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..expr import build, fields, fold, substitute
from ..model import Kind
from ..operators import temporal
from ..operators.aggregate import merge_states, state
from ..types import finer_or_equal, rank, widest
from .context import AXIS, INPUT, Frame, Leaf, Plan, finish, quoted, temporal_dims, typed_null
from .joins import join_rows


def rows(p: Plan, k: Kind) -> Frame:
    return {"dataset": dataset_rows, "unionset": union_rows, "grainset": grain_rows, "joinset": lambda p, k: join_rows(p, k, rows, provides)}[k.kind](p, k)


def provides(p: Plan, k: Kind) -> set[str]:
    """Which of the plan's fields a kind has values for."""
    if k.kind == "dataset":
        leaf = Leaf(k, p.sources.rows(k))
        return {d for d in p.dims if leaf.has(d)} | {n for n, m in p.measures.items() if leaf.provides(m)}
    return set().union(*(provides(p, c) for c in k.children))


def _ruled_out(p: Plan, known: dict) -> bool:
    """Whether fields of known value contradict the request's filters."""
    return any(n.op == "lit" and n.value in (False, None) for n in (fold(substitute(f, known)) for f in p.filters))


def contradicted(p: Plan, k: Kind) -> bool:
    """Whether what is known of a kind before reading rules all of its rows out."""
    if k.kind != "dataset":
        return all(contradicted(p, c) for c in k.children)
    return all(_ruled_out(p, Leaf(k, df, at).known()) for df, at in p.sources.parts(k))


def _own_filters(k: Kind) -> list:
    """Filters of the kind on rows; those on measures are applied above the aggregate."""
    return [n for n in k.filters.values() if not fields(n) & ({*k.measures, *k.metrics} - set(k.dimensions))]


def dataset_rows(p: Plan, k: Kind) -> Frame:
    """Rows of a dataset's sources; those whose location or literals contradict the request aren't read."""
    parts = p.sources.parts(k)
    if not k.has_places():  # one scan of all
        parts = [(p.sources.rows(k), parts[0][1] if len(parts) == 1 else None)]
    live = [x for x in parts if not _ruled_out(p, Leaf(k, *x).known())]
    if len(live) < len(parts):
        p.note(f"skip {len(parts) - len(live)} of {len(parts)} sources of {k.name}")
    frames = [_source_rows(p, k, *x) for x in live or parts[:1]]
    p.note(f"scan {k.name}")
    return Frame(_union(frames) if live else frames[0].limit(0))


def _source_rows(p: Plan, k: Kind, df: DataFrame, at: str | None) -> DataFrame:
    leaf = Leaf(k, df, at)
    if k.temporal is not None and k.temporal.axis and not p.history:
        if k.temporal.scd_type == "type1" and k.temporal.shape == "scd" and p.as_of is not None:
            p.note(f"PLAN_W_1730: {k.name} keeps no history, so as_of has no effect on it")
        axis = next((d for d, g in p.grains.items() if d == k.temporal.axis), None)
        df = temporal.select_rows(df, k.temporal, leaf.column, p.as_of, p.between, [leaf.column(f) for f in k.primary if leaf.has(f)], p.grains.get(axis), k.name)
    for n in _own_filters(k):
        df = df.filter(build(n, leaf.column))
    cols = []
    for name, d in p.dims.items():
        cols.append((leaf.column(name) if leaf.has(name) else typed_null(d.data_type)).alias(name))
    for name, m in p.measures.items():
        cols.append((leaf.input(m) if leaf.provides(m) else typed_null("bigint" if m.agg == "count" else m.data_type)).alias(INPUT.format(name)))
    return df.select(*cols) if cols else df.select(F.lit(1).alias("__row"))


def _union(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns by name; null columns take the others' types, and numbers and times the widest of theirs."""
    if len(frames) == 1:
        return frames[0]
    kinds: dict = {}
    for df in frames:
        for f in df.schema.fields:
            kinds[f.name] = widest(f.name, kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    cast = [df.select(*[(quoted(f.name) if f.dataType == kinds[f.name] else quoted(f.name).cast(kinds[f.name])).alias(f.name) for f in df.schema.fields]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b), cast)


def union_rows(p: Plan, k: Kind) -> Frame:
    """UNION ALL of the children's rows; `unique` drops equal rows of what each child aggregates to, as sets of results."""
    live = [c for c in k.children if not contradicted(p, c)]
    if not live:
        raise RequestError("PLAN_E_COVER", f"no child of {k.name} can have such rows")
    have = {c.name: provides(p, c) for c in live}
    useful = [c for c in live if have[c.name] & set(p.measures) or not p.measures] or live
    p.note(f"union {k.mode} of {', '.join(c.name for c in useful)}")
    parts = []
    for c in useful:
        f = rows(p, c)
        df = f.df
        if k.mode == "unique":
            parts.append(merge_states(p, finish(p, f)))
            continue
        parts.append(df if not f.done else df)
    done = k.mode == "unique"
    df = _union(parts)
    for n in _own_filters(k):
        df = df.filter(build(n, quoted))
    return Frame(df.distinct() if done else df, done)


def _grain(k: Kind) -> str:
    return (k.temporal.grain if k.temporal and k.temporal.grain else None) or max((_grain(c) for c in k.children), key=rank, default="second")


def grain_rows(p: Plan, k: Kind) -> Frame:
    """Each measure from the coarsest grain that has it, the dimensions, and that the request's grain can be made of.

    Children of one grain stand beside each other as an implicit union: all of them that have the measure count, and
    dimensions that one of them lacks are null in its rows.
    """
    times = [d for d in temporal_dims(p.dims) if d in p.group]
    wanted = min((p.grains.get(d, "second") for d in times), key=rank, default=None)
    filtered = {f for n in p.filters for f in fields(n)}
    if filtered & set(temporal_dims(p.dims)):  # a range may cut coarse periods
        wanted = min([wanted or "year", "day" if all(_grain(c) in ("day", *map(str, ("week", "month", "quarter", "year"))) for c in k.children) else "second"], key=rank)
    have = {c.name: provides(p, c) for c in k.children}
    units: dict[str, list[Kind]] = {}
    for c in sorted(k.children, key=lambda c: -rank(_grain(c))):
        g = _grain(c)
        if wanted is None or finer_or_equal(g, wanted) or (g == _finest(k) and wanted == "second"):
            units.setdefault(g, []).append(c)
    fit = [u for u in units.values() if set(p.dims) <= set().union(*(have[c.name] for c in u))]
    if not fit:
        raise RequestError("PLAN_E_COVER", f"no child of {k.name} has {sorted(p.dims)} at grain {wanted}")
    chosen: dict[str, list[str]] = {}
    for n, m in p.measures.items():
        able = [own for u in fit if (own := [c for c in u if n in have[c.name]]) and all(_mergeable(c, m.agg) for c in own)]
        if not able:
            raise RequestError("PLAN_E_COVER", f"no child of {k.name} has {n} at grain {wanted}")
        for c in able[0]:
            chosen.setdefault(c.name, []).append(n)
    if not p.measures:
        chosen |= {c.name: [] for c in fit[0]}
    parts = []
    for c in (c for u in fit for c in u):
        if c.name in chosen and not contradicted(p, c):
            p.note(f"grain {_grain(c)}: {c.name} for {', '.join(chosen[c.name]) or 'its dimensions'}")
            own = p.part(measures={n: p.measures[n] for n in chosen[c.name]})
            df = rows(own, c).df
            missing = [n for n in p.measures if n not in chosen[c.name]]
            parts.append(df.withColumns({INPUT.format(n): typed_null("bigint" if p.measures[n].agg == "count" else p.measures[n].data_type) for n in missing}) if missing else df)
    if not parts:
        raise RequestError("PLAN_E_COVER", f"no child of {k.name} can have such rows")
    df = _union(parts)
    for n in _own_filters(k):
        df = df.filter(build(n, quoted))
    return Frame(df)


def _finest(k: Kind) -> str:
    return min((_grain(c) for c in k.children), key=rank)


def _mergeable(c: Kind, agg: str) -> bool:
    return not any(x.pre_aggregated for x in c.leaves()) or agg in ("sum", "count", "min", "max")


__all__ = ["rows", "provides", "AXIS", "state"]
