"""Joinsets: children joined along their relationships, with a guard against rows that a join repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..errors import RequestError
from ..expr import build, fields
from ..model import Dimension, Kind, Relationship
from ..operators import temporal
from ..operators.aggregate import MERGE
from .context import AXIS, INPUT, Frame, Plan, finish, quoted

_REVERSED = {"inner": "inner", "left": "right", "right": "left", "full": "full"}


def order(k: Kind, anchor: str) -> list[tuple[Relationship, str, bool]]:
    """Breadth-first from the anchor: (relationship, the child it brings in, whether walked backwards)."""
    out, seen, queue = [], {anchor}, [anchor]
    while queue:
        here = queue.pop(0)
        for r in k.relationships:  # forward edges first
            if r.source == here and r.target not in seen:
                out.append((r, r.target, False))
                seen.add(r.target)
                queue.append(r.target)
        for r in k.relationships:
            if r.target == here and r.source not in seen:
                out.append((r, r.source, True))
                seen.add(r.source)
                queue.append(r.source)
    if lost := {c.name for c in k.children} - seen:
        raise RequestError("PLAN_E_PATH", f"{k.name}: nothing joins {sorted(lost)} to {anchor}")
    return out


def repeated(steps: list[tuple[Relationship, str, bool]], anchor: str) -> set[str]:
    """Children whose rows the joins may repeat: all on the `one` side of an edge."""
    edges = [r for r, _, _ in steps]
    out: set[str] = set()
    for r in edges:
        rest = [x for x in edges if x is not r]

        def side(start: str, rest=rest) -> set[str]:
            found, queue = {start}, [start]
            while queue:
                here = queue.pop()
                for x in rest:
                    for a, b in ((x.source, x.target), (x.target, x.source)):
                        if a == here and b not in found:
                            found.add(b)
                            queue.append(b)
            return found

        if r.cardinality in ("many_to_one", "many_to_many"):
            out |= side(r.target)
        if r.cardinality in ("one_to_many", "many_to_many"):
            out |= side(r.source)
    return out


def check_as_of(k: Kind, r: Relationship, by_name: dict[str, Kind], back: bool) -> None:
    """An as-of join goes from rows that have a time to versions or snapshots, forwards, as an inner or left join."""
    a, b = by_name[r.source].temporal, by_name[r.target].temporal
    if a is None or b is None or not a.axis or not b.axis:
        raise RequestError("PLAN_E_1721", f"{k.name}.{r.name}: both sides of an as-of join need a time")
    versions = b.shape == "scd" and b.scd_type != "type1" and b.until
    if a.shape == "scd" or not (versions or (b.shape == "snapshot" and a.shape != "snapshot")):
        raise RequestError("PLAN_E_1720", f"{k.name}.{r.name}: no as-of join from {a.shape} to {b.shape}")
    if back or r.how not in ("inner", "left") or r.filter is not None or r.cardinality not in ("many_to_one", "one_to_one"):
        raise RequestError("PLAN_E_1720", f"{k.name}.{r.name}: an as-of join goes forwards to one row, inner or left, without a filter")


def as_of(df, right, r: Relationship, by_name: dict[str, Kind], name):
    """df with the version of the target that held, or the last snapshot taken, at each row's time."""
    a, b = by_name[r.source].temporal, by_name[r.target].temporal
    keys = [f"__key{n}" for n in range(len(r.keys))]
    left = df.withColumns({x: build(own, lambda f: quoted(name(r.source, f))) for x, (own, _) in zip(keys, r.keys, strict=True)})
    right = right.withColumns({x: build(own, lambda f: quoted(name(r.target, f))) for x, (_, own) in zip(keys, r.keys, strict=True)} | {"__met": F.lit(True)})
    take = [c for c in right.columns if c not in keys]
    right = right.filter(reduce(lambda x, y: x & y, [quoted(x).isNotNull() for x in keys]))
    out = temporal.asof_join(left, right, keys, name(r.source, a.axis), name(r.target, b.axis), take, name(r.target, b.until) if b.until else None)
    return (out.filter("__met") if r.how == "inner" else out).drop(*keys, "__met")


def join_rows(p: Plan, k: Kind, rows, provides) -> Frame:
    have = {c.name: provides(p, c) for c in k.children}
    wanted = {*p.dims, *p.measures}
    # the child that has most of what is asked for; the last of equals
    anchor = max(enumerate(k.children), key=lambda x: (len(have[x[1].name] & wanted), x[0]))[1].name
    steps = order(k, anchor)
    line = [anchor, *(c for _, c, _ in steps)]
    by_name = {c.name: c for c in k.children}
    explicit = {c.name: set((c.mapping or {})) for c in k.children}
    owner = {}
    for f in wanted:
        able = [c for c in line if f in have[c]]
        owner[f] = next((c for c in able if f in explicit[c]), able[0] if able else None)
    if missing := sorted(f for f in wanted if owner[f] is None):
        raise RequestError("PLAN_E_COVER", f"no child of {k.name} has {missing}")
    fanned = repeated(steps, anchor) if p.fanout == "guard" else set()
    counted = {c for c in line if c in fanned and any(owner[m] == c for m in p.measures)}
    for c in counted:
        if not by_name[c].primary:
            raise RequestError("PLAN_E_FANOUT", f"{k.name} repeats rows of {c}, which has no primary key to tell them apart")
    keys: dict[str, list] = {c: [] for c in line}
    for r, _, _ in steps:
        keys[r.source] += [a for a, _ in r.keys]
        keys[r.target] += [b for _, b in r.keys]
    number = {c: n for n, c in enumerate(line)}
    name = lambda c, f: f"__{number[c]}_{f}"

    def side(c: str):
        extra = {f for n in keys[c] for f in fields(n)} | (set(by_name[c].primary) if c in counted else set())
        for r, _, _ in steps:
            if r.filter is not None:
                extra |= {f.split(".")[-1] for f in fields(r.filter) if f.split(".")[0] == c or ("." not in f and r.target == c)}
            if r.as_of and c in (r.source, r.target):
                t = by_name[c].temporal
                extra |= {t.axis} | ({t.until} if r.target == c and t.until else set())
        dims = {d: p.dims[d] for d in p.dims if owner[d] == c} | {f: by_name[c].dimensions.get(f, Dimension(f)) for f in extra if f not in p.dims or owner.get(f) != c}
        part = p.part(dims=dims, measures={m: x for m, x in p.measures.items() if owner[m] == c}, filters=(), grains={}, axes=(), group=tuple(dims), history=any(r.as_of and r.target == c for r, _, _ in steps))
        df = rows(part, by_name[c]).df
        return df.select(*[quoted(x).alias(name(c, x)) for x in df.columns])

    for r, _, back in steps:
        if r.as_of:
            check_as_of(k, r, by_name, back)
    df = side(anchor)
    p.note(f"join from {anchor}")
    for r, c, back in steps:
        if r.as_of:
            df = as_of(df, side(c), r, by_name, name)
            p.note(f"{r.how} join {c} as of {by_name[r.source].temporal.axis}")
            continue
        right = side(c)
        on = [build(a, lambda f, r=r: quoted(name(r.source, f))) == build(b, lambda f, r=r: quoted(name(r.target, f))) for a, b in r.keys]
        if r.filter is not None:
            def at(f, r=r):
                head, _, tail = f.rpartition(".")
                return quoted(name(head or r.target, tail))
            on.append(build(r.filter, at))
        how = _REVERSED[r.how] if back else r.how
        p.note(f"{how} join {c} ({r.cardinality}{', backwards' if back else ''})")
        df = df.join(right, reduce(lambda a, b: a & b, on), how)
    dims = [quoted(name(owner[d], d)).alias(d) for d in p.dims]
    inputs = lambda ms: [quoted(name(owner[m], INPUT.format(m))).alias(INPUT.format(m)) for m in ms]
    for n in k.filters.values():
        if not fields(n) & ({*k.measures, *k.metrics} - set(k.dimensions)):
            df = df.filter(build(n, lambda f: quoted(name(owner.get(f) or next(c for c in line if name(c, f) in df.columns), f))))
    if not counted:
        return Frame(df.select(*dims, *inputs(p.measures)))
    axes = [AXIS.format(a) for a in p.axes]
    groups = [*p.group, *axes]
    plain = [m for m in p.measures if owner[m] not in counted]
    if len(counted) == 1 and all(p.measures[m].agg in MERGE for m in plain):
        # one pass over the join: the other sides' measures add up in each group for each row of the repeated child, which so stands once
        c = next(iter(counted))
        ids = [quoted(name(c, f)).alias(f"__id_{f}") for f in by_name[c].primary]
        full = finish(p, Frame(df.select(*dims, *inputs(p.measures), *ids)))
        once = [(MERGE[p.measures[m].agg] if m in plain else F.any_value)(quoted(INPUT.format(m))).alias(INPUT.format(m)) for m in p.measures]
        p.note(f"rows of {c} once a group")
        return Frame(full.groupBy(*map(quoted, groups), *[quoted(f"__id_{f}") for f in by_name[c].primary]).agg(*once).select(*map(quoted, groups), *[quoted(INPUT.format(m)) for m in p.measures]), True)
    # measures of repeated children: once for each of their rows in each group
    ids = {c: [quoted(name(c, f)).alias(f"__id_{number[c]}_{f}") for f in by_name[c].primary] for c in counted}
    full = finish(p, Frame(df.select(*dims, *inputs(p.measures), *[i for c in counted for i in ids[c]])))
    types = dict(full.dtypes)
    parts = []
    if plain:
        parts.append(plain)
    parts += [[m for m in p.measures if owner[m] == c] for c in counted]
    frames = []
    for own in parts:
        c = owner[own[0]]
        x = full
        if c in counted:
            mine = [f"__id_{number[c]}_{f}" for f in by_name[c].primary]
            x = x.filter(reduce(lambda a, b: a & b, [quoted(i).isNotNull() for i in mine])).dropDuplicates([*groups, *mine])
            p.note(f"rows of {c} once a group")
        frames.append(x.select(*map(quoted, groups), *[(quoted(INPUT.format(m)) if m in own else F.lit(None).cast(types[INPUT.format(m)])).alias(INPUT.format(m)) for m in p.measures]))
    if not plain:  # groups that only the join makes stay
        frames.append(full.select(*map(quoted, groups), *[F.lit(None).cast(types[INPUT.format(m)]).alias(INPUT.format(m)) for m in p.measures]).distinct())
    return Frame(reduce(lambda a, b: a.unionByName(b), frames), True)
