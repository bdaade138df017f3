"""Requests without a source: which kinds together have the fields, and how they are joined."""

from __future__ import annotations

from collections import deque
from dataclasses import replace

from ..errors import RequestError
from ..model import Kind, Model, Relationship


def paths(model: Model, start: str, goals: set[str]) -> list[list[Relationship]]:
    """The shortest ways from a kind to any of the goals along the model's relationships."""
    queue, best, out = deque([(start, [])]), {start: 0}, []
    while queue:
        here, way = queue.popleft()
        if out and len(way) > len(out[0]):
            break
        if here in goals and way:
            out.append(way)
            continue
        for r in model.relationships:
            for a, b in ((r.source, r.target), (r.target, r.source)):
                if a == here and best.get(b, 99) >= len(way) + 1:
                    best[b] = len(way) + 1
                    queue.append((b, [*way, r]))
    return out


def cover(model: Model, wanted: set[str]) -> list[str]:
    """Kinds that have all fields: one if one has, else the greedy choice by measures, dimensions, and plain before complex."""
    kinds = list(model.kinds.values())

    def score(k: Kind, left: set[str]) -> tuple:
        return len(left & {*k.measures, *k.metrics}), len(left & set(k.dimensions)), k.kind == "dataset"

    whole = [k for k in kinds if wanted <= k.fields()]
    if whole:
        return [max(whole, key=lambda k: (k.kind == "dataset", -len(k.fields()))).name]
    chosen, left = [], set(wanted)
    while left:
        able = [k for k in kinds if k.name not in chosen and left & k.fields() and (not chosen or paths(model, k.name, set(chosen)))]
        if not able:
            raise RequestError("PLAN_E_COVER", f"nothing that can be joined has {sorted(left)}")
        best = max(able, key=lambda k: score(k, left))
        chosen.append(best.name)
        left -= best.fields()
    return chosen


def joined(model: Model, names: list[str]) -> Kind:
    """A joinset of the chosen kinds and those that bridge them."""
    have, rels = [names[0]], []
    for n in names[1:]:
        ways = paths(model, n, set(have))
        if len({tuple(r.name for r in w) for w in ways}) > 1:
            raise RequestError("PLAN_E_0500", f"{n} can be joined in several ways: {[[r.name for r in w] for w in ways]}")
        for r in ways[0]:
            if r not in rels:
                rels.append(r)
            have += [x for x in (r.source, r.target) if x not in have]
    children = tuple(model.kinds[n] for n in have)
    merged = {f: {k: v for c in reversed(children) for k, v in getattr(c, f).items()} for f in ("dimensions", "measures", "metrics")}
    return replace(Kind("joinset", "+".join(have)), children=children, relationships=tuple(rels), **merged)
