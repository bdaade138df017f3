"""Requests: which fields, of what, under which filters."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .errors import RequestError
from .expr import Node

_OPERATORS = {"eq": "=", "=": "=", "not_eq": "<>", "ne": "<>", "!=": "<>", "<>": "<>", "lt": "<", "<": "<", "lt_eq": "<=", "lte": "<=", "<=": "<=", "gt": ">", ">": ">", "gt_eq": ">=", "gte": ">=", ">=": ">="}


@dataclass(frozen=True)
class Filter:
    field: str
    predicate: Node


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False
    nulls: str | None = None


@dataclass(frozen=True)
class Request:
    select: tuple[str, ...]
    source: str | None = None
    filters: tuple[Filter, ...] = ()
    grains: tuple[tuple[str, str], ...] = ()
    grain: str | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    as_of: Any = None
    between: tuple[Any, Any] | None = None
    named: tuple[str, ...] = ()
    variables: tuple[tuple[str, Any], ...] = ()
    fill_gaps: bool = False


def _filter(raw: Any) -> Filter:
    if isinstance(raw, (list, tuple)):
        raw = dict(zip(("field", "op", "value"), raw, strict=False))
    name, op = raw["field"], str(raw.get("op", "eq")).lower()
    f, v = Node("field", name), raw.get("value")
    wrap = lambda x: x if isinstance(x, Node) else Node("lit", x)
    if op in _OPERATORS:
        n = Node("call", _OPERATORS[op], (f, wrap(v)))
    elif op in ("in", "not_in"):
        if not v:
            raise RequestError("PLAN_E_FILTER", f"{name}: in needs values")
        n = Node("in", None, (f, *map(wrap, v)), (("negated", op == "not_in"),))
    elif op == "between":
        low, high = v
        n = Node("call", "between", (f, wrap(low), wrap(high)))
    elif op in ("is_null", "is_not_null"):
        n = Node("call", op, (f,))
    else:
        raise RequestError("PLAN_E_FILTER", f"{name}: unknown operator {op}")
    return Filter(name, n)


def _order(raw: Any) -> Order:
    if isinstance(raw, str):
        return Order(raw.lstrip("-"), raw.startswith("-"))
    if isinstance(raw, (list, tuple)):
        raw = dict(zip(("field", "direction", "nulls"), raw, strict=False))
    return Order(raw["field"], str(raw.get("direction", "asc")).lower() == "desc", raw.get("nulls"))


def request(raw: dict | Request) -> Request:
    """A request from its plain form. select takes names, "*", or {name, grain}."""
    if isinstance(raw, Request):
        return raw
    names, grains = [], []
    for x in raw.get("select") or ():
        if isinstance(x, dict):
            grains.append((x["name"], x["grain"]))
            x = x["name"]
        names.append(x)
    if not names:
        raise RequestError("PLAN_E_EMPTY", "nothing is selected")
    if dup := {n for n in names if names.count(n) > 1}:
        raise RequestError("PLAN_E_DUPLICATE", f"{sorted(dup)} are selected twice")
    named = tuple(f for f in raw.get("filters") or () if isinstance(f, str))
    filters = tuple(_filter(f) for f in raw.get("filters") or () if not isinstance(f, str))
    if (limit := raw.get("limit")) is not None and limit < 0 or raw.get("offset", 0) < 0:
        raise RequestError("PLAN_E_LIMIT", "limit and offset can't be negative")
    return Request(tuple(names), raw.get("from"), filters, tuple(grains), raw.get("grain"), tuple(_order(o) for o in raw.get("order_by") or ()), limit, raw.get("offset", 0), raw.get("as_of"), tuple(raw["between"]) if raw.get("between") else None, named, tuple((raw.get("variables") or {}).items()), bool(raw.get("fill_gaps")))


