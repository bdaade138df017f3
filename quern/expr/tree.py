"""The tree of an expression, and what is done to it before Spark sees it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Node:
    """op: lit, field, call, agg, case, cast or in; value: the literal, the name, the function or the type."""

    op: str
    value: Any = None
    args: tuple[Node, ...] = ()
    options: tuple[tuple[str, Any], ...] = ()

    def option(self, name: str, default: Any = None) -> Any:
        return dict(self.options).get(name, default)


def lit(value: Any, kind: str | None = None) -> Node:
    return Node("lit", value, (), (("type", kind),) if kind else ())


def call(name: str, *args: Node) -> Node:
    return Node("call", name, args)


def walk(n: Node) -> Iterator[Node]:
    yield n
    for a in n.args:
        yield from walk(a)


def fields(n: Node) -> set[str]:
    return {x.value for x in walk(n) if x.op == "field"}


def transform(n: Node, f: Callable[[Node], Node]) -> Node:
    """f over the tree from the leaves up."""
    return f(replace(n, args=tuple(transform(a, f) for a in n.args)))


def substitute(n: Node, known: dict[str, Node]) -> Node:
    return transform(n, lambda x: known.get(x.value, x) if x.op == "field" else x)


_COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}


def _fold_one(n: Node) -> Node:
    values = [a.value for a in n.args]
    known = bool(n.args) and all(a.op == "lit" for a in n.args)
    if n.op == "call":
        if n.value in ("and", "or"):
            stop = n.value == "or"
            if any(a.op == "lit" and a.value is stop for a in n.args):
                return lit(stop)
            left = tuple(a for a in n.args if not (a.op == "lit" and a.value is (not stop)))
            return lit(not stop) if not left else left[0] if len(left) == 1 else replace(n, args=left)
        if n.value in ("is_null", "is_not_null") and known:
            return lit((values[0] is None) == (n.value == "is_null"))
        if known and n.value in _COMPARE | _ARITHMETIC:
            if None in values:
                return lit(None)
            try:
                return lit((_COMPARE | _ARITHMETIC)[n.value](*values))
            except TypeError:
                return n
        if known and n.value == "not":
            return lit(None if values[0] is None else not values[0])
        if known and n.value == "between" and None not in values:
            return lit(values[1] <= values[0] <= values[2])
    if n.op == "in" and known and None not in values:
        return lit((values[0] in values[1:]) != bool(n.option("negated")))
    if n.op == "case":
        pairs, otherwise = list(zip(n.args[:-1:2], n.args[1:-1:2], strict=True)), n.args[-1]
        left = []
        for when, then in pairs:
            if when.op == "lit" and when.value is True:
                otherwise = then
                break
            if not (when.op == "lit" and when.value in (False, None)):
                left.append((when, then))
        return replace(n, args=(*(x for p in left for x in p), otherwise)) if left else otherwise
    return n


def fold(n: Node) -> Node:
    """Constants worked out, branches that can't be taken gone; so that what a source lacks isn't asked of it."""
    return transform(n, _fold_one)
