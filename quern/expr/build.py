"""From a tree to a Spark Column."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ModelError
from ..functions import AGGREGATES, lookup
from ..types import parse_type, truncate
from .tree import Node

_OPERATORS: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "%": lambda a, b: F.try_mod(a, b), "safe_divide": F.try_divide,
    "=": lambda a, b: a == b, "<=>": lambda a, b: a.eqNullSafe(b), "is_distinct": lambda a, b: ~a.eqNullSafe(b), "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "not": lambda a: ~a, "negate": lambda a: -a, "is_null": lambda a: a.isNull(), "is_not_null": lambda a: a.isNotNull(), "between": lambda x, a, b: x.between(a, b),
}


def literal_column(n: Node) -> Column:
    kind, v = n.option("type"), n.value
    if isinstance(v, str) and kind in ("date", "timestamp"):
        v = date.fromisoformat(v) if kind == "date" else datetime.fromisoformat(v)
    c = F.lit(v)
    return c.cast(parse_type(kind)) if kind else c


def build(n: Node, field: Callable[[str], Column]) -> Column:
    """The Column of a tree; field gives the Column of a name. Division by zero is null."""
    if n.op == "lit":
        return literal_column(n)
    if n.op == "field":
        return field(n.value)
    sub = lambda k: build(n.args[k], field)
    if n.op == "case":
        out = None
        for k in range(0, len(n.args) - 1, 2):
            out = F.when(sub(k), sub(k + 1)) if out is None else out.when(sub(k), sub(k + 1))
        return out.otherwise(sub(len(n.args) - 1))
    if n.op == "in":
        hit = sub(0).isin(*[sub(k) for k in range(1, len(n.args))])
        return ~hit if n.option("negated") else hit
    if n.op == "cast":
        t = parse_type(n.value)
        return sub(0).try_cast(t) if n.option("safe") else sub(0).cast(t)
    if n.op == "agg":
        x = sub(0) if n.args else F.lit(1)
        if flt := n.option("filter"):
            x = F.when(build(flt, field), x)
        return AGGREGATES[n.value](x, *[a.value for a in n.args[1:]])
    if n.value in ("and", "or"):
        out = sub(0)
        for k in range(1, len(n.args)):
            out = out & sub(k) if n.value == "and" else out | sub(k)
        return out
    if n.value in ("like", "ilike"):
        return getattr(F, n.value)(sub(0), sub(1))
    if n.value in _OPERATORS:
        return _OPERATORS[n.value](*[sub(k) for k in range(len(n.args))])
    if n.value == "date_trunc":
        return truncate(sub(1), str(n.args[0].value), None)
    f = lookup(n.value, len(n.args))
    return _call(f, n, field)


#: Arguments that builders take as plain values.
_PLAIN = {
    "concat_ws": {0}, "translate": {1, 2}, "round": {1}, "date_part": {0}, "extract": {0}, "date_add": {1, 2}, "date_sub": {1, 2}, "date_diff": {0},
    "regexp_match": {1, 2}, "regexp_extract": {1, 2},
}


def _call(f, n: Node, field: Callable[[str], Column]) -> Column:
    plain = _PLAIN.get(f.name, set())
    if f.name == "date_diff" and len(n.args) == 2:
        plain = set()
    args = [a.value if k in plain and a.op == "lit" else build(a, field) for k, a in enumerate(n.args)]
    try:
        return f.build(*args)
    except (TypeError, ValueError) as e:
        if isinstance(e, ModelError):
            raise
        raise ModelError("EXPR_E_ARGUMENT", f"{f.name}: {e}") from e
