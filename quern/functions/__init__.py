"""The functions that expressions may call: a name, how many arguments, and a builder of a Column.

Aggregates take `distinct` too. An extension adds names with register(); a name can't be taken twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ModelError


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int | None
    build: Callable[..., Column]
    kind: str = "scalar"


_ALL: dict[str, Function] = {}


def register(name: str, least: int, most: int | None, build: Callable[..., Column], kind: str = "scalar") -> None:
    name = name.lower()
    if name in _ALL:
        raise ModelError("FN_E_DUPLICATE", f"function {name} exists already")
    _ALL[name] = Function(name, least, most, build, kind)


def known(name: str) -> bool:
    return name.lower() in _ALL


def lookup(name: str, n: int) -> Function:
    f = _ALL.get(name.lower())
    if f is None:
        raise ModelError("FN_E_UNKNOWN", f"unknown function {name}")
    if n < f.least or (f.most is not None and n > f.most):
        raise ModelError("FN_E_ARITY", f"{name} takes {f.least}{'' if f.most == f.least else f' to {f.most}' if f.most else ' or more'} arguments, not {n}")
    return f


def names() -> list[str]:
    return sorted(_ALL)


def literal(c: Column | object):
    """A plain value where a builder needs one; expressions hand literals over as such."""
    if isinstance(c, Column):
        raise ModelError("FN_E_LITERAL", "this argument must be a literal")
    return c


def _trim(sql: str):
    def build(s, chars=None):
        f = {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[sql]
        return f(s) if chars is None else f(s, chars)

    return build


def _any_order(*fs) -> None:
    for name, least, most, build in fs:
        register(name, least, most, build)


_PARTS = {"year", "quarter", "month", "week", "day", "hour", "minute", "second", "dow", "doy", "dayofweek", "dayofyear"}


def _part(part, x):
    part = str(literal(part)).lower()
    if part not in _PARTS:
        raise ModelError("FN_E_PART", f"unknown date part {part}")
    return F.date_part(F.lit(part), x).cast("long")


def _shift(sign: int):
    """Dates stay dates when days or more are added; timestamps keep their time of day."""
    def build(d, amount, unit="day"):
        unit = str(literal(unit)).lower().rstrip("s")
        if isinstance(amount, Column):
            if unit != "day":
                raise ModelError("FN_E_LITERAL", "only days may vary by row")
            return d + (amount * sign).cast("int").cast("interval day")
        return d + F.expr(f"interval '{sign * int(amount)}' {unit}")

    return build


def _diff(*args):
    if len(args) == 2:
        return F.datediff(args[1], args[0]).cast("long")
    return F.timestamp_diff(str(literal(args[0])).upper(), args[1].cast("timestamp_ntz"), args[2].cast("timestamp_ntz"))


def _regexp_match(s, pattern, full=False):
    p = str(literal(pattern))
    return s.rlike(rf"\A(?:{p})\z" if full else p)  # $ would stand before a last line end, too


_any_order(
    ("upper", 1, 1, F.upper), ("lower", 1, 1, F.lower), ("length", 1, 1, F.length),
    ("substring", 2, 3, lambda s, pos, n=None: F.substring(s, pos, F.lit(2147483647) if n is None else n)),
    ("trim", 1, 2, _trim("both")), ("ltrim", 1, 2, _trim("leading")), ("rtrim", 1, 2, _trim("trailing")),
    ("concat", 1, None, F.concat), ("concat_ws", 2, None, lambda sep, *xs: F.concat_ws(str(literal(sep)), *xs)),
    ("replace", 3, 3, F.replace), ("lpad", 2, 3, lambda s, n, pad=" ": F.lpad(s, n, pad)), ("rpad", 2, 3, lambda s, n, pad=" ": F.rpad(s, n, pad)),
    ("reverse", 1, 1, F.reverse), ("left", 2, 2, F.left), ("right", 2, 2, F.right), ("position", 2, 2, F.position),
    ("split_part", 3, 3, F.split_part), ("starts_with", 2, 2, F.startswith), ("ends_with", 2, 2, F.endswith), ("contains", 2, 2, F.contains),
    ("initcap", 1, 1, F.initcap), ("repeat", 2, 2, F.repeat), ("translate", 3, 3, lambda s, a, b: F.translate(s, str(literal(a)), str(literal(b)))), ("md5", 1, 1, F.md5),
    ("abs", 1, 1, F.abs), ("round", 1, 2, lambda x, n=0: F.round(x, n if isinstance(n, int) else literal(n))), ("ceil", 1, 1, F.ceil), ("floor", 1, 1, F.floor),
    ("sqrt", 1, 1, F.sqrt), ("power", 2, 2, F.power), ("exp", 1, 1, F.exp), ("ln", 1, 1, F.ln), ("log", 2, 2, lambda b, x: F.ln(x) / F.ln(b)), ("log10", 1, 1, F.log10),
    ("sign", 1, 1, lambda x: F.signum(x).cast("int")), ("mod", 2, 2, F.try_mod), ("trunc", 1, 1, lambda x: F.signum(x) * F.floor(F.abs(x))),
    ("date_part", 2, 2, _part), ("extract", 2, 2, _part),
    ("date_add", 2, 3, _shift(1)), ("date_sub", 2, 3, _shift(-1)), ("date_diff", 2, 3, _diff),
    ("to_date", 1, 1, F.to_date), ("to_timestamp", 1, 1, F.to_timestamp_ntz), ("current_date", 0, 0, F.current_date), ("current_timestamp", 0, 0, F.current_timestamp),
    ("regexp_match", 2, 3, _regexp_match), ("regexp_extract", 2, 3, lambda s, p, g=0: F.regexp_extract(s, str(literal(p)), int(literal(g)))),
    ("regexp_replace", 3, 3, lambda s, p, r: F.regexp_replace(s, p, r)),
    ("greatest", 2, None, F.greatest), ("least", 2, None, F.least),
    ("coalesce", 1, None, F.coalesce), ("nullif", 2, 2, F.nullif), ("safe_divide", 2, 2, F.try_divide),
)
for _p in ("year", "quarter", "month", "day", "hour", "minute", "second", "week"):
    register(_p, 1, 1, lambda x, p=_p: _part(p, x))


#: Aggregates by name: x (a Column), then literal arguments. States say how partial results merge. No first and last: an
#: aggregate sees no order of rows; semi-additive measures and accessors do.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "count_distinct": F.count_distinct,
    "median": F.median, "stddev": F.stddev, "stddev_pop": F.stddev_pop, "variance": F.variance, "var_pop": F.var_pop,
    "percentile_cont": lambda x, p=0.5: F.percentile(x, F.lit(float(p))), "string_agg": lambda x, sep=",": F.array_join(F.sort_array(F.collect_list(x)), sep),
    "approx_count_distinct": F.approx_count_distinct,
}
SPELLINGS = {"std_dev": "stddev", "stddev_samp": "stddev", "var_samp": "variance", "average": "avg", "mean": "avg", "countdistinct": "count_distinct", "substr": "substring", "ceiling": "ceil", "pow": "power", "to_timestamp_ntz": "to_timestamp", "datediff": "date_diff", "dateadd": "date_add", "startswith": "starts_with", "endswith": "ends_with", "char_length": "length", "listagg": "string_agg"}


def aggregate_name(name: str) -> str | None:
    name = SPELLINGS.get(name.lower(), name.lower())
    return name if name in AGGREGATES else None
