"""From what a model's author writes to a tree: blocks ({upper: name}) or text ("revenue / order_count")."""

from __future__ import annotations

import re
from typing import Any

from ..errors import ModelError
from ..functions import SPELLINGS, aggregate_name, known
from .tree import Node, call, lit

_BINARY = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "mod": "%", "eq": "=", "ne": "<>", "not_eq": "<>", "neq": "<>", "lt": "<", "lte": "<=", "lt_eq": "<=", "le": "<=", "gt": ">", "gte": ">=", "gt_eq": ">=", "ge": ">=", "eq_null_safe": "<=>", "is_distinct_from": "is_distinct", "safe_divide": "safe_divide"}
#: Named arguments of block functions, in the order of the function's arguments.
_NAMED = {
    "substring": ("col", "start", "length"), "trim": ("col", "chars"), "ltrim": ("col", "chars"), "rtrim": ("col", "chars"), "replace": ("col", "old", "new"), "lpad": ("col", "length", "pad"), "rpad": ("col", "length", "pad"),
    "left": ("col", "length"), "right": ("col", "length"), "position": ("substring", "col"), "split_part": ("col", "delimiter", "index"), "starts_with": ("col", "prefix"), "ends_with": ("col", "suffix"), "contains": ("col", "substring"),
    "repeat": ("col", "count"), "concat_ws": ("separator", "args"), "round": ("col", "scale"), "power": ("base", "exponent"), "log": ("base", "col"), "date_part": ("part", "col"), "extract": ("part", "col"), "date_add": ("col", "days", "unit"), "date_sub": ("col", "days", "unit"),
    "date_diff": ("part", "start", "end"), "date_trunc": ("grain", "col"), "regexp_match": ("col", "pattern", "full_match"), "regexp_extract": ("col", "pattern", "group"), "regexp_replace": ("col", "pattern", "replacement"), "nullif": ("col", "null_expr"),
    "percentile_cont": ("col", "p"), "string_agg": ("col", "separator"), "mod": ("left", "right"),
}
_ALIASES = {"column": "col", "expr": "col", "from": "old", "to": "new", "len": "length", "delim": "delimiter", "n": "index", "times": "count", "digits": "scale", "value": "col", "interval": "days", "amount": "days", "null_value": "null_expr", "full": "full_match", "sep": "separator", "sub": "substring"}
_TYPED = {"string": "string", "int": "long", "integer": "long", "long": "long", "float": "double", "double": "double", "number": "double", "bool": "boolean", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "decimal": "decimal(38,18)"}


def parse(source: Any) -> Node:
    """A tree of a block, a text, a number or an already parsed tree."""
    if isinstance(source, Node):
        return source
    if isinstance(source, str):
        return _Text(source).whole()
    return _block(source)


def _literal(x: Any) -> Node:
    if isinstance(x, dict):
        (kind, value), = x.items()
        if kind == "null":
            return lit(None, _TYPED.get(str(value), str(value) if value else None))
        if kind.startswith("decimal"):
            return lit(str(value["value"] if isinstance(value, dict) else value), kind if "(" in kind else "decimal(38,18)")
        if kind not in _TYPED:
            raise ModelError("EXPR_E_LITERAL", f"unknown literal type {kind}")
        return lit(value, _TYPED[kind])
    return lit(x)


def _many(x: Any) -> list[Node]:
    return [_block(y) for y in (x if isinstance(x, list) else [x])]


def _block(b: Any) -> Node:
    if b is None or isinstance(b, (bool, int, float)):
        return lit(b)
    if isinstance(b, str):
        return _Text(b).whole() if re.search(r"[^\w.\"-]", b) or "{{" in b else Node("field", b)
    if isinstance(b, Node):
        return b
    if not isinstance(b, dict) or not b:
        raise ModelError("EXPR_E_BLOCK", f"not an expression: {b!r}")
    if len(b) > 1 and not (len(b) == 2 and "filter" in b):
        raise ModelError("EXPR_E_BLOCK", f"one tag is wanted, not {sorted(b)}")
    tag = next(k for k in b if k != "filter")
    v, name = b[tag], SPELLINGS.get(tag.lower(), tag.lower())
    if name == "lit":
        return _literal(v)
    if name in ("col", "column", "field", "dim", "dimension", "measure", "metric", "key"):
        if isinstance(v, dict):
            a = v.get("accessor")
            if isinstance(a, dict):
                (kind, n), = a.items()
                a = f"{kind}({n})"
            return Node("field", f"{v['name']}.{a}" if a else v["name"])
        return Node("field", v)
    if name == "window":
        raise ModelError("EXPR_E_WINDOW", "window expressions can't be authored; use an accessor")
    if name in _BINARY and not (name == "mod" and isinstance(v, dict)):
        x = _many([v["left"], v["right"]] if isinstance(v, dict) else v)
        if len(x) != 2:
            raise ModelError("EXPR_E_ARITY", f"{tag} takes two operands")
        return call(_BINARY[name], *x)
    if name in ("and", "or"):
        return call(name, *_many(v))
    if name == "negate":
        return call("negate", _block(v))
    if name == "not":
        x = _block(v)
        if x.op == "in":
            return Node("in", None, x.args, (("negated", not x.option("negated")),))
        return call("not", x)
    if name == "case":
        whens = v.get("when") or []
        if not whens:
            raise ModelError("EXPR_E_EMPTY", "case needs a when")
        args = [y for w in whens for y in (_block(w.get("condition", w.get("when"))), _block(w["then"]))]
        return Node("case", None, (*args, _block(v.get("else"))))
    if name == "if":
        c, x, y = v if isinstance(v, list) else (v["condition"], v["then"], v.get("else"))
        return Node("case", None, (_block(c), _block(x), _block(y)))
    if name == "guard":
        return Node("case", None, (_block(v["condition"]), _block(v.get("col", v.get("expr"))), lit(None)))
    if name in ("in", "not_in"):
        items = _many(v["list"] if "list" in v else v["values"])
        return _in(_block(v.get("col", v.get("expr"))), items, name == "not_in")
    if name in ("between", "not_between"):
        x = call("between", _block(v.get("col", v.get("expr"))), _block(v["low"]), _block(v["high"]))
        return call("not", x) if name == "not_between" else x
    if name in ("like", "ilike", "not_like", "not_ilike"):
        x = call(name.removeprefix("not_"), _block(v.get("col", v.get("expr"))), _as_literal(v["pattern"]))
        return call("not", x) if name.startswith("not_") else x
    if name in ("is_null", "is_not_null"):
        return call(name, _block(v))
    if name == "null_if":
        name = "nullif"
    if name == "coalesce" and not v:
        raise ModelError("EXPR_E_EMPTY", "coalesce needs an argument")
    if name in ("cast", "try_cast"):
        safe = name == "try_cast" or str(v.get("on_failure", "error")).lower() == "null"
        return Node("cast", v.get("to", v.get("type")), (_block(v.get("col", v.get("expr"))),), (("safe", safe),))
    if name == "concat_ws" and isinstance(v, dict):
        return call("concat_ws", _as_literal(v["separator"]), *_many(v.get("args", v.get("cols"))))
    agg = aggregate_name(name)
    if isinstance(v, dict) and name in _NAMED and any(_ALIASES.get(k, k) in _NAMED[name] or k in _NAMED[name] for k in v) and not (len(v) == 1 and next(iter(v)) in ("col", "column")):
        v = {_ALIASES.get(k, k) if k not in _NAMED[name] else k: x for k, x in v.items()}
        if bad := set(v) - set(_NAMED[name]):
            raise ModelError("EXPR_E_BLOCK", f"{tag} has no {sorted(bad)}")
        args = [_as_literal(v[k]) if k not in ("col", "start", "end", "base", "args") or not isinstance(v[k], (str, dict, list)) else _block(v[k]) for k in _NAMED[name] if k in v]
    else:
        args = _many(v) if v is not None else []
    if agg and not (known(name) and agg not in ("sum",)):
        flt = (("filter", _block(b["filter"])),) if "filter" in b else ()
        return Node("agg", agg, tuple(args), flt)
    if known(name) or name == "date_trunc":
        return call(name, *args)
    raise ModelError("EXPR_E_TAG", f"unknown tag {tag}")


def _as_literal(x: Any) -> Node:
    """Arguments that are values unless they are blocks."""
    return _block(x) if isinstance(x, dict) else lit(x)


def _in(x: Node, items: list[Node], negated: bool) -> Node:
    if not items:
        raise ModelError("EXPR_E_EMPTY", "in needs values")
    return Node("in", None, (x, *items), (("negated", negated),))


_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|'(?P<str>(?:[^']|'')*)'|\{\{\s*(?P<ref>[^{}]+?)\s*\}\}|"(?P<quoted>[^"]+)"|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<op><>|!=|<=|>=|\|\||[-+*/%=<>(),]))""")
_SQL = {"select", "from", "where", "join", "group", "order", "having", "union", "insert", "update", "delete", "drop", "create", "alter", "over", "limit", "with"}
_SOFT = {"date", "timestamp"}


class _Text:
    """A recursive descent over the tokens of an inline expression."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ModelError("EXPR_E_SYNTAX", f"can't read {text[at:]!r} in {text!r}")
            kind = m.lastgroup
            value = m[kind]
            if kind == "name" and value.lower() in _SQL:
                raise ModelError("EXPR_E_RAW_SQL", f"{value} isn't allowed in an expression: {text!r}")
            self.tokens.append((kind, value))
            at = m.end()
        self.at = 0

    def whole(self) -> Node:
        if not self.tokens:
            raise ModelError("EXPR_E_SYNTAX", "an expression is empty")
        out = self.either()
        if self.at < len(self.tokens):
            raise ModelError("EXPR_E_SYNTAX", f"{self.tokens[self.at][1]!r} isn't expected in {self.text!r}")
        return out

    def peek(self, *words: str) -> bool:
        if self.at >= len(self.tokens):
            return False
        kind, value = self.tokens[self.at]
        return kind in ("name", "op") and value.lower() in words

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.tokens[self.at - 1][1].lower()
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ModelError("EXPR_E_SYNTAX", f"{word} is missing in {self.text!r}")

    def chain(self, word: str, below) -> Node:
        parts = [below()]
        while self.take(word):
            parts.append(below())
        return parts[0] if len(parts) == 1 else call(word, *parts)

    def either(self) -> Node:
        return self.chain("or", lambda: self.chain("and", self.negation))

    def negation(self) -> Node:
        return call("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        x = self.sum()
        if op := self.take("=", "!=", "<>", "<", "<=", ">", ">="):
            return call("<>" if op == "!=" else op, x, self.sum())
        if self.take("is"):
            negated = self.take("not")
            self.need("null")
            return call("is_not_null" if negated else "is_null", x)
        negated = bool(self.take("not"))
        if self.take("in"):
            self.need("(")
            return _in(x, self.arguments(), negated)
        if self.take("between"):
            low = self.sum()
            self.need("and")
            y = call("between", x, low, self.sum())
            return call("not", y) if negated else y
        if op := self.take("like", "ilike"):
            y = call(op, x, self.sum())
            return call("not", y) if negated else y
        if negated:
            raise ModelError("EXPR_E_SYNTAX", f"not isn't expected in {self.text!r}")
        return x

    def binary(self, ops: tuple[str, ...], below) -> Node:
        x = below()
        while op := self.take(*ops):
            x = call("concat" if op == "||" else op, x, below())
        return x

    def sum(self) -> Node:
        return self.binary(("+", "-", "||"), lambda: self.binary(("*", "/", "%"), self.unary))

    def unary(self) -> Node:
        if self.take("-"):
            x = self.unary()
            return lit(-x.value) if x.op == "lit" and isinstance(x.value, (int, float)) else call("negate", x)
        return self.primary()

    def arguments(self) -> list[Node]:
        out = []
        if self.take(")"):
            return out
        while True:
            out.append(self.either())
            if self.take(")"):
                return out
            self.need(",")

    def primary(self) -> Node:
        if self.at >= len(self.tokens):
            raise ModelError("EXPR_E_SYNTAX", f"{self.text!r} ends too soon")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return lit(float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            return lit(value.replace("''", "'"))
        if kind in ("ref", "quoted"):
            return Node("field", value)
        if value == "(":
            x = self.either()
            self.need(")")
            return x
        if kind == "op":
            raise ModelError("EXPR_E_SYNTAX", f"{value!r} isn't expected in {self.text!r}")
        word = value.lower()
        if word in ("true", "false"):
            return lit(word == "true")
        if word == "null":
            return lit(None)
        if word in _SOFT and self.at < len(self.tokens) and self.tokens[self.at][0] == "str":
            self.at += 1
            return lit(self.tokens[self.at - 1][1], word)
        if word == "case":
            return self.case()
        if self.take("("):
            return self.function(word, value)
        return Node("field", value)

    def case(self) -> Node:
        args = []
        while self.take("when"):
            args.append(self.either())
            self.need("then")
            args.append(self.either())
        if not args:
            raise ModelError("EXPR_E_EMPTY", "case needs a when")
        args.append(self.either() if self.take("else") else lit(None))
        self.need("end")
        return Node("case", None, tuple(args))

    def function(self, word: str, value: str) -> Node:
        name = SPELLINGS.get(word, word)
        if name in ("cast", "try_cast"):
            x = self.either()
            self.need("as")
            kind = self.tokens[self.at][1]
            self.at += 1
            if self.take("("):
                kind += f"({','.join(str(a.value) for a in self.arguments())})"
            self.need(")")
            return Node("cast", kind, (x,), (("safe", name == "try_cast"),))
        if "." in word and (base := word.rpartition("."))[2] in ("lag", "lead"):
            args = self.arguments()
            return Node("field", f"{value.rpartition('.')[0]}.{base[2]}({args[0].value})")
        distinct = self.take("distinct")
        if self.take("*"):
            self.need(")")
            args = []
        else:
            args = self.arguments()
        if (agg := aggregate_name(name)) and not known(name):
            return Node("agg", "count_distinct" if distinct and agg == "count" else agg, tuple(args))
        if known(name) or name == "date_trunc":
            return call(name, *args)
        raise ModelError("EXPR_E_FUNCTION", f"unknown function {value} in {self.text!r}")
