"""Semantic models: what an author declares in YAML (or a dict), parsed, resolved and checked."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

from .errors import ModelError
from .expr import Node, fields, parse, walk
from .functions import aggregate_name
from .types import GRAINS, is_temporal, parse_type, rank

#: How deep metrics may refer to metrics.
METRIC_DEPTH = 3
#: How deep kinds may hold kinds.
KIND_DEPTH = 2
STRATEGIES = {"latest", "earliest", "average", "first", "last"}
CARDINALITIES = {"one_to_one", "one_to_many", "many_to_one", "many_to_many"}
#: Aggregates that a dimension which isn't a number may be measured by.
OVER_DIMENSIONS = {"min", "max", "count", "count_distinct", "approx_count_distinct", "string_agg"}
FORMATS = {"parquet", "csv", "json", "orc", "avro", "iceberg"}


@dataclass(frozen=True)
class Constraints:
    one_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    prohibited: tuple[str, ...] = ()


@dataclass(frozen=True)
class Bucket:
    name: str
    lower: Any = None
    upper: Any = None


@dataclass(frozen=True)
class Dimension:
    name: str
    data_type: T.DataType | None = None
    kind: str = "categorical"
    grains: tuple[str, ...] = ()
    buckets: tuple[Bucket, ...] = ()
    bucket_of: str | None = None
    expr: Node | None = None
    metadata: tuple[str, int] | None = None


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str = "sum"
    data_type: T.DataType | None = None
    expr: Node | None = None
    args: tuple[Any, ...] = ()
    filters: tuple[Node, ...] = ()
    axes: tuple[str, ...] = ()
    strategy: str | None = None
    additivity: str | None = None
    constraints: Constraints = Constraints()


@dataclass(frozen=True)
class Metric:
    name: str
    expr: Node | None = None
    data_type: T.DataType | None = None
    filters: tuple[Node, ...] = ()
    constraints: Constraints = Constraints()


@dataclass(frozen=True)
class Relationship:
    name: str
    source: str
    target: str
    keys: tuple[tuple[Node, Node], ...]
    cardinality: str = "many_to_one"
    how: str = "inner"
    filter: Node | None = None
    cross_filter: str | None = None
    as_of: bool = False


@dataclass(frozen=True)
class Storage:
    format: str | None = None
    paths: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    options: tuple[tuple[str, Any], ...] = ()
    catalog: str | None = None
    partition_def: dict | None = None


@dataclass(frozen=True)
class Temporal:
    """shape: timeseries, events, snapshot or scd. Versions of today: those whose flag is set, else those whose end is open_ended
    (null, or a value that stands for it); "none" says that neither can be told, so each key's last version counts."""

    shape: str
    axis: str
    until: str | None = None
    scd_type: str = "type2"
    grain: str | None = None
    current: str | None = None
    open_ended: Any = None


@dataclass(frozen=True)
class Kind:
    """A dataset, grainset, unionset or joinset."""

    kind: str
    name: str
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)
    filters: dict[str, Node] = field(default_factory=dict)
    primary: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[dict, ...] = ()
    storage: Storage | None = None
    mapping: dict[str, Any] | None = None
    temporal: Temporal | None = None
    children: tuple[Kind, ...] = ()
    relationships: tuple[Relationship, ...] = ()
    mode: str = "all"
    pre_aggregated: bool = False

    def fields(self) -> set[str]:
        return {*self.dimensions, *self.measures, *self.metrics}

    def has_places(self) -> bool:
        """Whether fields come from where the data lies."""
        return any(d.metadata for d in self.dimensions.values()) or any(isinstance(v, dict) and "metadata" in v for v in (self.mapping or {}).values())

    def leaves(self) -> list[Kind]:
        return [self] if self.kind == "dataset" else [x for c in self.children for x in c.leaves()]


@dataclass(frozen=True)
class Model:
    name: str
    kinds: dict[str, Kind]
    relationships: tuple[Relationship, ...] = ()
    warnings: tuple[str, ...] = ()


def load(source: str | Path | dict) -> Model:
    """A model from a dict, YAML text, a file, or a directory of files that are merged."""
    import yaml

    if isinstance(source, dict):
        raw = source
    else:
        path = Path(source) if "\n" not in str(source) else None
        if path is not None and path.is_dir():
            raw = {}
            for p in sorted([*path.glob("*.yaml"), *path.glob("*.yml")]):
                part = yaml.safe_load(p.read_text())
                for k, v in part.get("semantic_model", part).items():
                    raw[k] = raw[k] + v if isinstance(v, list) and k in raw else v
        else:
            raw = yaml.safe_load(path.read_text() if path is not None else str(source))
    raw = raw.get("semantic_model", raw)
    return _Loader(raw).model()


def _tuple(x: Any) -> tuple:
    return () if x is None else tuple(x) if isinstance(x, (list, tuple)) else (x,)


def _unique(items: list, what: str) -> dict:
    out: dict = {}
    for x in items:
        if x.name in out:
            raise ModelError("MODEL_E_DUPLICATE", f"{what} {x.name} is declared twice")
        out[x.name] = x
    return out


def _type(raw: dict) -> T.DataType | None:
    return parse_type(str(raw["data_type"])) if raw.get("data_type") else None


def _constraints(raw: dict | None) -> Constraints:
    raw = raw or {}
    d, a = raw.get("dimensions") or {}, raw.get("aggregations") or {}
    return Constraints(_tuple(d.get("one_of")), _tuple(d.get("none_of")), _tuple(d.get("all")), _tuple(a.get("allowed")), _tuple(a.get("prohibited")))


def _plain(v: Any) -> Any:
    return next(iter(v.values())) if isinstance(v, dict) else v


def _dimension(raw: dict) -> Dimension:
    if "filter" in raw or "filters" in raw:
        raise ModelError("MODEL_E_FILTER", f"{raw['name']}: a dimension takes no filter; use the kind's filters")
    kind = raw.get("type") or "categorical"
    body: Any = {}
    if isinstance(kind, dict):
        (kind, body), = kind.items()
        body = body or {}
    if kind not in ("temporal", "categorical", "binary", "geo", "bucketed", "metadata"):
        raise ModelError("MODEL_E_DIMENSION", f"{raw['name']}: unknown type {kind}")
    t = _type(raw)
    grains = tuple(body.get("grains") or ()) if isinstance(body, dict) else ()
    for g in grains:
        rank(g)
    buckets = tuple(Bucket(b["name"], _plain(b.get("lower", b.get("start"))), _plain(b.get("upper", b.get("end")))) for b in (body.get("buckets") or ())) if isinstance(body, dict) else ()
    if kind == "bucketed" and not buckets:
        raise ModelError("MODEL_E_BUCKETS", f"{raw['name']} has no buckets")
    meta = None
    if kind == "metadata" or "metadata" in raw:
        m = raw.get("metadata") or body
        (how, n), = {k: v for k, v in m.items() if k in ("path_token", "partition_level", "path", "partition")}.items()
        meta = ("path" if how.startswith("path") else "partition", int(n["index"] if isinstance(n, dict) else n))
    return Dimension(raw["name"], t, "temporal" if kind == "categorical" and is_temporal(t) else kind, grains, buckets, body.get("column") if isinstance(body, dict) else None, _expr(raw, "dimension"), meta)


def _expr(raw: dict, what: str) -> Node | None:
    if raw.get("expr") is None:
        return None
    n = parse(raw["expr"])
    if what != "metric" and any(x.op == "agg" for x in walk(n)):
        raise ModelError("EXPR_E_AGGREGATE", f"{what} {raw.get('name', raw.get('ref'))}: no aggregate inside")
    return n


def _filters(raw: dict) -> tuple[Node, ...]:
    return tuple(parse(f["expr"] if isinstance(f, dict) and "expr" in f else f) for f in raw.get("filters") or ())


def _measure(raw: dict) -> Measure:
    agg, args = raw.get("agg", "sum"), ()
    if isinstance(agg, dict):
        (agg, body), = agg.items()
        args = tuple(body.values()) if isinstance(body, dict) else _tuple(body)
    name = aggregate_name(str(agg))
    if name is None:
        raise ModelError("MODEL_E_AGG", f"{raw['name']}: unknown aggregation {agg}")
    add, axes, strategy = raw.get("additivity"), (), None
    if isinstance(add, dict):
        (add, body), = add.items()
        body = body or {}
        axes = _tuple(body.get("axes", body.get("non_additive_dimensions")))
        strategy = body.get("strategy", body.get("resolution_strategy", "latest"))
        if strategy not in STRATEGIES:
            raise ModelError("MODEL_E_ADDITIVITY", f"{raw['name']}: unknown strategy {strategy}")
    return Measure(raw["name"], name, _type(raw), _expr(raw, "measure"), args, _filters(raw), axes, strategy, add, _constraints(raw.get("constraints")))


def _metric(raw: dict) -> Metric:
    return Metric(raw["name"], _expr(raw, "metric"), _type(raw), _filters(raw), _constraints(raw.get("constraints")))


def _storage(raw: dict | None, name: str) -> Storage | None:
    if not raw:
        return None
    paths, tables = _tuple(raw.get("paths")), _tuple(raw.get("tables"))
    if bool(paths) == bool(tables):
        raise ModelError("MODEL_E_STORAGE", f"{name}: storage takes either paths or tables")
    fmt = raw.get("format")
    if fmt and fmt not in FORMATS:
        raise ModelError("MODEL_E_STORAGE", f"{name}: unknown format {fmt}")
    known = {"format", "paths", "tables", "partition_def", "catalog"}
    return Storage(fmt, paths, tables, tuple((k, v) for k, v in {**(raw.get("options") or {}), **{k: v for k, v in raw.items() if k not in known | {"options"}}}.items()), raw.get("catalog"), _partitions(raw.get("partition_def"), name))


def _partitions(raw: dict | None, name: str) -> dict | None:
    """How the author says that files are partitioned: by ranges or listed values of a column, which must be among those read."""
    if raw is None:
        return None
    if raw.get("type") not in ("range", "list") or not raw.get("column"):
        raise ModelError("MODEL_E_STORAGE", f"{name}: partitions are a range or a list of a column")
    if extra := set(raw) - {"type", "column"} - ({"values"} if raw["type"] == "list" else set()):
        raise ModelError("MODEL_E_STORAGE", f"{name}: partitions have no {sorted(extra)}")
    return dict(raw)


def _temporal(raw: dict | None, name: str) -> Temporal | None:
    if not raw:
        return None
    body = raw.get("type", raw)
    grain = raw.get("grain") or (body.get("grain") if isinstance(body, dict) else None)
    shapes = {k: v for k, v in body.items() if k in ("timeseries", "events", "snapshot", "scd")}
    if not shapes:
        return Temporal("timeseries", "", grain=grain) if grain else None
    (shape, x), = shapes.items()
    x = x or {}
    axis = x.get("occurred_at") or x.get("event_time") or x.get("snapshotted_at") or x.get("valid_from") or x.get("effective_from")
    if not axis:
        raise ModelError("MODEL_E_TEMPORAL", f"{name}: {shape} needs its time field")
    if grain:
        rank(grain)
    until = x.get("valid_to") or x.get("effective_to")
    scd = str(x.get("scd_type", "type2"))
    if shape == "scd" and scd == "type2" and not until:
        raise ModelError("MODEL_E_TEMPORAL", f"{name}: type 2 needs valid_to")
    return Temporal(shape, axis, until, scd, grain, x.get("current_flag"), x.get("open_ended"))


_HOW = {"none": "inner", "left": "left", "right": "right", "both": "full", "inner": "inner", "full": "full"}


def _cross(raw: dict, name: str) -> str | None:
    """Which side receives the other's filters: none, left, right or both. Not said: both, as a join has it."""
    x = raw.get("cross_filter")
    if x is not None and x not in ("none", "left", "right", "both"):
        raise ModelError("MODEL_E_RELATIONSHIP", f"{name}: unknown cross filter {x}")
    return x


def relationship(raw: dict) -> Relationship:
    name = raw.get("name", f"{raw.get('from')}_{raw.get('to')}")
    keys = tuple((parse(k["from"]), parse(k["to"])) for k in raw.get("keys") or raw.get("columns") or ())
    if not keys:
        raise ModelError("MODEL_E_RELATIONSHIP", f"{name} has no keys")
    card = raw.get("cardinality", "many_to_one")
    if card not in CARDINALITIES:
        raise ModelError("MODEL_E_RELATIONSHIP", f"{name}: unknown cardinality {card}")
    how = raw.get("type", raw.get("optional"))
    if how is None:
        trusted = raw.get("integrity", "assumed" if card == "many_to_one" else None)
        if card in ("one_to_one", "many_to_many"):
            raise ModelError("MODEL_E_RELATIONSHIP", f"{name}: {card} must say which side is optional")
        how = "none" if trusted == "enforced" or (trusted == "assumed" and card == "many_to_one") else "left"
    if how not in _HOW:
        raise ModelError("MODEL_E_RELATIONSHIP", f"{name}: unknown join {how}")
    return Relationship(name, raw["from"], raw["to"], keys, card, _HOW[how], parse(raw["filter"]) if raw.get("filter") else None, _cross(raw, name), bool(raw.get("as_of")))


class _Loader:
    def __init__(self, raw: dict):
        self.raw = raw
        self.pools = {k: {x["name"]: x for x in raw.get(k) or ()} for k in ("dimensions", "measures", "metrics")}
        self.named = {x["name"]: (k[:-1], x) for k in ("datasets", "grainsets", "unionsets", "joinsets") for x in raw.get(k) or ()}
        self.warnings: list[str] = []

    def model(self) -> Model:
        names = [x["name"] for k in ("datasets", "grainsets", "unionsets", "joinsets") for x in self.raw.get(k) or ()]
        if dup := {n for n in names if names.count(n) > 1}:
            raise ModelError("MODEL_E_DUPLICATE", f"kinds {sorted(dup)} are declared twice")
        kinds = {n: self.kind(k, x, None, 0) for n, (k, x) in self.named.items()}
        rels = tuple(relationship(r) for r in self.raw.get("relationships") or ())
        for r in rels:
            for end in (r.source, r.target):
                if end not in kinds:
                    raise ModelError("MODEL_E_RELATIONSHIP", f"{r.name}: {end} doesn't exist")
        for k in kinds.values():
            _check_metrics(k)
        return Model(self.raw.get("name", "model"), kinds, rels, tuple(self.warnings))

    def entries(self, raw: dict, pool: str, make) -> dict:
        out = []
        for x in raw.get(pool) or ():
            if isinstance(x, str):
                x = {"ref": x}
            if "ref" in x:
                base = self.pools[pool].get(x["ref"])
                if base is None:
                    raise ModelError("MODEL_E_REF", f"{raw['name']}: no {pool[:-1]} {x['ref']} to refer to")
                x = {**base, **{k: v for k, v in x.items() if k != "ref"}}
            out.append(make(x))
        return _unique(out, pool[:-1])

    def kind(self, kind: str, raw: dict, parent: Kind | None, depth: int) -> Kind:
        name, extras = raw["name"], raw.get("extras") or {}
        if depth > KIND_DEPTH:
            raise ModelError("MODEL_E_NESTING", f"{name} is nested too deep")
        dims, measures, metrics = (self.entries(raw, p, m) for p, m in (("dimensions", _dimension), ("measures", _measure), ("metrics", _metric)))
        for m in metrics.values():
            if m.expr is None:
                raise ModelError("MODEL_E_METRIC", f"metric {m.name} has no expression")
        if clash := sorted({*dims} & {*measures} | {*dims} & {*metrics} | {*measures} & {*metrics}):
            raise ModelError("MODEL_E_DUPLICATE", f"{name}: {clash} are declared as two things")
        own = Kind(kind, name, dims, measures, metrics)
        filters = {f.get("name", f"filter{n}") if isinstance(f, dict) else f"filter{n}": parse(f["expr"] if isinstance(f, dict) and "expr" in f else f) for n, f in enumerate(raw.get("filters") or ())}
        keys = raw.get("keys") or {}
        if any(isinstance(x, dict) and ("filter" in x or "filters" in x) for g in keys.values() for x in (g if isinstance(g, list) else [g])):
            raise ModelError("MODEL_E_FILTER", f"{name}: a key takes no filter; use the kind's filters")
        ids = lambda k: _tuple(k.get("fields") if isinstance(k, dict) else k)
        mapping = extras.get("semantic_mapping", extras.get("column_mapping", raw.get("column_mapping")))
        if mapping == "auto":
            mapping = None
        children = []
        for group in ("datasets", "grainsets", "unionsets", "joinsets"):
            for c in raw.get(group) or () if kind != "dataset" else ():
                children.append(self.child(kind, group[:-1], c, own, depth))
        if kind != "dataset" and not children:
            raise ModelError("MODEL_E_CHILDREN", f"{name} has no children")
        if kind != "dataset" and len(children) < 2:
            self.warnings.append(f"{name} has one child")
        if len({c.name for c in children}) < len(children):
            raise ModelError("MODEL_E_DUPLICATE", f"{name} has two children of one name")
        rels = tuple(relationship(r) for r in raw.get("relationships") or ())
        for r in rels:
            for end in (r.source, r.target):
                if end not in {c.name for c in children}:
                    raise ModelError("MODEL_E_RELATIONSHIP", f"{name}.{r.name}: {end} isn't a child")
        mode = raw.get("mode", "all")
        if mode not in ("all", "unique"):
            raise ModelError("MODEL_E_MODE", f"{name}: unknown mode {mode}")
        out = replace(own, filters=filters, primary=ids(keys.get("primary")), unique=tuple(ids(u) for u in keys.get("unique") or ()), foreign=tuple(keys.get("foreign") or ()), storage=_storage(extras.get("storage"), name), mapping=mapping, temporal=_temporal(extras.get("temporal"), name), children=tuple(children), relationships=rels, mode=mode, pre_aggregated=bool(extras.get("pre_aggregated", raw.get("pre_aggregated"))))
        if kind == "grainset":
            grains = [c.temporal.grain for c in out.leaves() if c.temporal and c.temporal.grain]
            finest = min(map(rank, grains), default=None)
            if finest is not None:
                out = replace(out, dimensions={n: replace(d, grains=GRAINS[finest:]) if d.kind == "temporal" and not d.grains else d for n, d in out.dimensions.items()})
        return out

    def child(self, outer: str, group: str, raw: dict, own: Kind, depth: int) -> Kind:
        if isinstance(raw, str):
            raw = {"ref": raw}
        name = raw.get("ref", raw.get("name"))
        base = self.named.get(name)
        kind = base[0] if base else group
        if kind == outer:
            raise ModelError("MODEL_E_NESTING", f"{own.name}: a {kind} can't hold a {kind}")
        if "ref" in raw and base is None:
            raise ModelError("MODEL_E_REF", f"{own.name}: no kind {name} to refer to")
        if base and base[1] is not raw:
            merged = {**base[1], **{k: v for k, v in raw.items() if k not in ("ref", "extras")}, "name": raw.get("alias", name)}
            a, b = base[1].get("extras") or {}, raw.get("extras") or {}
            merged["extras"] = {**a, **b}
            raw = merged
        out = self.kind(kind, raw, own, depth + 1)
        # a child without fields of its own has its parent's
        if kind == "dataset":
            # own fields come first, so that a child's expression isn't lost to its parent's declaration
            out = replace(out, dimensions={**own.dimensions, **out.dimensions}, measures={**own.measures, **out.measures})
        return out


def _check_metrics(k: Kind) -> None:
    def depth(name: str, path: tuple[str, ...]) -> int:
        if name in path:
            raise ModelError("MODEL_E_CYCLE", f"{k.name}: metrics {' -> '.join((*path, name))} go in a circle")
        m = k.metrics.get(name)
        if m is None:
            return 0
        return 1 + max([depth(f.split(".")[0], (*path, name)) for f in fields(m.expr)], default=0)

    for name, m in k.metrics.items():
        if depth(name, ()) > METRIC_DEPTH + 1:
            raise ModelError("MODEL_E_DEPTH", f"{k.name}.{name} is deeper than {METRIC_DEPTH}")
        for f in fields(m.expr):
            base = f.split(".")[0]
            if base not in k.fields():
                raise ModelError("MODEL_E_UNKNOWN", f"{k.name}.{name}: no field {base}")
    for m in k.measures.values():
        if m.expr is not None and (other := (fields(m.expr) & set(k.measures)) - {m.name}):
            raise ModelError("MODEL_E_MEASURE", f"{k.name}.{m.name} can't refer to measures {sorted(other)}")
        if m.expr is not None and m.expr.op == "field" and m.agg not in OVER_DIMENSIONS and (d := k.dimensions.get(m.expr.value)) is not None and isinstance(d.data_type, (T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)):
            raise ModelError("MODEL_E_AGG", f"{k.name}.{m.name}: {m.agg} over the dimension {d.name}; only {', '.join(sorted(OVER_DIMENSIONS))} are allowed")
    for c in k.children:
        _check_metrics(c)


