"""Compiled models: a model with what planning looks up, as JSON that can be stored and read again."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import ModelError
from .expr import fields
from .model import Kind, Model, load

#: Partition transforms and the grain that each speaks for.
_TRANSFORMS = {"year": "year", "month": "month", "day": "day", "hour": "hour"}


@dataclass(frozen=True)
class Manifest:
    """raw: the model as declared. coverage: kind to fields; grains: leaf to grain; adjacency: kind to those it is related to; metric_order: kind to metrics, constituents first."""

    raw: dict
    digest: str
    coverage: dict[str, list[str]]
    grains: dict[str, str]
    adjacency: dict[str, list[str]]
    metric_order: dict[str, list[str]]
    warnings: list[str]
    columns: dict[str, dict[str, str]] = field(default_factory=dict)

    @property
    def model(self) -> Model:
        return load(self.raw)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=1, sort_keys=True, default=str)

    @staticmethod
    def from_json(text: str) -> Manifest:
        out = Manifest(**json.loads(text))
        if out.digest != digest(out.raw):
            raise ModelError("MANIFEST_E_DIGEST", "the manifest doesn't match its model")
        return out


def digest(raw: dict) -> str:
    return hashlib.sha256(json.dumps(raw, sort_keys=True, default=str).encode()).hexdigest()


def metric_order(k: Kind) -> list[str]:
    """A kind's metrics, each after those that it refers to."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in k.metrics and n not in out:
            for f in sorted(fields(k.metrics[n].expr)):
                visit(f.split(".")[0])
            out.append(n)

    for n in k.metrics:
        visit(n)
    return out


def compile_model(source: str | Path | dict, columns: dict[str, dict[str, str]] | None = None) -> Manifest:
    """Check a model and work out its indexes. columns: what datasets' sources have now, for drift checks later."""
    import yaml

    if isinstance(source, dict):
        raw = source
    else:
        raw = yaml.safe_load(Path(source).read_text() if "\n" not in str(source) else str(source))
    raw = json.loads(json.dumps(raw, default=str))
    model = load(raw)
    near: dict[str, list[str]] = {n: [] for n in model.kinds}
    for r in model.relationships:
        near[r.source].append(r.target)
        near[r.target].append(r.source)
    leaves = {x.name: x for k in model.kinds.values() for x in k.leaves()}
    return Manifest(raw, digest(raw), {n: sorted(k.fields()) for n, k in model.kinds.items()}, {n: x.temporal.grain for n, x in leaves.items() if x.temporal and x.temporal.grain}, near, {n: metric_order(k) for n, k in model.kinds.items() if k.metrics}, list(model.warnings), columns or {})


def inferred_grain(transforms: list[str]) -> str | None:
    """The grain of a table by its partition transforms (identity, bucket and truncate speak for none): the finest named."""
    found = [g for g in ("hour", "day", "month", "year") if any(_TRANSFORMS.get(t.split("(")[0].rstrip("s")) == g for t in transforms)]
    return found[0] if found else None


class Memory:
    """Manifests by name, in memory."""

    def __init__(self):
        self._all: dict[str, str] = {}

    def put(self, name: str, m: Manifest) -> None:
        self._all[name] = m.to_json()

    def get(self, name: str) -> Manifest:
        if name not in self._all:
            raise ModelError("MANIFEST_E_MISSING", f"no manifest {name}")
        return Manifest.from_json(self._all[name])

    def names(self) -> list[str]:
        return sorted(self._all)


class Folder(Memory):
    """Manifests by name, as files of a folder."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.path.mkdir(parents=True, exist_ok=True)

    def put(self, name: str, m: Manifest) -> None:
        to = self.path / f"{name}.json"
        part = to.with_suffix(".part")
        part.write_text(m.to_json())
        os.replace(part, to)

    def get(self, name: str) -> Manifest:
        if not (p := self.path / f"{name}.json").exists():
            raise ModelError("MANIFEST_E_MISSING", f"no manifest {name}")
        return Manifest.from_json(p.read_text())

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.path.glob("*.json"))


def with_environment(x: Any, env: dict[str, str] | None = None) -> Any:
    """x with ${NAME} and ${NAME:-default} in its strings replaced; a name that isn't set is an error."""
    env = os.environ if env is None else env
    if isinstance(x, dict):
        return {k: with_environment(v, env) for k, v in x.items()}
    if isinstance(x, list):
        return [with_environment(v, env) for v in x]
    if not isinstance(x, str):
        return x

    def one(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is not None:
            return m[2]
        raise ModelError("CAT_E_ENV", f"{m[1]} isn't set")

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", one, x)


def catalogs(source: str | dict, env: dict[str, str] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """(alias to Spark catalog, Spark settings) of a catalogs file: each entry's properties become spark.sql.catalog.<name>.*"""
    import yaml

    raw = with_environment(source if isinstance(source, dict) else yaml.safe_load(source), env)
    names, conf = {}, {}
    for c in raw.get("catalogs") or ():
        alias = c["name"]
        names[alias] = c.get("spark_catalog", alias)
        for k, v in (c.get("properties") or {k: v for k, v in c.items() if k not in ("name", "spark_catalog", "description")}).items():
            conf[f"spark.sql.catalog.{names[alias]}.{k}"] = str(v)
    return names, conf
