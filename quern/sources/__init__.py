"""Where rows come from: files by format and path, tables by name and pattern, and frames handed over by name."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..errors import ModelError
from ..model import Kind, Storage

_BY_SUFFIX = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".tsv": "csv", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".orc": "orc", ".avro": "avro"}
_CSV = {"has_header": "header", "delimiter": "sep", "quote": "quote", "null_sentinel": "nullValue"}


#: Lines that a schema is inferred from where none is declared, and sources of a dataset that are read apart.
SAMPLE_ROWS, MOST_SOURCES = 100, 64


def infer_format(paths: tuple[str, ...]) -> str:
    """The one format that the paths' endings speak for."""
    found = {_BY_SUFFIX.get("." + p.rstrip("/").rsplit(".", 1)[-1].lower()) for p in paths} - {None}
    if len(found) != 1:
        raise ModelError("SRC_E_FORMAT", f"no one format for {list(paths)}: {sorted(found)}")
    return found.pop()


def read_files(spark: SparkSession, s: Storage) -> DataFrame:
    fmt = s.format or infer_format(s.paths)
    reader, options = spark.read, dict(s.options)
    if schema := options.pop("declared_schema", options.pop("schema", None)):
        reader = reader.schema(schema if isinstance(schema, str) else ", ".join(f"`{k}` {v}" for k, v in schema.items()))
    if fmt == "csv":
        options.setdefault("has_header", True)
        for k, v in _CSV.items():
            if k in options:
                reader = reader.option(v, options.pop(k))
        if not schema:
            reader = reader.option("inferSchema", options.pop("infer_schema", True))
    if fmt == "json":
        shape, sample = options.pop("shape", "ndjson"), options.pop("sample_rows", SAMPLE_ROWS)
        reader = reader.option("multiLine", shape in ("array", "json_array"))
        if not schema:
            reader = reader.schema(json_schema(spark, s.paths, shape, sample))
    for k, v in options.items():
        reader = reader.option(k, v)
    try:
        return reader.format(fmt).load(list(s.paths))
    except Exception as e:
        if fmt in ("avro", "iceberg") and "Failed to find" in str(e):
            raise ModelError("SRC_E_FORMAT", f"{fmt} needs its package on Spark's class path") from e
        raise


def json_schema(spark: SparkSession, paths: tuple[str, ...], shape: str, sample: int) -> StructType:
    """The schema of the first `sample` lines (of the whole of an array's file), objects and arrays as text. No other row is read for it."""
    if shape == "ndjson":
        lines = [r.value for r in spark.read.text(list(paths)).limit(sample).collect()]
        found = spark.read.json(spark.sparkContext.parallelize(lines, 1)).schema
    else:
        found = spark.read.option("multiLine", True).json(list(paths)).schema
    return StructType([StructField(f.name, StringType() if isinstance(f.dataType, (StructType, ArrayType)) else f.dataType) for f in found.fields])


def expanded(spark: SparkSession, paths: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(paths with their patterns replaced by what matches, patterns that match nothing)."""
    out, none = [], []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if not any(c in p for c in "*?[{"):
            out.append(p)
            continue
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = [x.getPath().toString() for x in path.getFileSystem(conf).globStatus(path) or ()]
        out += found
        none += [] if found else [p]
    return out, none


def tables(spark: SparkSession, names: tuple[str, ...], catalog: str | None = None) -> list[str]:
    """Table names, with patterns such as `sales.*` looked up in the catalog."""
    out = []
    for n in names:
        n = f"{catalog}.{n}" if catalog else n
        if not any(c in n for c in "*?["):
            out.append(n)
            continue
        space, _, pattern = n.rpartition(".")
        out += [f"{space}.{t.name}" if space else t.name for t in spark.catalog.listTables(space or None, pattern)]
    return out


class Sources:
    """Rows of datasets. `frames` replaces storage by name, for tests and for data that is already a DataFrame."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame] | None = None, catalogs: dict[str, str] | None = None):
        self.spark, self.frames, self.catalogs = spark, dict(frames or {}), dict(catalogs or {})
        self.warnings: list[str] = []
        self._read: dict[tuple, DataFrame] = {}

    def parts(self, k: Kind) -> list[tuple[DataFrame, str | None]]:
        """Each source of a dataset with its location, if one is known before reading."""
        if k.name in self.frames:
            return [(self.frames[k.name], None)]
        s = k.storage
        if s is None:
            raise ModelError("SRC_E_STORAGE", f"{k.name} has no storage")
        if s.paths:
            paths, none = expanded(self.spark, s.paths)
            for p in none:
                self.warn(f"SRC_W001: {k.name}: {p} matches no files")
            if not paths:
                raise ModelError("SRC_E_EMPTY", f"{k.name}: no file matches {list(s.paths)}")
            if s.partition_def and s.partition_def["column"] not in (columns := self.read(s).columns):
                raise ModelError("SRC_E_PARTITION", f"{k.name}: no column {s.partition_def['column']} among {columns}")
            if k.has_places() and len(paths) <= MOST_SOURCES:  # a source each, whose location is known before reading
                return [(self.read(replace(s, paths=(p,))), p) for p in paths]
            return [(self.read(replace(s, paths=tuple(paths)) if none else s), paths[0] if len(paths) == 1 else None)]
        found = [(n, self.frames[n]) if n in self.frames else (n, self.spark.table(n)) for n in (s.tables if all(t in self.frames for t in s.tables) else tables(self.spark, s.tables, self.catalogs.get(s.catalog or "", None)))]
        if not found:
            self.warn(f"SRC_W001: {k.name}: no table matches {list(s.tables)}")
            raise ModelError("SRC_E_EMPTY", f"{k.name}: no table matches {list(s.tables)}")
        return [(df, n) for n, df in found]

    def warn(self, text: str) -> None:
        if text not in self.warnings:
            self.warnings.append(text)

    def read(self, s: Storage) -> DataFrame:
        """Files, looked at once however often a plan asks for them."""
        key = (s.format, s.paths, repr(s.options))
        if key not in self._read:
            self._read[key] = read_files(self.spark, s)
        return self._read[key]

    def rows(self, k: Kind) -> DataFrame:
        """All sources of a dataset as one."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df for df, _ in self.parts(k)])


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?"


def token(at: str | None, kind: str, index: int) -> str | None:
    """What location() gives for all files at this path, if the path itself says so."""
    if at is None:
        return None
    parts = re.sub(_SCHEME, "", at).rstrip("/").split("/")
    if kind == "path":
        return parts[index] if 0 <= index < len(parts) and not any(c in "/".join(parts[: index + 1]) for c in "*?[{") else None
    found = [x for x in parts if "=" in x]
    return found[index - 1].split("=", 1)[1] if 0 < index <= len(found) and not any(c in at for c in "*?[{") else None


def location(kind: str, index: int):
    """The index-th part (from 0) of each file's path without its scheme, or the value of its index-th (from 1) partition folder."""
    parts = F.split(F.regexp_replace(F.input_file_name(), _SCHEME, ""), "/")
    if kind == "path":
        return F.get(parts, F.lit(index))
    return F.regexp_extract(F.get(F.filter(parts, lambda x: x.contains("=")), F.lit(index - 1)), "=(.*)$", 1)
