"""The plain relational operators of a plan, with the checks that a plan's nodes get."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import RequestError


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """Inline rows; each must fit the schema."""
    width = len(StructType.fromDDL(schema).fields)
    if any(len(r) != width for r in rows):
        raise RequestError("PLAN_E_ARITY", f"rows of {width} values are wanted")
    return spark.createDataFrame(rows, schema)


def project(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    if not columns:
        raise RequestError("PLAN_E_EMPTY", "a projection has no columns")
    return df.select(*[c.alias(n) for n, c in columns])


def aggregate(df: DataFrame, group: list[str], aggs: list[tuple[str, Column]]) -> DataFrame:
    names = [*group, *(n for n, _ in aggs)]
    if len(set(names)) < len(names) or not set(group) <= set(df.columns):
        raise RequestError("PLAN_E_NAMES", f"{names}: names must be known and differ")
    return df.groupBy(*group).agg(*[c.alias(n) for n, c in aggs])


def join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    if not keys:
        raise RequestError("PLAN_E_KEYS", "a join has no keys")
    return left.join(right, reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in keys]), how)


def union(frames: list[DataFrame], distinct: bool = False) -> DataFrame:
    """Two frames or more of equal names and types; nulls count as equal if distinct."""
    if len(frames) < 2:
        raise RequestError("PLAN_E_UNION", "a union takes two inputs or more")
    first = [(f.name, f.dataType) for f in frames[0].schema.fields]
    if any([(f.name, f.dataType) for f in df.schema.fields] != first for df in frames[1:]):
        raise RequestError("PLAN_E_UNION", "inputs of a union differ in names or types")
    out = reduce(lambda a, b: a.union(b), frames)
    return out.distinct() if distinct else out


def sort(df: DataFrame, by: list[tuple[str, bool, str | None]]) -> DataFrame:
    """by: (name, descending, first or last for nulls; None is Spark's way)."""
    if bad := [n for n, _, _ in by if n not in df.columns]:
        raise RequestError("PLAN_E_ORDER", f"can't order by {bad}")
    column = lambda n, d, x: getattr(F.col(f"`{n}`"), ("desc" if d else "asc") + (f"_nulls_{x}" if x else ""))()
    return df.orderBy(*[column(*b) for b in by])


def fetch(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
