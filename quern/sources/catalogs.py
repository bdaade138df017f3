"""Catalogs of tables: what is in them, told through Spark's own catalog interface, whatever stands behind it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..errors import ModelError
from ..manifest import catalogs, inferred_grain


@dataclass(frozen=True)
class TableMetadata:
    """partitions: the transforms that a table is partitioned by; grain: the finest time grain among them, if any."""

    name: str
    location: str | None
    provider: str | None
    partitions: tuple[str, ...]
    grain: str | None
    properties: tuple[tuple[str, str], ...] = ()


class Catalog:
    """One of Spark's catalogs, by name; tables are named namespace.table in it."""

    def __init__(self, spark: SparkSession, name: str = "spark_catalog"):
        self.spark, self.name = spark, name

    def _full(self, table: str) -> str:
        return ".".join(f"`{x}`" for x in (self.name, *table.split(".")))

    def list_tables(self, namespace: str = "default", pattern: str = "*") -> list[str]:
        """Names of a namespace's tables that match a pattern of * and ?."""
        rows = self.spark.sql(f"SHOW TABLES IN {self._full(namespace)}").filter("not isTemporary").select("tableName").collect()
        fits = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern))
        return sorted(r.tableName for r in rows if fits.fullmatch(r.tableName))

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self._full(table).replace("`", ""))

    def schema(self, table: str) -> dict[str, tuple[str, bool]]:
        """Each column's type and whether it may be null."""
        try:
            return {f.name: (f.dataType.simpleString(), f.nullable) for f in self.spark.table(self._full(table)).schema.fields}
        except AnalysisException as e:
            raise ModelError("CAT_E_TABLE", f"{self.name} has no table {table}") from e

    def metadata(self, table: str) -> TableMetadata:
        if not self.exists(table):
            raise ModelError("CAT_E_TABLE", f"{self.name} has no table {table}")
        told, part, partitions = {}, "", []
        for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self._full(table)}").collect():
            name, value = r.col_name.strip(), (r.data_type or "").strip()
            if name.startswith("#") and name != "# col_name":
                part = name
            elif name and part == "# Partition Information" and name != "# col_name":
                partitions.append(name)
            elif name and part == "# Partitioning" and name.startswith("Part "):
                partitions.append(value)
            elif name:
                told[name] = value
        types = {c: t for c, (t, _) in self.schema(table).items()}
        # a partition by a day's column speaks for days, as a transform does
        grains = [x if "(" in x else "day(x)" if types.get(x) == "date" else "identity" for x in partitions]
        return TableMetadata(table, told.get("Location"), told.get("Provider"), tuple(partitions), inferred_grain(grains), tuple(sorted((k, told[k]) for k in ("Table Properties", "Statistics", "Type") if told.get(k))))


def open_catalogs(spark: SparkSession, source: str | dict, env: dict[str, str] | None = None) -> dict[str, Catalog]:
    """The catalogs of a catalogs file by alias, with their settings applied to the session; Spark loads each when it is first used."""
    names, conf = catalogs(source, env)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return {alias: Catalog(spark, name) for alias, name in names.items()}
