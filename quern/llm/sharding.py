"""Sharding: contiguous shards of near equal bytes, cut from a global prefix sum of sizes.

Rows are laid out in a total order (range partitions, sorted inside), each partition gives its total and its rows' local
prefix sums, and a prefix over the few totals places every partition in the whole. Cuts stand at equal targets. The order
is by the text's hash, then the key: equal texts are neighbours, and a cut that falls inside a group of them moves to the
group's nearer end if that costs no more than `slack` of a shard; a larger group is split, so hot groups can't unbalance.

Only keys, sizes and hashes are moved, never texts. The layout is written to the shared folder, so that totals and rows
come from the same partitions whatever executor is lost.

Cases: a null text has size 1 and the hash of an empty text's bytes; null keys come first among equal texts; rows equal in
all of this are interchangeable, and each gets a slot of its own. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    """df with size (UTF-8 bytes plus 1) and text_crc32 (unsigned)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.withColumns({"size": (F.octet_length(raw) + 1).cast("long"), "text_crc32": F.crc32(raw)})


def _running(batches):
    """Each row's place in its partition: the bytes and the rows before it."""
    import numpy as np

    size, rows = 0, 0
    for b in batches:
        n = np.asarray(b.column("size"), dtype=np.int64)
        ends = size + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - n), pa.array(np.arange(rows, rows + len(n), dtype=np.int64))], names=[*b.schema.names, "local_bytes", "local_rows"])
        if len(n):
            size, rows = int(ends[-1]), rows + len(n)


def shard_by_bytes(df: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", slack: float = 0.02) -> DataFrame:
    """key, size, text_crc32, shard and slot (its place in the shard, from 0) for every row of df."""
    ship(df.sparkSession)
    slim = sized(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", "size", "text_crc32", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    slim = slim.withColumn("tie", F.monotonically_increasing_id())
    slim = materialise(slim, "shard-keys")
    order = ["hash", "key", "tie"]
    laid = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    laid = materialise(laid.mapInArrow(_running, laid.schema.simpleString()[7:-1] + ", local_bytes: bigint, local_rows: bigint"), "shard-layout")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    totals = laid.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_bytes"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("part_rows"))
    placed = laid.join(F.broadcast(totals), "part").select(  # as many rows as there are partitions
        "key", "size", "text_crc32", "hash", (F.col("part_bytes") + F.col("local_bytes")).alias("start"), (F.col("part_rows") + F.col("local_rows")).alias("row"))
    total = placed.agg(F.max(F.col("start") + F.col("size"))).first()[0] or 0
    share = total / n_shards
    cuts = []
    if total:
        targets = [round(share * k) for k in range(1, n_shards)]
        inside = F.array(*[F.lit(t).cast("long") for t in targets])
        crossing = placed.filter(F.exists(inside, lambda t: (F.col("start") < t) & (t <= F.col("start") + F.col("size")))).select("hash").distinct()  # n_shards - 1 at most
        groups = placed.join(F.broadcast(crossing), "hash", "left_semi").groupBy("hash").agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("size")).alias("hi")).collect() if targets else []
        for t in targets:
            ends = [e for g in groups if g.lo < t <= g.hi for e in (g.lo, g.hi) if abs(e - t) <= slack * share]
            cuts.append(min(ends, key=lambda e: (abs(e - t), e)) if ends else t)
        cuts = sorted(cuts)
    shard = sum([(F.col("start") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    placed = placed.withColumn("shard", shard)
    firsts = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}  # n_shards at most
    table = F.create_map(*[x for k, v in firsts.items() for x in (F.lit(k), F.lit(v).cast("long"))]) if firsts else F.lit(None).cast("map<int,bigint>")
    return placed.select("key", "size", "text_crc32", "shard", (F.col("row") - F.element_at(table, F.col("shard"))).alias("slot"))
