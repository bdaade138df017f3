"""Connected components of a graph that may be far larger than one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _marks(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and label, the least node that it is joined to, for the nodes of edges (a, b) of any comparable type.

    Alternating stars: in turn each node hands its larger, then its smaller neighbours to the least one it knows, until
    every component is a star around its least node; about log(nodes) rounds. Least neighbours are partial aggregates and
    the joins can be split, so a node may have any number of edges. Each round is written out. Loops and null ends are
    ignored, repeated edges are one. No edges, no rows.
    """
    here = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    marks = _marks(here)
    for _ in range(most_rounds):
        if not marks[0]:
            break
        # large stars: v > u goes to the least of u and its neighbours
        both = here.unionByName(here.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.least("a", "m").alias("a"), "b").filter("a <> b").distinct()
        large = materialise(large, "edges")
        # small stars: smaller neighbours and the node itself go to the least of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m"), "a", "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now = materialise(small, "edges")
        discard(here, large)
        here, before, marks = now, marks, _marks(now)
        if marks == before:
            break
    else:
        raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
    return here.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(here.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
