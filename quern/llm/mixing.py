"""Mixing sources to target weights: repetition rates from totals per source, then whole copies plus one by a seeded hash.

Totals are partial sums, so a hot source costs one row a task. The targets come from one window over the table of
sources (a row a source). That table is written and counted: up to SOURCES sources and SOURCE_BYTES bytes of names it is
broadcast, so that documents are never shuffled; beyond, documents are dealt to copies of it by salt, so a hot source is split.

Each document is drawn by itself, so a source's taken words spread around its target by the sizes of its documents: a source
of few documents may miss it by a document or more, a large one comes near (see the README for figures).

Cases: null texts have size 0; a null source is a source of its own, last in order; a source without words has rate 0.
Texts of any length are taken whole. Rows are drawn one by one from a hash of seed, id, source and text: equal rows get equal copies, reruns agree, and a
null id is hashed as such. Columns that clash with a result's name are replaced by it. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words, own_name, salted_join

#: The most sources, and bytes of their names, of a table that is broadcast.
SOURCES, SOURCE_BYTES = 100_000, 8 << 20


def rates(totals: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """totals (source, source_size) with weight and target.

    Targets share all sizes by weight, and stop at most x a source's own size; what is over goes to the others by weight.
    That is the level at which sum(least(level * weight, most * size)) is the total: with sources in order of most * size
    / weight, those before the level's place are full, so one running sum finds it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    full = F.col("source_size") * most
    by_fill = Window.orderBy((full.cast("double") / F.col("weight")), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = w.withColumns({
        "_total": F.sum("source_size").over(every),
        "_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_full": F.coalesce(F.sum(full).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    level = (F.col("_total") - F.col("_full")).cast("double") / F.col("_left")
    w = w.withColumn("_level", F.when(level * F.col("weight") <= full, level))
    w = w.withColumn("_level", F.max("_level").over(every))  # levels fall from the first that fits on
    target = F.coalesce(F.least(F.col("_level") * F.col("weight"), full.cast("double")), full.cast("double"))
    return w.select("source", "source_size", "weight", target.alias("target"))


def draw(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=(1, 2, 3), most: int = 3, seed: int = 0, keep_text: bool = True) -> DataFrame:
    """df (without its text unless keep_text: then words are counted once) with size, source_size, target and copies, the number of times that the mix takes the row."""
    h = own_name(df, "mix_text")
    sized = df.withColumns({"size": n_words(F.col(text)), h: F.md5(F.col(text))})  # the hash tells apart rows that share an id, or have none
    if not keep_text:
        sized = materialise(sized.drop(text), "sizes")
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    s, a, b = own_name(df, "mix_source"), own_name(df, "mix_size"), own_name(df, "mix_target")
    table = materialise(rates(totals, weights, most).select(F.col("source").alias(s), F.col("source_size").alias(a), F.col("target").alias(b)), "rates")
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(s)), F.lit(0))).first()
    if n <= SOURCES and size <= SOURCE_BYTES:
        joined = sized.join(F.broadcast(table), sized[source].eqNullSafe(table[s]), "left")
    else:
        c, lone = own_name(df, "mix_name"), own_name(df, "mix_lone")  # null as a value, for a join by equal names
        named = lambda d, x: d.withColumns({c: F.coalesce(F.col(f"`{x}`"), F.lit("")), lone: F.col(f"`{x}`").isNull()})
        joined = salted_join(named(sized, source), named(table, s).drop(s), [c, lone], "left", [key, h]).drop(c, lone)
    rate = F.coalesce(F.try_divide(F.col(b), F.col(a).cast("double")), F.lit(0.0))
    whole = F.floor(rate)
    extra = (draw(seed, F.col(key), F.col(source), F.col(h)) < rate - whole).cast("int")
    return joined.withColumns({"source_size": F.col(a), "target": F.col(b), "copies": (whole + extra).cast("int")}).drop(s, a, b, h)


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixed corpus: df's own columns, each row as often as it is taken."""
    plan = with_copies(df, **options)
    return plan.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in df.columns])
