"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Documents are encoded and forgotten: only (length, documents) is aggregated, with partial sums in each task, so a hot
source or a third of equal lengths costs a row a task. The histogram answers everything else: its suffix sums give, for
every length L, the documents and tokens at or above L, the total if each text is cut at L, and L's quantile.

Cases: null and empty texts have length 0. An empty table has an empty histogram. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encode
from .common import materialise

#: Lengths of one block; suffix sums run inside blocks and over the blocks' totals, so no task sees all lengths.
BLOCK = 1024


def histogram(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens and n_docs, a row for each length that occurs; written out, so that texts are encoded once however it is used."""
    lengths = encode(df.select(F.col(text).alias("text")), path, pattern, count_only=True)
    return materialise(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-histogram")


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """hist with, for each length L: docs_at_least, tokens_at_least, truncated_total (all texts cut at L) and quantile (share of documents up to L)."""
    h = hist.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / block).cast("long")})
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of lengths
    every = Window.partitionBy()
    totals = totals.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    down = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(totals, "block").withColumns({
        "docs_at_least": F.sum("n_docs").over(down) + F.col("d_later"),
        "tokens_at_least": F.sum("tokens").over(down) + F.col("t_later")})
    return h.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"))


def truncated_totals(hist: DataFrame, limits) -> DataFrame:
    """limit and total tokens if each text is cut there, for any limits, in one pass over the histogram."""
    sums = [F.coalesce(F.sum(F.least("n_tokens", F.lit(c)) * F.col("n_docs")), F.lit(0)).alias(f"l{c}") for c in limits]
    pairs = F.array(*[F.struct(F.lit(c).cast("long").alias("limit"), F.col(f"l{c}").alias("total_tokens")) for c in limits])
    return hist.agg(*sums).select(F.explode(pairs).alias("x")).select("x.*")


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length up to which a share q of the documents reaches; sums as suffix_sums() gives them."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
