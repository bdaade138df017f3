"""Line dedup: winnowed line hashes find repeated runs of lines; later ones are deleted.

Each window of `run` consecutive lines gives its smallest line hash as a fingerprint, so any shared run of that many
lines shares one. Fingerprints found twice are joined to their positions, and from each the match is extended both ways,
to every window of `run` lines around it; equal windows are brought together by their first place, never as pairs, and
the union of windows that aren't first makes the maximal repeated runs. Counts and first places are partial aggregates,
so a line that a third of all texts hold costs a row a task; the rows of hot fingerprints and windows are dealt to several
tasks by salt. Filters of fixed size keep fingerprints and texts that can't be affected out of the joins, so texts that
lose nothing are never shuffled. No table that grows with the input is broadcast, so none is held by the driver.

Without `words` a repeat of fewer than `run` lines stays, however long its lines are. With it, windows of 1 to `run` - 1
lines that have more words than that are runs too; being few, they need no fingerprints.

A line is what \\n separates, compared without white space at its ends; lines without a word are kept and not counted. A
line goes if a run around it also starts at an earlier place, in order of key, text hash and line. Cases: null
texts stay null and have no lines; an empty text stays empty; null keys come first; rows equal in key and text are one place
and get the same result; texts of fewer lines than `run` stay as they are, unless `words` is given. Texts of any length are
taken whole, a row at a time. Other columns are carried along, but for n_lines and n_removed_lines. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, discard, materialise, member_filter, n_words, salted_join, shielded

RUN = 3


def _nonblank(line):
    return F.length(F.btrim(line, F.lit(SPACES))) > 0


def _short_windows(rows: DataFrame, run: int, words: int) -> DataFrame:
    """Windows of fewer lines than run and more words than words; their a and b come from two hashes of each line, as they may hold one line alone."""

    def of(n):
        parts = F.transform("l", lambda x, k: F.struct(k.alias("at"), F.slice("l", k + 1, F.lit(n)).alias("part")))
        return F.filter(parts, lambda p: (F.size(p["part"]) == n) & (F.aggregate(p["part"], F.lit(0).cast("long"), lambda total, x: total + x["words"]) > words))

    found = rows.select("key", "hash", F.explode(F.concat(*[of(n) for n in range(1, run)])).alias("w")).select("key", "hash", "w.*")
    each = lambda f: F.transform("part", lambda x: x[f])
    return found.select("key", "hash", "at", each("i").alias("lines"), F.xxhash64(each("h")).alias("a"), F.xxhash64(F.lit(1), each("g")).alias("b")).dropDuplicates(["key", "hash", "at", "lines"])


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = None) -> DataFrame:
    """key, hash (of the text) and removed (line numbers of the text, from 0) of texts that lose lines."""
    more = lambda x: [] if words is None else [F.xxhash64(F.lit(1), F.btrim(x, F.lit(SPACES))).alias("g"), n_words(x).alias("words")]
    lines = F.filter(
        F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(F.xxhash64(F.btrim(x, F.lit(SPACES))).alias("h"), i.alias("i"), _nonblank(x).alias("some"), *more(x))),
        lambda x: x["some"])
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"), lines.alias("l"))
    every, rows = rows, rows.filter(F.size("l") >= run)
    last = F.size("l") - run
    least = lambda j: F.array_min(F.transform(F.slice("l", j + 1, F.lit(run)), lambda x, o: F.struct(x["h"].alias("h"), (j + o).alias("at"))))
    prints = rows.select("key", "hash", "l", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), last), least))).alias("f"))
    near = F.greatest(F.col("f.at") - (run - 1), F.lit(0))  # the first line of the first window around the fingerprint
    prints = prints.select("key", "hash", F.col("f.h").alias("print"), near.alias("base"), F.slice("l", near + 1, F.least(F.col("f.at") + run, F.size("l")) - near).alias("around"))
    twice = materialise(prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"), "line-prints")
    hits = salted_join(prints.filter(member_filter(twice)(F.col("print"))), twice, ["print"], "left_semi", ["key", "hash", "base"], merge=True)
    starts = F.sequence(F.lit(0), F.size("around") - run)
    of = lambda k: F.slice("around", k + 1, F.lit(run))
    windows = hits.select("key", "hash", F.explode(F.transform(starts, lambda k: F.struct(
        (F.col("base") + k).alias("at"), F.transform(of(k), lambda x: x["i"]).alias("lines"),
        F.xxhash64(F.transform(of(k), lambda x: x["h"])).alias("a"), F.xxhash64(F.lit(1), F.transform(of(k), lambda x: x["h"])).alias("b")))).alias("w"))
    windows = windows.select("key", "hash", "w.*").dropDuplicates(["key", "hash", "at"])
    if words is not None and run > 1:
        windows = windows.unionByName(_short_windows(every, run, words))
    windows = materialise(windows, "line-windows")
    discard(twice)
    place = F.struct("key", "hash", "at")
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = salted_join(windows, firsts, ["a", "b"], "inner", ["key", "hash", "at"], merge=True).filter(~place.eqNullSafe(F.col("first")))
    return later.select("key", "hash", F.explode("lines").alias("i")).groupBy("key", "hash").agg(F.collect_set("i").alias("removed"))


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = None) -> DataFrame:
    """df with the lines that remain in its text, n_lines (with a word, before) and n_removed_lines."""
    df, restored = shielded(df, "_key", "_hash", "removed")
    gone = materialise(repeated_lines(df, key, text, run, words).select(F.col("key").alias("_key"), F.col("hash").alias("_hash"), "removed"), "line-removed")
    t = F.col(f"`{text}`")
    place = lambda k, h: F.xxhash64(F.coalesce(k.cast("string"), F.lit("-")), h)
    has, own = member_filter(gone.select(place(F.col("_key"), F.col("_hash")))), F.xxhash64(df[text])
    touched = df.filter(has(place(df[key], own)))
    joined = touched.join(gone.hint("merge"), touched[key].eqNullSafe(gone["_key"]) & (own == gone["_hash"]), "left").drop("_key", "_hash")
    joined = joined.unionByName(df.filter(~has(place(df[key], own))).withColumn("removed", F.lit(None).cast("array<int>")))
    kept = F.array_join(F.filter(F.split(t, "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    n = F.size(F.filter(F.split(F.coalesce(t, F.lit("")), "\n"), _nonblank)).cast("long")
    out = joined.withColumns({"n_lines": n, "n_removed_lines": F.coalesce(F.size("removed"), F.lit(0)).cast("long")})
    out = out.withColumn(text, F.when(F.col("removed").isNotNull(), kept).otherwise(t))
    return restored(out.drop("removed"))
