"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters and nothing else.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java pattern.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a context, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():  # else the package came in an archive that is shipped already
        path = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
    sc._quern_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of this machine's, if all of Spark runs in this process; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str, row_group: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors, and is computed once.

    The tables of an application lie in a folder of its own, which goes when this process ends. Small row groups (in bytes)
    let the table be read by more tasks than wrote it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    own = f"{shared_dir(spark)}/quern/{sc.applicationId}"
    if own not in _FOLDERS:
        _FOLDERS[own] = sc._jvm, sc._jsc.hadoopConfiguration()
    path = f"{own}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FOLDERS: dict[str, tuple] = {}


def _delete(name: str, jvm, conf) -> None:
    path = jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(conf).delete(path, True)


@atexit.register
def _leave_nothing() -> None:
    for name, (jvm, conf) in _FOLDERS.items():
        try:
            _delete(name, jvm, conf)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass


def discard(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quern/" in name:
                _delete(name, sc._jvm, sc._jsc.hadoopConfiguration())


#: Words of 64 bits in one part of a filter, and the most bits of a filter (8 MB).
_PART, MOST_BITS = 4096, 1 << 26


def member_filter(hashes: DataFrame):
    """A native test of 64-bit hashes, as a function from Column to Column: true for all in `hashes` (one column) and by chance for some others.

    16 bits a member, but 8 MB at most, so it may go to all tasks whatever the number of members. Past 4 million members more
    and more others pass; what passes must be joined with the members anyway, so that costs shuffle, not results.
    """
    spark = hashes.sparkSession
    members = hashes.toDF("h")
    bits = 1 << min(max((16 * members.count()).bit_length(), 18), MOST_BITS.bit_length() - 1)
    place = F.pmod("h", F.lit(bits))
    some = members.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(h, 64) AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = spark.range(bits // 64).withColumnRenamed("id", "word").join(some, "word", "left").select(F.expr(f"word div {_PART}").alias("part"), F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")).alias("w"))
    parts = every.groupBy("part").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("words"))  # _PART of them
    table = materialise(parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "words"))), lambda x: x["words"]).alias("parts")), "filter").scalar()

    def test(h: Column) -> Column:
        at = F.pmod(h, F.lit(bits))
        word = F.shiftright(at, 6)
        return F.getbit(F.get(F.get(table, F.shiftright(word, _PART.bit_length() - 1).cast("int")), F.pmod(word, F.lit(_PART)).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1

    return test


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", by: list[str] | None = None, salt: int = 8, merge: bool = False) -> DataFrame:
    """rows joined with a table of one row a key, where any key may have a large share of the rows: they are dealt, by the columns
    `by` (all but the key), to `salt` copies of the table's.

    With `merge` the table is never broadcast. Spark takes its size for that of one copy, and for a file's packed size, so that
    what stayed under a threshold of 10 MB took 308 MB in the driver."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by or rows.columns if c not in on]), F.lit(salt)))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    return left.join(right.hint("merge") if merge else right, [*on, "_salt"], how).drop("_salt")


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{stem}{'_' * k}" for k in range(1, 99)) if n.lower() not in taken)


def shielded(df: DataFrame, *names: str):
    """df with columns of these names called something else, and a function that gives a frame its names back."""
    moved = {}
    for c in df.columns:
        if c.lower() in names:
            moved[c] = own_name(df, f"__own_{c}")
            df = df.withColumnRenamed(c, moved[c])

    def restored(out: DataFrame) -> DataFrame:
        for c, n in moved.items():
            out = out.withColumnRenamed(n, c)
        return out

    return df, restored


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
