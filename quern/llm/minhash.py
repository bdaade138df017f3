"""MinHash near-dedup: fast similarity sketches, banding, verification on full sets, components.

A set is a text's distinct 5-word shingles. Its sketch has PLACES places. In round r every shingle draws one place
and a value in [r, r + 1), and each place keeps its least value; so a place that is filled never changes later, and rounds
end once all are filled. If after as many rounds as places some are still empty, round places + j fills place j from all
shingles. Filling takes about places * ln(places) draws in all, however small the set, instead of places * shingles, and
the share of equal places estimates the similarity as tightly as independent hashes would.

1. Sketch every text; equal sets are one set from here on, so groups of copies never meet in the bands.
2. Sets that agree on all ROWS places of a band share a key. With 6 rows and 60 bands a pair at similarity 0.75 shares
   none with a chance of 8e-6, less above; `bands` lowers it further (6e-11 with 120). Of the sets of a key in one batch of
   input only the least goes on to the key's bucket, with the others as its candidates; there the least of these has the
   other batches' as candidates. So a key gives as many candidates as it has sets, and no task sees all sets of a hot key.
3. Candidates are verified on their full sets, up to FULL shingles in one task; links give components.
4. Keys whose sets aren't all in one component after that are compared in full: their sets are dealt by hash to blocks of
   about BLOCK sets or FULL shingles, and each pair of blocks is a task that counts common shingles exactly, by products of
   incidence matrices. It returns what joins components with each other, a row for each component that it joins, never
   pairs of sets. A third of the keys goes first, which joins most of a large group; then the others that are still open.

So a key's sets are compared exactly whatever their number and however near the threshold they are; only banding may miss
a link. Where a large group lies below the threshold its blocks are compared pairwise, which takes time, but moves no pairs.

Cases: texts without words have no set and are linked with nothing; fewer than 5 words are one shingle; A-Z count as a-z.
For near_duplicates(), rows without a key are linked with nothing and kept, and rows that repeat a key are rows of their own;
all of them are kept if the key is their component's least. one_of_each() links rows without a key like others and keeps
one row. Other columns are carried along. Texts of any length are taken whole, one at a time if they are longer than
PIECE_BYTES. An empty table gives no rows. Shingles are known by 64 bits inside a text or a pair, sets by 128.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, member_filter, salted_join, shielded, ship
from .components import components
from .textbytes import U64, Words, mix, pieces

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 60, 6
#: Places of a sketch.
PLACES = BANDS * ROWS
#: Sets and shingles of one block of a key's sets, about.
BLOCK, FULL = 256, 1 << 19
#: Sets of one batch of input, and of one bucket of keys.
BATCH, BUCKET = 4096, 20_000
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
#: A set under a key: its name in two halves and its size; MANY marks one that stands for others of its batch.
_ENTRY = np.dtype([("key", "<u8"), ("p", "<u8"), ("q", "<u8"), ("n", "<u4")])
MANY = 1 << 31


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending inside each text, and their n + 1 offsets."""
    w = Words(data, offsets, fold=True)
    at, h = w.windows(size, short=True)
    doc = w.text_of(at)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def sketches(h: np.ndarray, first: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Sets x places; a set without shingles keeps empty places."""
    n = len(first) - 1
    out = np.full((n, places), _EMPTY, dtype=U64)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
    live = np.flatnonzero(np.diff(first))
    turn = 0
    while len(live):
        x = mix(h + U64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((x >> U64(32)) * U64(places) >> U64(32)).astype(np.int64) if turn < places else turn - places
        np.minimum.at(flat, row * places + place, (U64(turn) << U64(32)) | (x & U64(0xFFFFFFFF)))
        turn += 1
        if turn % 4 == 0 or len(live) > 64:
            unfilled = (out[live] == _EMPTY).any(axis=1)
            if not unfilled.all():
                going = np.zeros(n, dtype=bool)
                going[live[unfilled]] = True
                keep = going[row]
                h, row, live = h[keep], row[keep], live[unfilled]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Sets x bands of 64-bit keys; a key holds its band."""
    odd = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
    bands = sketch[:, : bands * rows].reshape(len(sketch), -1, rows)
    return mix((mix(bands) * odd).sum(axis=2, dtype=U64) + mix(np.arange(bands.shape[1], dtype=U64)))


def _set_ids(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    raw = h.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * z], digest_size=16).digest() if a < z else None for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _binary(raw: bytes, width: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(width), len(raw) // width, [None, pa.py_buffer(raw)]).cast(pa.binary())


def _sketch(bands: int):
    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column("t")):
                h, first = shingle_sets(data, offsets)
                keys = band_keys(sketches(h, first, bands * ROWS), bands)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), b.column("k").slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array(_set_ids(h, first), pa.binary()), _binary(keys.tobytes(), 8 * bands)], names=["id", "k", "n_shingles", "s", "bands"])

    return run


def _sharing(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by key, the least set of each key first, and where keys begin."""
    e = e[np.lexsort((e["q"], e["p"], e["key"]))]
    return e, np.flatnonzero(np.append(True, e["key"][1:] != e["key"][:-1])) if len(e) else np.zeros(0, np.int64)


def _candidates(e: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Pairs of each key's least set and another of its sets, but for those whose sizes alone put them below the threshold."""
    hub = np.repeat(begins, np.diff(np.append(begins, len(e))))
    other = np.flatnonzero(hub != np.arange(len(e)))
    hub = hub[other]
    x, y = ((e["n"][k] & U64(MANY - 1)).astype(np.int64) for k in (hub, other))
    near = 100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)
    both = np.stack([e["p"][hub[near]], e["q"][hub[near]], e["p"][other[near]], e["q"][other[near]]], axis=1).astype("<u8")
    raw = b"".join(sorted(set(map(bytes, both.view("V32").reshape(-1))))) if len(both) else b""
    ends = np.frombuffer(raw, dtype="V16").reshape(-1, 2)
    return _binary(ends[:, 0].tobytes(), 16), _binary(ends[:, 1].tobytes(), 16)


_ROWS = "kind tinyint, a binary, b binary, key bigint, members array<binary>, bucket int, entries binary"


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    kinds = {"a": pa.binary(), "b": pa.binary(), "key": pa.int64(), "members": pa.list_(pa.binary()), "bucket": pa.int32(), "entries": pa.binary()}
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * n, pa.int8()), **{c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()}})


def _members(e: np.ndarray, begins: np.ndarray, ends: np.ndarray, block: int) -> pa.RecordBatch:
    """The sets of each of these keys, up to so many in a row."""
    keys, lists = [], []
    for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
        raw = np.stack([e["p"][a:z], e["q"][a:z]], axis=1).tobytes()
        own = [raw[k : k + 16] for k in range(0, len(raw), 16)]
        for k in range(0, len(own), block):
            keys.append(int(e["key"][a].view(np.int64)))
            lists.append(own[k : k + block])
    return _rows(1, len(keys), key=keys, members=lists)


def _deal(buckets: int, block: int):
    """Of each batch of sets: kind 0, candidates (a, b) of one key; 1, the sets of a key that has several; 2, a bucket's entries, each the least of its key in the batch."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                ids = np.frombuffer(b"".join(part.column("s").to_pylist()), dtype="<u8").reshape(-1, 2)
                keys = np.frombuffer(b"".join(part.column("bands").to_pylist()), dtype="<u8").reshape(len(ids), -1)
                e = np.empty(keys.size, dtype=_ENTRY)
                e["key"] = keys.reshape(-1)
                for name, x in (("p", ids[:, 0]), ("q", ids[:, 1]), ("n", np.minimum(np.asarray(part.column("n")), MANY - 1))):
                    e[name] = np.repeat(x, keys.shape[1])
                e, begins = _sharing(e)
                ends = np.append(begins[1:], len(e))
                several = ends - begins > 1
                x, y = _candidates(e, begins)
                if len(x):
                    yield _rows(0, len(x), a=x, b=y)
                if several.any():
                    yield _members(e, begins[several], ends[several], block)
                least = e[begins]
                least["n"][several] |= np.uint32(MANY)
                to = ((least["key"] >> U64(32)) % U64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield _rows(2, len(full), bucket=full, entries=[least[order[cuts[p] : cuts[p + 1]]].tobytes() for p in full])

    return run


def _meet(block: int):
    """A bucket's candidates between batches, and the sets of its keys that no batch has listed."""

    def run(table: pa.Table) -> pa.Table:
        e, begins = _sharing(np.frombuffer(b"".join(table["entries"].to_pylist()), dtype=_ENTRY))
        x, y = _candidates(e, begins)
        owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(e))))
        many = e["n"] >= MANY
        # keys of two sets are settled by their candidate
        open_ = (np.bincount(owner, minlength=len(begins)) + np.bincount(owner, many, minlength=len(begins)) > 2)[owner] & ~many
        single, owner = e[open_], owner[open_]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        return pa.Table.from_batches([_rows(0, len(x), a=x, b=y), _members(single, first, np.append(first[1:], len(single))[: len(first)], block)])

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each set on the left has in common with each on the right, exactly."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    both = np.intersect1d(*(np.unique(x) for x, _ in sides), assume_unique=True)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    if not len(both):
        return out
    placed = []
    for x, owner in sides:
        at = np.minimum(np.searchsorted(both, x), len(both) - 1)
        hit = both[at] == x
        order = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][order], owner[hit][order]))
    for lo in range(0, len(both), width):
        marks = []
        for (at, owner), sets in zip(placed, (left, right), strict=True):
            a, z = np.searchsorted(at, (lo, lo + width))
            m = np.zeros((len(sets), min(width, len(both) - lo)), dtype=np.float32)
            m[owner[a:z], at[a:z] - lo] = 1
            marks.append(m)
        out += np.rint(marks[0] @ marks[1].T).astype(np.int64)
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    both = _common(left, right)
    union = np.add.outer([len(x) for x in left], [len(x) for x in right]) - both
    return 100 * both >= PERCENT * union


def _verified(table: pa.Table) -> pa.Table:
    """The pairs of a set and others that are linked; the row without b has the set itself."""
    own, others, names, a = None, [], [], None
    for x, y, full in zip(table["a"].to_pylist(), table["b"].to_pylist(), table["full"].to_pylist(), strict=True):
        h = np.frombuffer(full, U64)
        if y is None:
            own = h
        else:
            others.append(h)
            names.append(y)
        a = x
    hit = np.flatnonzero(_linked([own], others)[0]) if others else []
    return pa.table({"a": pa.array([a] * len(hit), pa.binary()), "b": pa.array([names[k] for k in hit], pa.binary())})


def _compared(table: pa.Table) -> pa.Table:
    """Of the sets of two blocks of a key (or of one): components (a, b) that some link joins, a row for each but one of those joined."""
    block, labels = np.asarray(table["block"]), table["label"].to_pylist()
    sets = [np.frombuffer(x, U64) for x in table["full"].to_pylist()]
    names = {n: k for k, n in enumerate(sorted(set(labels)))}
    which = np.array([names[x] for x in labels], dtype=np.int64)
    sides = [np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())]
    rows, cols = np.nonzero(_linked(*([sets[k] for k in side] for side in sides)) & (which[sides[0]][:, None] != which[sides[1]][None, :]))
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for edge in np.unique(which[sides[0]][rows] * len(names) + which[sides[1]][cols]).tolist():
        x, y = sorted((find(edge // len(names)), find(edge % len(names))))
        root[y] = x
    own = sorted(names)
    joined = [(own[find(k)], own[k]) for k in range(len(own)) if find(k) != k]
    return pa.table({"a": pa.array([x for x, _ in joined], pa.binary()), "b": pa.array([y for _, y in joined], pa.binary())})


def _full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """s, n and full (its n shingle hashes, packed) of the wanted sets (s, k); texts has k and t. A filter picks their texts."""
    has = member_filter(wanted.select("k"))

    def run(batches):
        for b in batches:
            _, once = np.unique(np.asarray(b.column("k")), return_index=True)  # copies in a batch once
            own = b.take(pa.array(np.sort(once)))
            for _, _, data, offsets in pieces(own.column("t")):
                h, first = shingle_sets(data, offsets)
                rows = [(s, h[a:z].tobytes()) for s, a, z in zip(_set_ids(h, first), first[:-1], first[1:], strict=True) if s]
                yield pa.RecordBatch.from_pydict({"s": pa.array([s for s, _ in rows], pa.binary()), "n": pa.array([len(x) // 8 for _, x in rows], pa.int64()), "full": pa.array([x for _, x in rows], pa.binary())})

    full = texts.filter(has(F.col("k"))).select("k", "t").mapInArrow(run, "s binary, n bigint, full binary")
    return full.join(wanted.select("s"), "s", "left_semi").groupBy("s").agg(F.first("n").alias("n"), F.first("full").alias("full"))


def _blocks(n_sets, n_shingles, block: int):
    return F.greatest(F.ceil(n_sets / F.lit(block)), F.ceil(n_shingles / F.lit(FULL))).cast("int")


def _links(pairs: DataFrame, full: DataFrame, block: int) -> DataFrame:
    """The pairs (a, b) that hold on full sets; a set meets up to about BLOCK others or FULL shingles at a time."""
    own = pairs.withColumnRenamed("b", "s").join(full, "s").select("a", F.col("s").alias("b"), "n", "full")
    parts = own.groupBy("a").agg(_blocks(F.count("*"), F.sum("n"), block).alias("parts"))
    others = salted_join(own.drop("n"), parts, ["a"], "inner", ["b"]).select("a", "b", "full", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    itself = parts.withColumnRenamed("a", "s").join(full, "s").select(F.col("s").alias("a"), F.lit(None).cast("binary").alias("b"), "full", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return others.unionByName(itself).groupBy("a", "part").applyInArrow(_verified, "a binary, b binary")


def _joins(member: DataFrame, state: DataFrame, full: DataFrame, block: int) -> DataFrame:
    """Components (a, b) to be joined, by the keys (key, s) whose sets are in several; state: s, n, label."""
    known = member.join(state, "s").select("key", "s", "n", "label")
    still = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), _blocks(F.count("*"), F.sum("n"), block).alias("blocks")).filter("x <> y").select("key", "blocks")
    dealt = salted_join(known, still, ["key"], "inner", ["s"]).select("key", "s", "label", "blocks", F.pmod(F.xxhash64("s"), "blocks").cast("int").alias("block"))
    sides = dealt.join(full.select("s", "full"), "s").select("key", "label", "full", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return sides.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", "full").groupBy("key", "i", "j").applyInArrow(_compared, "a binary, b binary").distinct()


def _labelled(texts: DataFrame, kind: str, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """The texts (id, of that type, k and t) as id, k, n_shingles and s, and the components (s, label) of sets that are linked."""
    block = BLOCK
    sketched = materialise(texts.mapInArrow(_sketch(bands), f"id {kind}, k bigint, n_shingles bigint, s binary, bands binary"), "sketches")
    sets = materialise(sketched.filter("s is not null").groupBy("s").agg(F.first("bands").alias("bands"), F.first("n_shingles").alias("n"), F.min("k").alias("k")), "sets")
    buckets = max(32, sets.count() // BUCKET)
    dealt = materialise(sets.select("s", "n", "bands").mapInArrow(_deal(buckets, block), _ROWS), "dealt")
    met = materialise(dealt.filter("kind = 2").select("bucket", "entries").groupBy("bucket").applyInArrow(_meet(block), _ROWS), "met")
    found = dealt.filter("kind < 2").unionByName(met)
    pairs = materialise(found.filter("kind = 0").select("a", "b").distinct(), "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    member = found.filter("kind = 1").select("key", F.explode("members").alias("s"))
    ends = ends.unionByName(member.select("s").distinct()).distinct()  # a key's sets may differ too much in size to be candidates
    wanted = materialise(sets.select("s", "k").join(ends, "s", "left_semi"), "wanted")
    full = materialise(_full_sets(texts, wanted), "full-sets")
    joined = components(_links(pairs, full, block)).select(F.col("node").alias("s"), "label")
    state = materialise(full.select("s", "n").join(joined, "s", "left").select("s", "n", F.coalesce("label", "s").alias("label")), "state")
    discard(sets, pairs, wanted, joined)

    # what the least sets have not settled
    for some in (F.pmod("key", F.lit(3)) == 0, F.pmod("key", F.lit(3)) != 0):
        more = materialise(_joins(member.filter(some), state, full, block), "joins")
        if not more.isEmpty():
            moved = components(more).select(F.col("node").alias("label"), F.col("label").alias("to"))
            now = materialise(salted_join(state, moved, ["label"]).select("s", "n", F.coalesce("to", "label").alias("label")), "state")
            discard(state, moved)
            state = now
        discard(more)
    discard(dealt, met, full)
    return sketched.select("id", "k", "n_shingles", "s"), state.select("s", "label")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS) -> DataFrame:
    """The rows of df that stay where one row of each component may: the first by key (none last), text hash and all other columns.

    Rows without a key are linked by their sets like others, and rows that repeat a key and its text are one row. Texts without
    words are linked with nothing, so those without a key all stay. Only rows that may go or be repeated are shuffled with their texts.
    """
    ship(df.sparkSession)
    sketched, labels = _labelled(df.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("k"), F.col(text).alias("t")), df.schema[key].dataType.simpleString(), bands)
    places = sketched.groupBy("id", "k", "s").agg(F.count("*").alias("n"))
    joined = materialise(salted_join(places, labels, ["s"]).select("id", "k", "n", F.coalesce("label", "s").alias("label")), "places")
    first = joined.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("lone"), "id", "k")).alias("f"))
    rest = salted_join(joined.filter("label is not null"), first, ["label"], "inner").select("id", "k", "n", (F.col("id").eqNullSafe(F.col("f.id")) & (F.col("k") == F.col("f.k"))).alias("stays"))
    alone = joined.filter("label is null").select("id", "k", F.when(F.col("id").isNull(), F.lit(1)).otherwise(F.col("n")).alias("n"), F.lit(True).alias("stays"))
    touched = materialise(rest.unionByName(alone).filter("n > 1 or not stays"), "touched")
    discard(sketched, labels, joined)

    place = lambda a, b: F.xxhash64(F.coalesce(a.cast("string"), F.lit("-")), b)
    has, own = member_filter(touched.select(place(F.col("id"), F.col("k")))), F.xxhash64(df[text])
    calm, rows = df.filter(~has(place(df[key], own))), df.filter(has(place(df[key], own)))
    on = rows[key].eqNullSafe(touched["id"]) & (own == touched["k"])
    out = calm.unionByName(rows.join(touched, on, "left_anti"))
    repeated = touched.filter("stays")
    if repeated.isEmpty():
        return out
    least = rows.join(repeated, rows[key].eqNullSafe(repeated["id"]) & (own == repeated["k"]), "left_semi").groupBy(F.col(key).alias("_id"), F.xxhash64(F.col(text)).alias("_k")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_row"))
    return out.unionByName(least.select("_row.*"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True, bands: int = BANDS) -> DataFrame:
    """df (without its text unless keep_text) with n_shingles, component_id (the least key among the texts that links join to it) and kept (whether that is its own)."""
    ship(df.sparkSession)
    results = ("n_shingles", "component_id", "kept")
    df, restored = shielded(df, "_id", "_k")
    carried = [c for c in df.columns if c.lower() not in results and (keep_text or c != text)]
    src = df.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("k"), F.col(text).alias("t"))
    sketched, labels = _labelled(src.filter("id is not null"), df.schema[key].dataType.simpleString(), bands)
    # a row for each set that has several rows or links; the others are their own components
    sets = sketched.filter("s is not null").groupBy("s").agg(F.min("id").alias("own"), F.count("*").alias("n"))
    sets = sets.join(labels, "s", "left").filter("n > 1 or label is not null").select("s", "own", F.coalesce("label", "s").alias("label"))
    sets = materialise(salted_join(sets, sets.groupBy("label").agg(F.min("own").alias("component_id")), ["label"], "inner").select("s", "component_id"), "set-components")
    rows = materialise(salted_join(sketched, sets, ["s"]).select("id", "k", "n_shingles", F.coalesce("component_id", "id").alias("component_id")), "row-components")
    discard(sketched, labels, sets)
    if carried == [key]:
        own = rows.select(F.col("id").alias(key), "n_shingles", "component_id")
    else:  # equal keys and texts have equal results
        rows = rows.dropDuplicates(["id", "k"]).withColumnRenamed("k", "_k").withColumnRenamed("id", "_id")
        base = df.filter(F.col(key).isNotNull()).select(*[F.col(f"`{c}`") for c in carried], F.xxhash64(F.col(text)).alias("_k"))
        own = base.join(rows, (base[key] == rows["_id"]) & (base["_k"] == rows["_k"])).drop("_id", "_k")
    lone = df.filter(F.col(key).isNull()).select(F.col(text).alias("t"), F.monotonically_increasing_id().alias("k"), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(carried)])

    def count(batches):
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column("t")):
                _, first = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(2, b.num_columns)), pa.array(np.diff(first), pa.int64())], names=[*b.schema.names[2:], "n"])

    lone = lone.mapInArrow(count, ", ".join([f"c{n} {df.schema[c].dataType.simpleString()}" for n, c in enumerate(carried)] + ["n bigint"]))
    lone = lone.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(carried)], F.col("n").alias("n_shingles"), F.lit(None).cast(df.schema[key].dataType).alias("component_id"))
    out = restored(own.unionByName(lone))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
