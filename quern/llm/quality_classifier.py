"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; each pair of a text's features adds the product of their vectors, which
captures what words mean together with a text's structure. All pairs are scored in time linear in the features, since
sum_{i<j} <v_i, v_j> x_i x_j = ((sum_i v_i x_i)^2 - sum_i v_i^2 x_i^2) / 2, summed over the vectors' places.

Training sees a bounded sample of labelled rows (SAMPLE, those with the smallest hash of their key); their features are
made on the executors, the model is fitted on the driver and is of fixed size (BUCKETS x (RANK + 1) numbers), so it can be
broadcast. The sample's features go to the driver, 8 bytes each: one for each distinct word bucket of a row, so BUCKETS a row at
most (2 GB for a sample of nothing but the longest texts; 21 MB as measured). Scoring is one narrow pass over whole texts. Features come from numpy over Arrow buffers, PIECE_BYTES at a time.

Never inputs of a score: labels, and any column but the text and the named metadata. Cases: a null or empty text has only
its structure features; null metadata is a value of its own; without labels (or with one class) the score is 0.5 (or the
class's smoothed share) for all. Rows labelled twice count twice, null labels don't count. Texts of any length are scored
whole. Other columns are carried along. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textbytes import U64, Words, mix, pieces

#: Labelled rows that a fit takes at most.
SAMPLE = 8_000
#: Hash buckets of words; structure and metadata features have STRUCTURE places after them.
BUCKETS, STRUCTURE, RANK = 1 << 15, 512, 8
LEVELS = 16  # of a structure statistic

_CLASSES = [b"#*$%&<>@^~\\", b"|", bytes(range(65, 91)), b"0123456789", b"!?", b"\n", b".,;:", b"()[]{}\"'/_-=+"]


def _lanes() -> list[np.ndarray]:
    """Byte tables that count three classes at a time, in 21 bits each."""
    out = []
    for k in range(0, len(_CLASSES), 3):
        lane = np.zeros(256, dtype=U64)
        for j, chars in enumerate(_CLASSES[k : k + 3]):
            lane[list(chars)] += U64(1) << U64(21 * j)
        out.append(lane)
    return out


_LANES = _lanes()


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each class in each text (texts x classes); in steps, so that no lane overflows."""
    n = len(offsets) - 1
    out = np.zeros((n, len(_CLASSES)), dtype=np.int64)
    step = 1 << 20
    for lo in range(0, len(data), step):
        part = data[lo : lo + step]
        at = np.clip(offsets - lo, 0, len(part))
        for k, lane in enumerate(_LANES):
            sums = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(lane[part], out=sums[1:])
            got = sums[at[1:]] - sums[at[:-1]]
            for j in range(min(3, len(_CLASSES) - 3 * k)):
                out[:, 3 * k + j] += ((got >> U64(21 * j)) & U64((1 << 21) - 1)).astype(np.int64)
    return out


def _levels(x: np.ndarray) -> np.ndarray:
    """Shares from 0 to 1 on a scale that is fine near 0."""
    return np.clip(np.ceil(np.sqrt(np.clip(x, 0, 1)) * (LEVELS - 1)), 0, LEVELS - 1).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, feature ids, values) of texts: words with damped counts and unit length together, structure and metadata at 1/2 each."""
    w = Words(data, offsets, fold=True)
    n, counts = len(offsets) - 1, w.counts()
    doc = np.repeat(np.arange(n), counts)
    keys, times = np.unique(doc * BUCKETS + (w.hashes & U64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    owner = keys // BUCKETS
    value = np.log1p(times.astype(np.float32))
    norm = np.sqrt(np.bincount(owner, value * value, minlength=n))
    value /= np.maximum(norm, 1e-6)[owner].astype(np.float32)

    size = np.maximum(np.diff(offsets), 1)
    words = np.maximum(counts, 1)
    same = np.zeros(len(w.hashes), dtype=bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    lengths = np.bincount(doc, w.ends - w.starts, minlength=n) / words
    single = np.bincount(owner, times == 1, minlength=n)
    by_class = _class_counts(data, offsets)
    shares = [by_class[:, k] / (words if k in (1, 4, 6) else size) for k in range(len(_CLASSES))]
    shares += [np.bincount(doc, same, minlength=n) / words, single / words, np.bincount(owner, minlength=n) / words]
    stats = [_levels(s) for s in shares] + [np.minimum(lengths, LEVELS - 1).astype(np.int64), np.minimum(np.log2(1 + counts), LEVELS - 1).astype(np.int64)]
    stats = [k * LEVELS + s for k, s in enumerate(stats)]
    first = len(stats) * LEVELS
    room = STRUCTURE - first
    stats += [first + (mix(m + U64(k + 1)) % U64(room)).astype(np.int64) for k, m in enumerate(meta)]
    extra = np.stack(stats, axis=1) + BUCKETS

    ids = np.concatenate([keys % BUCKETS, extra.reshape(-1)])
    owners = np.concatenate([owner, np.repeat(np.arange(n), extra.shape[1])])
    values = np.concatenate([value, np.full(extra.size, 0.5, dtype=np.float32)])
    order = np.argsort(owners, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n))])
    return bounds, ids[order].astype(np.int32), values[order].astype(np.float32)


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, bounds: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Linear time: the square of each sum less the sum of squares."""
        v = self.vectors[ids] * values[:, None]
        starts = bounds[:-1]  # no text is without features
        total = np.add.reduceat(v, starts, axis=0) if len(starts) else np.zeros((0, v.shape[1]))
        squares = np.add.reduceat((v * v).sum(axis=1), starts) if len(starts) else np.zeros(0)
        linear = np.add.reduceat(self.weights[ids] * values, starts) if len(starts) else np.zeros(0)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)

    def scores(self, *x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*x), -30, 30)))


def fit(bounds: np.ndarray, ids: np.ndarray, values: np.ndarray, labels: np.ndarray, epochs: int = 8, rate: float = 0.1, decay: float = 1e-4, batch: int = 256, seed: int = 7) -> Model:
    """Logistic loss by AdaGrad over shuffled batches, both classes weighing the same; the same rows give the same model."""
    size = BUCKETS + STRUCTURE
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32))
    if len(np.unique(labels)) < 2:
        model.vectors[:] = 0
        return model
    model.bias, weight = 0.0, np.where(labels > 0.5, 0.5 / share, 0.5 / (1 - share))
    g_bias, g_w, g_v = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            spans = [np.arange(bounds[r], bounds[r + 1]) for r in rows]
            take, b = np.concatenate(spans), np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            i, x = ids[take], values[take]
            err = (model.scores(b, i, x) - labels[rows]) * weight[rows] / len(rows)
            own = np.repeat(np.arange(len(rows)), np.diff(b))
            v = model.vectors[i] * x[:, None]
            total = np.add.reduceat(v, b[:-1], axis=0)
            scale = (err[own] * x)[:, None]
            touched, where = np.unique(i, return_inverse=True)
            gw = np.bincount(where, err[own] * x) + decay * model.weights[touched]
            full = scale * (total[own] - v)
            gv = np.stack([np.bincount(where, full[:, f]) for f in range(RANK)], axis=1) + decay * model.vectors[touched]
            g_w[touched] += gw * gw
            g_v[touched] += gv * gv
            g_bias += err.sum() ** 2
            model.weights[touched] -= (rate * gw / np.sqrt(g_w[touched])).astype(np.float32)
            model.vectors[touched] -= (0.3 * rate * gv / np.sqrt(g_v[touched])).astype(np.float32)
            model.bias -= float(rate * err.sum() / np.sqrt(g_bias))
    return model


def _prepared(df: DataFrame, text: str, meta: tuple[str, ...], carried: list[str]) -> DataFrame:
    """Carried columns as c0, c1 ..., then a hash of each metadata column, then the text."""
    # a number counts by its order of size, anything else by its value
    def code(c: str):
        kind = dict(df.dtypes)[c]
        x = F.col(f"`{c}`")
        return F.xxhash64(F.lit(c), F.floor(F.log2(F.greatest(x, F.lit(0)) + F.lit(1.0))) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else x)
    return df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)], *[code(c).alias(f"m{k}") for k, c in enumerate(meta)], F.col(f"`{text}`").alias("t"))


def _meta(batch: pa.RecordBatch, lo: int, hi: int) -> list[np.ndarray]:
    return [np.asarray(batch.column(k).slice(lo, hi - lo)).astype(np.int64).view(U64) for k, n in enumerate(batch.schema.names) if n.startswith("m")]


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", meta: tuple[str, ...] = (), sample: int = SAMPLE) -> Model:
    """A model from the rows of df that labels (key, label) has; at most `sample` of them."""
    ship(df.sparkSession)
    chosen = labels.select(F.col(key).alias("c0"), F.col(label).cast("int").alias("y")).filter("c0 is not null and y is not null")
    chosen = chosen.orderBy(F.xxhash64(F.col("c0").cast("string")), "c0", "y").limit(sample)
    rows = _prepared(df, text, meta, [key]).join(F.broadcast(chosen), "c0")  # the sample is bounded
    names = [f"m{k}" for k in range(len(meta))]

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column(b.schema.get_field_index("t"))):
                bounds, ids, values = features(data, offsets, _meta(b, lo, hi))
                cut = lambda x: [x[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"key": b.column("k").slice(lo, hi - lo), "y": b.column("y").slice(lo, hi - lo), "ids": pa.array(cut(ids), pa.binary()), "vals": pa.array(cut(values), pa.binary())})

    got = rows.select(F.col("c0").cast("string").alias("k"), "y", *names, "t").mapInArrow(run, "key string, y int, ids binary, vals binary").toArrow().to_pylist()
    got = sorted(got, key=lambda r: (r["key"], r["y"], r["ids"]))
    if not got:
        return Model(0.0, np.zeros(BUCKETS + STRUCTURE, np.float32), np.zeros((BUCKETS + STRUCTURE, RANK), np.float32))
    ids = [np.frombuffer(r["ids"], np.int32) for r in got]
    values = [np.frombuffer(r["vals"], np.float32) for r in got]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    return fit(bounds, np.concatenate(ids), np.concatenate(values), np.array([r["y"] for r in got], dtype=np.float64))


def score(df: DataFrame, model: Model, text: str = "text", meta: tuple[str, ...] = (), keep_text: bool = True) -> DataFrame:
    """df (without its text unless keep_text) with score, the estimated probability of label 1."""
    ship(df.sparkSession)
    carried = [c for c in df.columns if c.lower() != "score" and (keep_text or c != text)]
    src = _prepared(df, text, meta, carried)
    ddl = ", ".join([f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(carried)] + ["score double"])
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column(b.schema.get_field_index("t"))):
                s = shared.value.scores(*features(data, offsets, _meta(b, lo, hi)))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(len(carried))), pa.array(s, pa.float64())], names=[*b.schema.names[: len(carried)], "score"])

    out = src.mapInArrow(run, ddl)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carried)], "score")


def held_out(key: str = "doc_id"):
    """Rows that no fit may learn labels from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
