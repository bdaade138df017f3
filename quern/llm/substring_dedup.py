"""Substring dedup: words covered by a window of `window` words that also starts somewhere else are removed everywhere.

Fixed-block anchors: with blocks of B = (window + 1) // 2 words at multiples of B in each text, every window holds one
whole block. So of two equal windows, each text's block is met by a rolling block of the other. Three passes:

1. Index: hash every non-overlapping block. The index is a filter of FILTER_BITS bits in two layers (met, met twice),
   of that fixed size however large the corpus, which is what allows broadcasting it. Its address ranges are built by tasks
   that hold a range of either layer and take addresses batch by batch, each at most twice from a piece of input.
2. Probe and extend: every rolling block of every text probes the index (a block doesn't count as meeting itself). Around
   each hit the match is extended to full windows, which are compared by 128 bits of their words: equal windows are
   brought together and all of them confirmed. Overlapping confirmed windows make the maximal repeats.
3. Remove: texts get the confirmed places of their own content and lose the words. A filter of fixed size lets only texts
   that may have some through to that join; the others are never shuffled.

A filter has false hits, never misses; they cost shuffle, not results: a window is confirmed only by its equal. Beyond
about FILTER_BITS / 16 blocks false hits grow until, far beyond, every window is compared, 25 bytes each.

Windows move packed: a row for each piece of input and hash bucket, with arrays in bytes. Windows equal within a piece are
settled there and one of them stands for the piece, so a passage that a third of all texts hold costs an entry a piece,
not one a text. No pairs are formed.

Places are (text, word), so equal texts share their result; 128 bits stand for a text (of its SHA-256) and a window. Cases:
null and empty texts have no words; texts shorter than a window lose none; keys don't matter and may be null or repeat; rows
equal in all columns are texts of their own, so what they share is removed from both. Texts of any length are taken whole,
one at a time if they are longer than PIECE_BYTES. Other columns are carried along. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, member_filter, ship
from .textbytes import U64, Words, mix, pieces

WINDOW = 35
#: Bits of each of the filter's two layers (32 MB each), and addresses of a block.
FILTER_BITS, ADDRESSES = 1 << 28, 3
#: Bytes of text for each range of the filter, and the least and most ranges.
RANGE_BYTES, RANGES, MOST_RANGES = 1 << 30, 64, 4096
#: Bytes of text for each bucket of windows, and the least number of buckets.
BUCKET_BYTES, BUCKETS = 16 << 20, 32


_U32 = np.uint32


def _addresses(blocks: np.ndarray, bits: int) -> np.ndarray:
    """ADDRESSES places in the filter for each block (ADDRESSES x blocks)."""
    second = mix(blocks ^ U64(0xA5A5A5A5A5A5A5A5)) | U64(1)
    return np.stack([(blocks + U64(k) * second) & U64(bits - 1) for k in range(ADDRESSES)]).astype(np.int64)


def _aligned(w: Words, at: np.ndarray, size: int) -> np.ndarray:
    """Which of these words stand at a multiple of size in their text."""
    return (at - w.first[w.text_of(at)]) % size == 0


def build_filter(df: DataFrame, block: int, bits: int = FILTER_BITS, ranges: int = RANGES) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of bits as bytes: addresses that some block has, and that two or more have. df has a text column `t`."""
    part = bits // ranges

    def addresses(batches):
        for b in batches:
            for _, _, data, offsets in pieces(b.column("t")):
                w = Words(data, offsets)
                at, h = w.windows(block)
                got, n = np.unique(_addresses(h[_aligned(w, at, block)], bits).reshape(-1), return_counts=True)
                got = np.repeat(got, np.minimum(n, 2))  # a block that all texts have comes twice from a piece, not more often
                cuts = np.searchsorted(got, np.arange(ranges + 1) * part)
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({"range": pa.array(full, pa.int32()), "own": pa.array([(got[cuts[r] : cuts[r + 1]] - r * part).astype(_U32).tobytes() for r in full], pa.binary())})

    def layers(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(part, dtype=bool), np.zeros(part, dtype=bool)
        for b in batches:
            for own in b.column("own"):
                a, n = np.unique(np.frombuffer(own.as_buffer(), dtype=_U32), return_counts=True)
                twice[a[once[a] | (n > 1)]] = True
                once[a] = True
        yield pa.RecordBatch.from_pydict({"range": pa.array([key[0].as_py()], pa.int32()), "once": pa.array([np.packbits(once, bitorder="little").tobytes()], pa.binary()), "twice": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    rows = df.select("t").mapInArrow(addresses, "range int, own binary").groupBy("range").applyInArrow(layers, "range int, once binary, twice binary")
    once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
    for r in materialise(rows, "substring-filter").toLocalIterator():  # two layers of fixed size in all
        lo = r["range"] * part // 8
        once[lo : lo + part // 8] = np.frombuffer(r["once"], np.uint8)
        twice[lo : lo + part // 8] = np.frombuffer(r["twice"], np.uint8)
    return once, twice


def _set(layer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all of a block's addresses are set."""
    out = np.ones(at.shape[1], dtype=bool)
    for row in at:
        left = np.flatnonzero(out)
        a = row[left]
        out[left] = (layer[a >> 3] >> (a & 7).astype(np.uint8)) & 1 == 1
    return out


def candidates(w: Words, once: np.ndarray, twice: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes (2 x windows) of the windows that hold a block which meets the index elsewhere."""
    at, h = w.windows(block)
    own = _aligned(w, at, block)
    places = _addresses(h, 8 * len(once))
    hit = _set(once, places)
    mine = np.flatnonzero(own & hit)
    hit[mine] = _set(twice, places[:, mine])
    near = np.zeros(w.lanes.shape[1] + 1, dtype=np.int64)
    np.add.at(near, at[hit] + 1, 1)
    near = np.cumsum(near)  # hits before each word
    start, *windows = w.windows(window, lanes=2)
    last = np.minimum(start + window - block + 1, len(near) - 1)
    take = near[last] > near[start]
    return start[take], np.stack([x[take] for x in windows])


def _text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _by_text(texts: np.ndarray, which: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
    """A row for each text (2 x 64 bits): the words, ascending and once each, where confirmed windows start."""
    p, q = texts[which, 0], texts[which, 1]
    order = np.lexsort((word, q, p))
    p, q, word = p[order], q[order], word[order]
    other = np.ones(len(word), dtype=bool)
    other[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    new = other.copy()
    new[1:] |= word[1:] != word[:-1]
    p, q, word, begins = p[new], q[new], word[new].astype(_U32), np.flatnonzero(other[new])
    raw, packed, ends = np.stack([p[begins], q[begins]], axis=1).tobytes(), word.tobytes(), np.append(begins[1:], len(word))
    return pa.RecordBatch.from_pydict({"k": pa.array([raw[a : a + 16] for a in range(0, len(raw), 16)], pa.binary()), "starts": pa.array([packed[4 * a : 4 * z] for a, z in zip(begins.tolist(), ends.tolist(), strict=False)], pa.binary())})


def _probe(once, twice, window, block, buckets):
    """Rows for pass 2: kind 0 has places that the piece itself settles, kind 1 has places and window hashes of a bucket. Places are text, word."""

    def row(kind, bucket, keys, doc, word, cells=b""):
        order = np.argsort(doc, kind="stable")
        own, which = np.unique(doc[order], return_inverse=True)
        return {"kind": kind, "bucket": bucket, "texts": keys[own].tobytes(), "places": which.astype(_U32).tobytes() + word[order].astype(_U32).tobytes(), "cells": cells if isinstance(cells, bytes) else np.ascontiguousarray(cells[0][:, order]).tobytes() + cells[1][order].astype(np.uint8).tobytes()}

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column("t")):
                keys = np.frombuffer(b"".join(b.column("k").slice(lo, hi - lo).to_pylist()), dtype=U64).reshape(-1, 2)
                w = Words(data, offsets)
                at, h = candidates(w, once, twice, window, block)
                doc = w.text_of(at)
                word = at - w.first[doc]
                order = np.lexsort((h[1], h[0]))
                h, doc, word = h[:, order], doc[order], word[order]
                first = np.ones(len(at), dtype=bool)
                first[1:] = (h[:, 1:] != h[:, :-1]).any(axis=0)
                begins = np.flatnonzero(first)
                n = np.diff(np.append(begins, len(at)))
                settled = np.repeat(n > 1, n)
                out = [row(0, 0, keys, doc[settled], word[settled])] if settled.any() else []
                # one entry a distinct window; n > 1: nothing to send back
                h, doc, word, more = h[:, begins], doc[begins], word[begins], n > 1
                to = ((h[0] >> U64(40)) % U64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[p] : cuts[p + 1]]
                    out.append(row(1, int(p), keys, doc[own], word[own], (h[:, own], more[own])))
                yield pa.RecordBatch.from_pylist(out, schema=_PROBED)

    return run


_PROBED = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("texts", pa.binary()), ("places", pa.binary()), ("cells", pa.binary())])


def _unpack(texts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(places) // 8
    return np.frombuffer(texts, U64).reshape(-1, 2), np.frombuffer(places, _U32, n), np.frombuffer(places, _U32, n, 4 * n)


def _settled(batches):
    for b in batches:
        for texts, places in zip(b.column("texts").to_pylist(), b.column("places").to_pylist(), strict=True):
            yield _by_text(*_unpack(texts, places))


def _confirm(table: pa.Table) -> pa.Table:
    """The places of a bucket whose window has an equal."""
    texts, which, words, hashes, more, base = [], [], [], [], [], 0
    for row in zip(table["texts"].to_pylist(), table["places"].to_pylist(), table["cells"].to_pylist(), strict=True):
        t, k, w = _unpack(*row[:2])
        texts.append(t)
        which.append(k.astype(np.int64) + base)
        words.append(w)
        hashes.append(np.frombuffer(row[2], U64, 2 * len(k)).reshape(2, -1))
        more.append(np.frombuffer(row[2], np.uint8, len(k), 16 * len(k)).astype(bool))
        base += len(t)
    h = np.concatenate(hashes, axis=1)
    order = np.lexsort((h[1], h[0]))
    h = h[:, order]
    equal = (h[:, 1:] == h[:, :-1]).all(axis=0)
    back = order[(np.append(equal, False) | np.append(False, equal)) & ~np.concatenate(more)[order]]
    return pa.Table.from_batches([_by_text(np.concatenate(texts), np.concatenate(which)[back], np.concatenate(words)[back])])


def _covered(starts: list[bytes], n: int, window: int) -> np.ndarray:
    """Which of a text's n words lie in windows that start at these."""
    change = np.zeros(n + 1, dtype=np.int64)
    at = np.unique(np.concatenate([np.frombuffer(s, _U32) for s in starts])).astype(np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + window, n), -1)
    return np.cumsum(change)[:n] > 0


def repeated(df: DataFrame, text: str = "text", window: int = WINDOW, bits: int = FILTER_BITS) -> DataFrame:
    """k (128 bits of the text) and starts (words where repeated windows start, packed in 32 bits each), for texts that have some; several rows a text."""
    ship(df.sparkSession)
    block = (window + 1) // 2
    src = df.filter(F.col(text).isNotNull()).select(_text_key(F.col(text)).alias("k"), F.col(text).alias("t"))
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    ranges = min(max(RANGES, 1 << (size // RANGE_BYTES).bit_length()), MOST_RANGES, bits // 8)
    once, twice = build_filter(src, block, bits, ranges)
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    shared = df.sparkSession.sparkContext.broadcast((once, twice))  # of fixed size

    def probe(batches):
        yield from _probe(*shared.value, window, block, buckets)(batches)

    found = materialise(src.mapInArrow(probe, "kind tinyint, bucket int, texts binary, places binary, cells binary"), "substring-probe")
    at_once = found.filter("kind = 0").mapInArrow(_settled, "k binary, starts binary").distinct()  # copies of a text settle alike in most pieces
    met = found.filter("kind = 1").groupBy("bucket").applyInArrow(_confirm, "k binary, starts binary")
    out = materialise(at_once.unionByName(met), "substring-places")
    discard(found)
    shared.unpersist()
    return out


def substring_dedup(df: DataFrame, text: str = "text", window: int = WINDOW, bits: int = FILTER_BITS, digests: bool = False) -> DataFrame:
    """df with n_words and n_removed, and its text left with the words that remain, joined by single spaces (unchanged if none goes).

    With digests, kept_sha256 of the remaining words joined by single spaces stands in the text's place.
    """
    places = repeated(df, text, window, bits)
    gone = materialise(places.groupBy("k").agg(F.collect_list("starts").alias("starts")), "substring-texts")
    discard(places)
    result = ["n_words", "n_removed", "kept_sha256" if digests else text]
    carried = [c for c in df.columns if c != text and c.lower() not in result]
    base = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)], F.col(f"`{text}`").alias("t"))
    key, has = _text_key(F.col("t")), member_filter(gone.select(F.xxhash64("k")))
    touched = base.filter(has(F.xxhash64(key))).withColumn("k", key).join(gone, "k", "left").drop("k")
    calm = base.filter(~has(F.xxhash64(key)))
    ddl = ", ".join([f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(carried)] + ["n_words bigint, n_removed bigint, kept string"])

    def run(batches):
        for b in batches:
            starts = b.column("starts").to_pylist() if "starts" in b.schema.names else [None] * b.num_rows
            for lo, hi, data, offsets in pieces(b.column("t")):
                raw = data.tobytes()
                w = Words(data, offsets, hashed=False)
                counts, removed, kept = w.counts(), np.zeros(hi - lo, dtype=np.int64), []
                nulls = b.column("t").slice(lo, hi - lo).is_null().to_pylist()
                for d in range(hi - lo):
                    a, z = w.first[d], w.first[d + 1]
                    gone_words = _covered(starts[lo + d], counts[d], window) if starts[lo + d] else None
                    if gone_words is None and not digests:
                        kept.append(None if nulls[d] else raw[offsets[d] : offsets[d + 1]].decode())
                        continue
                    if gone_words is None:
                        left = raw[offsets[d] : offsets[d + 1]].split()  # bytes: the same six characters
                    else:
                        left = [raw[s:e] for s, e in zip(w.starts[a:z][~gone_words].tolist(), w.ends[a:z][~gone_words].tolist(), strict=True)]
                        removed[d] = counts[d] - len(left)
                    joined_words = b" ".join(left)
                    kept.append(hashlib.sha256(joined_words).hexdigest() if digests else joined_words.decode())
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(len(carried))), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*[f"c{k}" for k in range(len(carried))], "n_words", "n_removed", "kept"])

    out = calm.mapInArrow(run, ddl).unionByName(touched.mapInArrow(run, ddl))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carried)], "n_words", "n_removed", F.col("kept").alias(result[2]))
