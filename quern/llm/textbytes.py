"""Words and windows of words of many texts at once, straight from Arrow's UTF-8 buffers with numpy.

A word's hash takes its bytes eight at a time, all words in step; words of more than LONGEST bytes are hashed by BLAKE2b.
Windows join the hashes of their words pairwise, in runs of 1, 2, 4, 8, ... words. Each step multiplies and folds and none
is linear, so words and windows that are built from few letters by a rule don't cancel out, as they do in sums of powers.
There are two halves, made apart: 64 bits where a false hit costs little, 128 where equality must hold: among 10**13
windows (100 TB) a false pair is then to be expected once in 10**12 corpora. No Python loop runs over words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at a time (one text at least), which bounds memory.
PIECE_BYTES = 2 << 20
#: Windows that are joined at a time.
STEP = 1 << 16
#: Bytes of a word that are hashed in steps.
LONGEST = 64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def joined(x: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k neighbours along the last axis of 64-bit numbers."""
    m = x.shape[-1] - k + 1
    run, size, out, done = x, 1, None, 0
    while True:
        if k & size:
            part = run[..., done : done + m]
            out, done = part if out is None else _pair(out, part), done + size
        if 2 * size > k:
            return mix(out ^ U64(k))
        run, size = _pair(run[..., :-size], run[..., size:]), 2 * size


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * U64(0x9E3779B97F4A7C15)
    z += y
    z ^= z >> U64(32)
    z *= U64(0xD6E8FEB86659FD93)
    z ^= z >> U64(29)
    return z


#: By the number of bytes that count, which of eight do.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """2 x words: 128 bits of each word."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    out = np.stack([mix(sizes.astype(U64) + U64(0x243F6A8885A308D3)), mix(sizes.astype(U64) + U64(0x13198A2E03707344))])
    for at in range(0, LONGEST, 8):
        some = np.flatnonzero((sizes > at) & (sizes <= LONGEST)) if at else np.flatnonzero(sizes <= LONGEST)
        if not len(some):
            break
        part = eight[starts[some] + at] & _FIRST[np.minimum(sizes[some] - at, 8)]
        out[0, some] = _pair(out[0, some], part)
        out[1, some] = _pair(part, out[1, some])
    for k in np.flatnonzero(sizes > LONGEST).tolist():
        out[:, k] = np.frombuffer(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=16).digest(), dtype=U64)
    return np.stack([mix(x) for x in out])


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column, size: int = PIECE_BYTES):
    """(first row, end row, bytes, offsets) for runs of rows with up to so many bytes, or one longer text."""
    data, offsets = texts(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of some texts. starts, ends: their bytes; first: n + 1 offsets of each text's words; lanes: the two halves of their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, hashed: bool = True):
        n = len(data)
        solid = ~_SPACE[data]
        begins = np.zeros(n, dtype=bool)  # texts begin here
        begins[offsets[:-1][offsets[:-1] < n]] = True
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1] | begins[1:]
        closes[:-1] &= ~solid[1:] | begins[1:]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.lanes = _hash_words(_FOLD[data] if fold else data, self.starts, self.ends) if hashed else None

    @property
    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        return self.lanes[0]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, short: bool = False, lanes: int = 1) -> tuple[np.ndarray, ...]:
        """First word and hash (one for each lane) of each window of k words inside one text; with short, a shorter text's words are one window."""
        n, counts = self.lanes.shape[1], self.counts()
        left = np.repeat(self.first[1:], counts) - np.arange(n)  # words from here to the text's end
        at = np.flatnonzero(left >= k)
        out = []
        for lane in self.lanes[:lanes]:
            spans = np.empty(max(n - k + 1, 0), dtype=U64)
            for lo in range(0, len(spans), STEP):
                spans[lo : lo + STEP] = joined(lane[lo : lo + STEP + k - 1], k)
            out.append(spans[at])
        if short and (few := (counts > 0) & (counts < k)).any():
            heads, sizes = self.first[:-1][few], counts[few]
            own = [np.empty(len(heads), dtype=U64) for _ in out]
            for m in range(1, k):
                some = np.flatnonzero(sizes == m)
                for lane, x in zip(self.lanes, own, strict=False):
                    x[some] = joined(lane[heads[some][:, None] + np.arange(m)], m)[:, 0] if len(some) else x[some]
            at = np.append(at, heads)
            order = np.argsort(at, kind="stable")
            at, out = at[order], [np.append(x, y)[order] for x, y in zip(out, own, strict=True)]
        return (at, *out)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The texts that these words are in."""
        return np.searchsorted(self.first, at, side="right") - 1
