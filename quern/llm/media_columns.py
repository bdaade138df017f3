"""Media columns: telephony audio stored as bytes in a table, read back, expanded, resampled and stored as PCM.

A payload is stored losslessly in a WAV container as 8-bit mu-law, 8-bit A-law or IMA ADPCM blocks. Reading it back,
mu-law and A-law are expanded by lookup tables; ADPCM blocks, each of which starts from its own header, are decoded
together: numpy walks the samples of a block in step for all blocks at once. The PCM is resampled to twice its rate and
stored as 16-bit samples; features are computed from the PCM that is read back. PCM takes several times its media's space, so
where only what is told of them is wanted, texts are taken in PARTS parts by hash: each part's media and PCM are stored,
read back and deleted before the next's, which reads the texts PARTS times and needs that part of the space.

Rows are taken from Arrow buffers, up to PIECE_BYTES of payload at a time (one longer text at least), which bounds all
arrays. Cases: null texts are empty and become one padded unit, like empty ones; equal texts give equal media; texts of any
length are stored whole. Other columns are carried along unless they clash with a result. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, own_name, shielded, ship
from .textbytes import PIECE_BYTES, pieces

UNIT = 192  # bytes of an ADPCM block, and of padding for all formats
RATE = 8000
#: Parts of the texts whose media and PCM lie on disk one after another.
PARTS = 4
MULAW, ALAW, ADPCM = "mulaw", "alaw", "ima_adpcm"
TAGS = {MULAW: 7, ALAW: 6, ADPCM: 17}  # of WAV's format chunk
FORMATS = tuple(TAGS)


def _tables() -> dict[str, np.ndarray]:
    """Byte to 16-bit sample by the rules of G.711."""
    b = np.arange(256)
    u = ~b & 255
    mag = ((((u & 15) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    a = b ^ 0x55
    e, m = (a >> 4) & 7, a & 15
    lin = np.where(e == 0, (m << 4) + 8, ((m << 4) + 0x108) << np.maximum(e - 1, 0))
    return {MULAW: np.where(u & 128, -mag, mag).astype(np.int16), ALAW: np.where(a & 128, lin, -lin).astype(np.int16)}


EXPAND = _tables()

# The step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x (2 * (size - 4) + 1)) of mono IMA ADPCM blocks (blocks x size bytes). A step index over 88 counts as 88."""
    value = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    body = blocks[:, 4:]
    out = np.empty((len(blocks), 2 * body.shape[1] + 1), dtype=np.int16)
    out[:, 0] = value
    columns = np.ascontiguousarray(body.T)
    for k in range(2 * body.shape[1]):  # along a block; across all blocks at once
        code = (columns[k // 2] >> (4 * (k % 2))) & 15
        step = STEPS[index]
        diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + INDEX[code], 0, 88)
        out[:, k + 1] = value
    return out


def encode_adpcm(samples: np.ndarray, size: int = UNIT) -> np.ndarray:
    """Blocks of IMA ADPCM that decode_adpcm() reads; samples are padded with their last to whole blocks."""
    per = 2 * (size - 4) + 1
    padded = np.pad(samples.astype(np.int32), (0, -len(samples) % per), mode="edge").reshape(-1, per)
    out = np.zeros((len(padded), size), dtype=np.uint8)
    value = padded[:, 0].copy()
    # a block starts from the step that fits its first move
    index = np.minimum(np.searchsorted(STEPS, np.abs(padded[:, 1] - value)), 88).astype(np.int32)
    out[:, 0], out[:, 1], out[:, 2] = value & 255, (value >> 8) & 255, index
    for k in range(per - 1):
        step = STEPS[index]
        gap = padded[:, k + 1] - value
        code, left = np.where(gap < 0, 8, 0), np.abs(gap)
        diff = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = left >= part
            code, left, diff = code | np.where(hit, bit, 0), left - np.where(hit, part, 0), diff + np.where(hit, part, 0)
        value = np.clip(value + np.where(code & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + INDEX[code], 0, 88)
        out[:, 4 + k // 2] |= (code << (4 * (k % 2))).astype(np.uint8)
    return out


def wav(payload: bytes, kind: str, rate: int = RATE) -> bytes:
    """A mono WAV file that holds the payload as it is."""
    extra = struct.pack("<HH", 2, 2 * (UNIT - 4) + 1) if kind == ADPCM else struct.pack("<H", 0)
    align, bits = (UNIT, 4) if kind == ADPCM else (1, 8)
    per_second = rate * UNIT // (2 * (UNIT - 4) + 1) if kind == ADPCM else rate
    fmt = struct.pack("<HHIIHH", TAGS[kind], 1, rate, per_second, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media) -> tuple[str, int, memoryview]:
    """Format, rate and payload of such a file (bytes or a buffer)."""
    view, at, kind, rate = memoryview(media), 12, "", 0
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(view):
        name, size = view[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            kind = {v: k for k, v in TAGS.items()}[tag]
        elif name == b"data":
            return kind, rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the WAV file")


def resample_2x(pcm: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Several signals (offsets as in textbytes) at twice their rate: samples stay, points between them are cubic; edges repeat."""
    n = len(pcm)
    x = pcm.astype(np.int32)
    out = np.empty(2 * n, dtype=np.int16)
    out[::2] = pcm
    at = np.arange(n)
    which = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    lo, hi = offsets[:-1][which], offsets[1:][which] - 1
    far = x[np.maximum(at - 1, lo)] + x[np.minimum(at + 2, hi)]
    near = x + x[np.minimum(at + 1, hi)]
    out[1::2] = np.clip((9 * near - far + 8) >> 4, -32768, 32767)
    return out


def expand(payload: np.ndarray, kind: str) -> np.ndarray:
    return decode_adpcm(payload.reshape(-1, UNIT)).reshape(-1) if kind == ADPCM else EXPAND[kind][payload]


def _ddl(df: DataFrame, *drop: str) -> tuple[list[str], str]:
    ship(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in drop]
    return kept, "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)


def to_media(df: DataFrame, text: str = "text", kind: str | None = None) -> DataFrame:
    """df without its text, with n_bytes and media. kind None: a format for each text, by its checksum, so all are used."""
    kept, ddl = _ddl(df, text.lower(), "n_bytes", "media")
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(own_name(df, "text")))

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column(b.num_columns - 1)):
                raw = data.tobytes()
                media = []
                for a, z in zip(offsets[:-1], offsets[1:], strict=True):
                    t = raw[a:z]
                    media.append(wav(t + b" " * (-len(t) % UNIT or (0 if t else UNIT)), kind or FORMATS[zlib.crc32(t) % len(FORMATS)]))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], names=[*b.schema.names[:-1], "n_bytes", "media"])

    return src.mapInArrow(run, ddl + "n_bytes bigint, media binary")


def _groups(media: pa.Array):
    """(first row, files, what unwav() finds in them) for runs of rows with up to PIECE_BYTES, without copying them."""
    lo, files, size = 0, [], 0
    for k in range(len(media)):
        files.append(memoryview(media[k].as_buffer()))
        size += len(files[-1])
        if size >= PIECE_BYTES or k + 1 == len(media):
            yield lo, files, [unwav(f) for f in files]
            lo, files, size = k + 1, [], 0


def _signals(rows) -> list[tuple[np.ndarray, int]]:
    """The resampled PCM and its rate of each row; rows of a format go together."""
    out: list = [None] * len(rows)
    for kind in FORMATS:
        own = [k for k, r in enumerate(rows) if r[0] == kind]
        if own:
            payload = np.frombuffer(b"".join(rows[k][2] for k in own), dtype=np.uint8)
            per = (2 * (UNIT - 4) + 1) / UNIT if kind == ADPCM else 1
            offsets = np.concatenate([[0], np.cumsum([round(len(rows[k][2]) * per) for k in own])])
            pcm = resample_2x(expand(payload, kind), offsets)
            for k, a, z in zip(own, offsets[:-1], offsets[1:], strict=True):
                out[k] = pcm[2 * a : 2 * z], 2 * rows[k][1]
    return out


def to_pcm(df: DataFrame, media: str = "media", digests: bool = False) -> DataFrame:
    """df with pcm (16-bit little-endian samples) and pcm_rate in place of media; with digests, also what is told of the stored bytes."""
    names = [*(_DIGESTS if digests else ()), "pcm", "pcm_rate"]
    kept, ddl = _ddl(df, media.lower(), *names)
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{media}`").alias(own_name(df, "media")))

    def run(batches):
        for b in batches:
            for lo, files, rows in _groups(b.column(b.num_columns - 1)):
                got = _signals(rows)
                told = [_told(f, kind, payload) for f, (kind, _, payload) in zip(files, rows, strict=True)] if digests else []
                more = [pa.array(c, t) for c, t in zip(zip(*told, strict=True), _DIGESTS.values(), strict=True)] if told else []
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(rows)) for c in b.columns[:-1]), *more, pa.array([p.astype("<i2").tobytes() for p, _ in got], pa.binary()), pa.array([r for _, r in got], pa.int32())], names=[*b.schema.names[:-1], *names])

    return src.mapInArrow(run, ddl + ("codec string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, " if digests else "") + "pcm binary, pcm_rate int")


_DIGESTS = {"codec": pa.string(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}


def _told(media: memoryview, kind: str, payload: memoryview) -> tuple:
    return kind, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()


def _feature(kind: str, rate: int, pcm: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    rms = int(np.sqrt(np.dot(x, x) / max(len(x), 1)))
    return f"{kind}:{rate}:samples={len(x)}:peak={int(np.abs(x).max(initial=0))}:rms={rms}:crossings={crossings}:pcm={zlib.crc32(pcm.tobytes()):08x}"


def features(df: DataFrame) -> DataFrame:
    """df, as to_pcm() gives it with digests, with a feature string of each signal in place of codec, pcm and pcm_rate."""
    kept, ddl = _ddl(df, "codec", "pcm", "pcm_rate", "feature")

    def run(batches):
        for b in batches:
            pcm, rate, codec = b.column("pcm"), b.column("pcm_rate").to_pylist(), b.column("codec").to_pylist()
            found = [_feature(codec[k], rate[k], np.frombuffer(pcm[k].as_buffer(), dtype="<i2")) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.string())], names=[*kept, "feature"])

    return df.mapInArrow(run, ddl + "feature string")


def describe(df: DataFrame, media: str = "media") -> DataFrame:
    """df without media, with digests of what is stored and read back, and a feature string of the resampled signal, which is stored and read back, too."""
    df, restored = shielded(df, "codec", "pcm", "pcm_rate")
    return restored(features(materialise(to_pcm(df, media, digests=True), "pcm")))


def told(df: DataFrame, text: str = "text", kind: str | None = None, parts: int = PARTS) -> DataFrame:
    """What to_media() and describe() tell of every text, with media and PCM of one part of the texts stored at a time."""
    out = []
    for part in range(parts):
        media = materialise(to_media(df.filter(F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(parts)) == part), text, kind), "media")
        own, restored = shielded(media, "codec", "pcm", "pcm_rate")
        pcm = materialise(to_pcm(own, digests=True), "pcm")
        discard(media)
        out.append(restored(materialise(features(pcm), "features")))
        discard(pcm)
    return reduce(lambda a, b: a.unionByName(b), out)
