"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel and stitched where their boundaries meet.

Texts of one chunk are encoded where they lie. A longer text becomes chunks, each reaching `overlap` characters into the
next; they are written once, in small row groups, so one giant text is read by many tasks. Each chunk is split by the
pattern from its own start. Two neighbours agree from the first boundary that both have inside their overlap, since a match
depends only on where it starts and what follows; boundaries near a chunk's end, where what follows is cut off, don't count.
Only these boundary lists meet per text; then each chunk encodes the piece between its two meeting points. Neighbours that
never meet (a run without boundaries longer than the overlap) are put together and encoded as one piece, no others with
them. The pieces of a text pass one task in order, which keeps running digests and never holds a whole text, unless its ids
are asked for. Where only counts are wanted, pieces give numbers alone.

Pre-tokens are encoded by rank merges of the tokenizer library and remembered; decoding concatenates the ids' raw bytes.

Cases: a null text is an empty one; an empty one has no ids. Rows need no key and may repeat: each is carried by a number
of its own. Other columns are carried along, those that clash with the results replaced. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

#: Characters of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 32_768, 1_024
#: Distinct pre-tokens that a worker remembers before it begins anew, and the longest that it remembers.
REMEMBERED, LONGEST = 200_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes with one rank file and one pattern; built once a worker."""

    _built: dict = {}

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.matches = regex.compile(pattern).finditer
        self.raw = {v: k for k, v in ranks.items()}
        self._single = tiktoken.Encoding("quern", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._ids: dict[str, tuple] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._built:
            cls._built[path, pattern] = cls(path, pattern)
        return cls._built[path, pattern]

    def _new(self, token: str) -> tuple[str, int, bytes]:
        """(ids joined by spaces, their number, their bytes decoded) of a pre-token."""
        ids = self._single(token.encode())
        out = " ".join(map(str, ids)), len(ids), b"".join(self.raw[i] for i in ids)
        if len(token) <= LONGEST:
            if len(self._ids) >= REMEMBERED:
                self._ids.clear()
            self._ids[token] = out
        return out

    def encode(self, tokens: list[str]) -> list[tuple[str, int, bytes]]:
        known = self._ids.get
        return [known(t) or self._new(t) for t in tokens]

    def count(self, text: str) -> int:
        return sum(x[1] for x in self.encode(self.split(text)))

    def boundaries(self, text: str, begin: int = 0) -> list[int]:
        """Where pre-tokens start, from begin on, and the end."""
        return [m.start() for m in self.matches(text, begin)] + [len(text)]


def chunks_of(text: str, chunk: int, overlap: int) -> Iterator[str]:
    for at in range(0, max(len(text), 1), chunk):
        yield text[at : at + chunk + overlap]
        if at + chunk >= len(text):
            break


def meeting(earlier: list[int], later: list[int], chunk: int, overlap: int) -> int | None:
    """The first boundary, counted from the later chunk's start, that both chunks have inside their overlap."""
    sure = {b - chunk for b in earlier if chunk <= b}
    return next((b for b in later if b in sure and b < overlap), None)


def _tail(bounds: list[int], chunk: int, length: int) -> list[int]:
    """The boundaries past the chunk's own part that don't depend on what follows the text: all but the last match's, and the cut itself."""
    return [b for b in bounds[:-2] if chunk <= b < length]


def stitch(heads: list[list[int]], tails: list[list[int]], chunk: int, overlap: int) -> list[tuple[int | None, int | None]]:
    """Each chunk's piece (start, end) from its own start; an end of -1 is the text's. None: it goes on from, or into, a neighbour that it never meets."""
    meets = [meeting(tails[k], heads[k + 1], chunk, overlap) for k in range(len(heads) - 1)]
    return list(zip([0, *meets], [*(None if m is None else chunk + m for m in meets), -1], strict=True))


def pre_tokens(codec: Codec, text: str, start: int, end: int) -> list[str]:
    """The pre-tokens of text[start:end], split with what follows still in view."""
    out = []
    for m in codec.matches(text, start):
        if end >= 0 and m.start() >= end:
            break
        out.append(m.group())
    return out


def _digest(parts: list[tuple[str, int, bytes]]) -> dict:
    return {"n_tokens": sum(p[1] for p in parts), "ids": " ".join(p[0] for p in parts), "decoded": b"".join(p[2] for p in parts)}


def _row(out: dict, keep_ids: bool) -> tuple:
    ids = hashlib.sha256(out["ids"].encode()).hexdigest(), hashlib.sha256(out["decoded"]).hexdigest()
    return out["n_tokens"], *ids, *((list(map(int, out["ids"].split())),) if keep_ids else ())


_TYPES = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = False, count_only: bool = False) -> DataFrame:
    """df without its text, with n_tokens and, unless only counts are wanted, ids_sha256, decoded_sha256 and, if asked for, ids of every text."""
    ship(df.sparkSession)
    names = [n for n, _ in _TYPES][: 1 if count_only else 3 + keep_ids]
    carried = [c for c in df.columns if c != text and c.lower() not in names]
    src = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = ", ".join(f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(carried))
    result = ", ".join(f"{n} {t}" for n, t in zip(names, ("bigint", "string", "string", "array<int>"), strict=False))
    long = F.length("text") > chunk

    def whole(batches):
        codec = Codec.of(path, pattern)
        for b in batches:
            rows = [(codec.count(t),) if count_only else _row(_digest(codec.encode(codec.split(t))), keep_ids) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, (_, t) in zip(cols, _TYPES, strict=False))], names=[*b.schema.names[:-1], *names])

    def cut(batches):
        schema = pa.schema([("doc", pa.int64()), ("no", pa.int32()), ("part", pa.string())])
        for b in batches:
            for k in range(b.num_rows):  # a text at a time
                parts = list(chunks_of(b.column("text")[k].as_py(), chunk, overlap))
                first = [pa.concat_arrays([c.slice(k, 1), pa.nulls(len(parts) - 1, c.type)]) for c in b.columns[: len(carried)]]  # other columns stand with chunk 0
                yield pa.RecordBatch.from_arrays([*first, pa.array([b.column("doc")[k].as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=[*(f"c{n}" for n in range(len(carried))), *schema.names])

    def split(batches):
        codec = Codec.of(path, pattern)
        for b in batches:
            heads, tails = [], []
            for t in b.column("part").to_pylist():
                bounds = codec.boundaries(t)
                heads.append(bounds[: bisect_left(bounds, overlap)])
                tails.append(_tail(bounds, chunk, len(t)))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("no"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["doc", "no", "head", "tail"])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        at = stitch(table["head"].to_pylist(), table["tail"].to_pylist(), chunk, overlap)
        lead = list(accumulate((k if a is not None else -1 for k, (a, _) in enumerate(at)), max))
        return pa.table({"doc": table["doc"], "no": table["no"], "lead": pa.array(lead, pa.int32()), "start": pa.array([a for a, _ in at], pa.int32()), "stop": pa.array([z for _, z in at], pa.int32())})

    def pieces(found: list[tuple[int, int, dict]]) -> pa.RecordBatch:
        columns = {"doc": pa.array([d for d, _, _ in found], pa.int64()), "no": pa.array([n for _, n, _ in found], pa.int32()), "n_tokens": pa.array([r["n_tokens"] for _, _, r in found], pa.int64())}
        if not count_only:
            columns |= {"ids": pa.array([r["ids"] for _, _, r in found], pa.string()), "decoded": pa.array([r["decoded"] for _, _, r in found], pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    def digest(codec: Codec, tokens: list[str]) -> dict:
        parts = codec.encode(tokens)
        return {"n_tokens": sum(p[1] for p in parts)} if count_only else _digest(parts)

    def piece(batches):
        codec = Codec.of(path, pattern)
        for b in batches:
            yield pieces([(r["doc"], r["no"], digest(codec, pre_tokens(codec, r["part"], r["start"], r["stop"]))) for r in b.to_pylist()])

    def merged(batches):
        """Chunks that don't meet, in order: each run of them is one piece."""
        codec, texts, start = Codec.of(path, pattern), [], 0
        for b in batches:
            for r in b.to_pylist():
                if r["start"] is not None:
                    texts, start = [], r["start"]
                if r["stop"] is None:
                    texts.append(r["part"][:chunk])
                    continue
                stop = r["stop"] if r["stop"] < 0 else chunk * len(texts) + r["stop"]
                yield pieces([(r["doc"], r["lead"], digest(codec, pre_tokens(codec, "".join([*texts, r["part"]]), start, stop)))])

    def join(batches):
        """Pieces in order become a row for each text."""
        doc, out = None, []

        def begin():
            return {"n_tokens": 0, "ids": hashlib.sha256(), "decoded": hashlib.sha256(), "list": []}

        def end(state):
            return (doc, state["n_tokens"], state["ids"].hexdigest(), state["decoded"].hexdigest(), state["list"])

        state = begin()
        for b in batches:
            for r in b.to_pylist():
                if r["doc"] != doc:
                    out += [end(state)] if doc is not None else []
                    doc, state = r["doc"], begin()
                if r["ids"]:
                    state["ids"].update((" " if state["n_tokens"] else "").encode() + r["ids"].encode())
                    state["list"] += map(int, r["ids"].split()) if keep_ids else ()
                state["n_tokens"] += r["n_tokens"]
                state["decoded"].update(r["decoded"])
            if out:
                yield _rows(out)
                out = []
        if doc is not None:
            yield _rows([end(state)])

    def _rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(columns[1 : 1 + len(names)], _TYPES, strict=False))], names=["doc", *names])

    short = src.filter(~long).mapInArrow(whole, ", ".join(x for x in (base, result) if x))
    cuts = src.filter(long).withColumn("doc", F.monotonically_increasing_id())
    cuts = cuts.select(*[f"c{k}" for k in range(len(carried))], "doc", "text").mapInArrow(cut, ", ".join(x for x in (base, "doc bigint, no int, part string") if x))
    parts = materialise(cuts, "bpe-parts", row_group=1 << 20)
    places = parts.select("doc", "no", "part").mapInArrow(split, "doc bigint, no int, head array<int>, tail array<int>").groupBy("doc").applyInArrow(meet, "doc bigint, no int, lead int, start int, stop int")
    places = materialise(places, "bpe-pieces")
    kind = "doc bigint, no int, n_tokens bigint" + ("" if count_only else ", ids string, decoded binary")
    alone = F.col("start").isNotNull() & F.col("stop").isNotNull()
    got = parts.select("doc", "no", "part").join(places.filter(alone), ["doc", "no"]).mapInArrow(piece, kind)
    if not (unmet := places.filter(~alone)).isEmpty():
        runs = parts.select("doc", "no", "part").join(unmet, ["doc", "no"]).repartition("doc", "lead").sortWithinPartitions("doc", "lead", "no")
        got = got.unionByName(runs.mapInArrow(merged, kind))
    if count_only:
        got = got.groupBy("doc").agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        got = got.repartition("doc").sortWithinPartitions("doc", "no").mapInArrow(join, f"doc bigint, {result}")
    stitched = parts.filter("no = 0").select("doc", *[f"c{k}" for k in range(len(carried))]).join(got, "doc").drop("doc")
    out = short.unionByName(stitched)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carried)], *names)


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the bytes of each array of ids; null for null."""
    ship(df.sparkSession)
    schema = df.drop(to).withColumn(to, F.lit(None).cast("binary")).schema

    def run(batches):
        raw = {v: k for k, v in read_ranks(path).items()}
        for b in batches:
            if to in b.schema.names:
                b = b.drop_columns([to])
            joined = [None if x is None else b"".join(raw[i] for i in x) for x in b.column(ids).to_pylist()]
            yield b.append_column(to, pa.array(joined, pa.binary()))

    return df.mapInArrow(run, schema)
