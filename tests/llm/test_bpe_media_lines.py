import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import byte_bpe, line_dedup, media_columns, token_counts
from quern.llm.queries import byte_bpe as contract
from tests.llm.docs import SCHEMA, frame, rows


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path, pattern = contract()
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def awkward(seed=1):
    rng = random.Random(seed)
    parts = ["word", " ", "  ", "\n", "\n\n\n", "\t ", "'s", "'ll", "12", "345678", "!?", "é", "日本語", "🙂", "a" * 70, " ", "　 ", " x", "…", "\x00", "<|endoftext|>"]
    return ["".join(rng.choices(parts, k=rng.randint(20, 900))) for _ in range(40)] + ["a" * 5000, " " * 3000 + "b", "\n" * 999, "ab " * 2000, "12" * 900 + " end"]


@pytest.mark.parametrize("chunk, overlap", [(32768, 1024), (200, 60), (64, 16)])
def test_encoding_equals_the_library_whatever_the_chunks(spark, tokenizer, chunk, overlap):
    data = rows() + [(2000 + k, t, "en", "s", 1, 1, "h") for k, t in enumerate(awkward())]
    got = byte_bpe.encode(frame(spark, data), *contract(), chunk=chunk, overlap=overlap, keep_ids=True)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "copies", "hash", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    want = Counter()
    for x in data:
        ids = tokenizer.encode_ordinary(x[1] or "")
        want[x[0], len(ids), sha(" ".join(map(str, ids))), sha((x[1] or "").encode()), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got.collect()) == want


def test_chunks_meet_where_boundaries_agree():
    codec = byte_bpe.Codec.of(*contract())
    text = " ".join(f"word{k}" for k in range(300))
    parts = list(byte_bpe.chunks_of(text, 200, 40))
    bounds = [codec.boundaries(p) for p in parts]
    spans = byte_bpe.stitch([[b for b in x if b < 40] for x in bounds], [byte_bpe._tail(x, 200, len(p)) for x, p in zip(bounds, parts, strict=True)], 200, 40)
    assert [t for p, (a, z) in zip(parts, spans, strict=True) for t in byte_bpe.pre_tokens(codec, p, a, z)] == codec.split(text)


def test_decoding_joins_bytes(spark):
    path, pattern = contract()
    ids = byte_bpe.encode(frame(spark), path, pattern, keep_ids=True)
    got = byte_bpe.decode(ids, path).select("doc_id", "decoded").collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in got) == Counter((x[0], (x[1] or "").encode()) for x in rows())
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), path).first().decoded is None


def test_counts_histogram_and_sums(spark, tokenizer, monkeypatch):
    data = rows() + [(3000, "x " * 40000, "en", "s", 1, 1, "h")]
    lengths = sorted(len(tokenizer.encode_ordinary(x[1] or "")) for x in data)
    hist = token_counts.histogram(frame(spark, data), *contract()).cache()
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == Counter(lengths)
    for r in token_counts.suffix_sums(hist, block=8).collect():
        above = [n for n in lengths if n >= r.n_tokens]
        assert (r.docs_at_least, r.tokens_at_least) == (len(above), sum(above))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
        assert r.quantile == pytest.approx(sum(n <= r.n_tokens for n in lengths) / len(lengths))
    got = {r.limit: r.total_tokens for r in token_counts.truncated_totals(hist, (0, 7, 64, 10**6)).collect()}
    assert got == {c: sum(min(n, c) for n in lengths) for c in (0, 7, 64, 10**6)}
    assert token_counts.quantile(token_counts.suffix_sums(hist), 0.5).first()[0] == lengths[(len(lengths) + 1) // 2 - 1]
    assert token_counts.suffix_sums(token_counts.histogram(spark.createDataFrame([], SCHEMA), *contract())).collect() == []


def test_expansion_tables_are_those_of_telephony():
    mu, a = media_columns.EXPAND["mulaw"], media_columns.EXPAND["alaw"]
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F], mu[0xF0]) == (-32124, 32124, 0, 0, 120)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(np.unique(mu)) == 255 and len(np.unique(a)) == 256


def scalar_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media_columns.STEPS[index])
            diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value + (-diff if code & 8 else diff)))
            index = max(0, min(88, index + int(media_columns.INDEX[code])))
            out.append(value)
    return out


def test_adpcm_blocks_decode_together_as_one_by_one():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (7, 192), dtype=np.uint8)
    assert media_columns.decode_adpcm(blocks).tolist() == [scalar_adpcm(b.tobytes()) for b in blocks]
    tone = (9000 * np.sin(np.arange(3000) / 9)).astype(np.int16)
    back = media_columns.decode_adpcm(media_columns.encode_adpcm(tone)).reshape(-1)[:3000]
    assert np.abs(back[50:].astype(int) - tone[50:]).max() < 1500


def test_resampling_keeps_signals_apart():
    pcm = np.array([0, 100, 200, 300, -5, 7], dtype=np.int16)
    whole = media_columns.resample_2x(pcm, np.array([0, 4, 4, 6]))
    assert whole[::2].tolist() == pcm.tolist()
    assert whole[:8].tolist() == media_columns.resample_2x(pcm[:4], np.array([0, 4])).tolist()
    assert whole[3] == 150


@pytest.mark.parametrize("kind", [None, "mulaw", "alaw", "ima_adpcm"])
def test_media_round_trip(spark, kind):
    data = rows()
    media = media_columns.to_media(frame(spark, data), kind=kind)
    got = media_columns.describe(media).collect()
    seen = {}
    for r in got:
        assert r.payload_bytes > 0 and r.payload_bytes % 192 == 0 and r.media_bytes > r.payload_bytes
    want = Counter()
    for x in data:
        t = (x[1] or "").encode()
        p = t.ljust(max(192, -(-len(t) // 192) * 192))
        want[x[0], len(t), len(p), sha(p), zlib.crc32(p[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    text = {x[0]: x[1] or "" for x in data if x[0] is not None}
    for r in got:
        if r.doc_id is not None:
            assert seen.setdefault(text[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    pcm = media_columns.to_pcm(media).collect()
    assert all(r.pcm_rate == 16000 and len(r.pcm) for r in pcm)
    assert {f"{zlib.crc32(r.pcm):08x}" for r in pcm} == {r.feature.rsplit("pcm=", 1)[1] for r in got}


def brute_lines(data, run=3):
    places, lines = {}, {}
    for key, text in sorted({(x[0], x[1]) for x in data if x[1] is not None}, key=lambda p: (p[0] is not None, p[0] or 0)):
        own = [(i, s.strip(" \t\n\x0b\x0c\r")) for i, s in enumerate(text.split("\n"))]
        lines[key, text] = own = [x for x in own if x[1]]
        for k in range(len(own) - run + 1):
            places.setdefault(tuple(s for _, s in own[k : k + run]), []).append((key, text, k))
    gone = {}
    for found in places.values():
        for key, text, k in found[1:]:
            gone.setdefault((key, text), set()).update(i for i, _ in lines[key, text][k : k + run])
    return gone


@pytest.mark.parametrize("run", [2, 3])
def test_line_dedup_equals_brute_force(spark, run):
    rng = random.Random(5)
    data = [(k, "\n".join(rng.choice(["a b", "c ", " c", "d", "e e e", "", "f", "g"]) for _ in range(rng.randint(0, 12))), "en", "s", 1, 1, "h") for k in range(60)]
    data += [(None, data[3][1], "en", "s", 1, 1, "h"), (70, None, "en", "s", 1, 1, "h"), data[5], data[5]]
    gone = brute_lines(data, run)
    got = line_dedup.line_dedup(frame(spark, data), run=run)
    assert got.columns == [*frame(spark, data).columns, "n_lines", "n_removed_lines"]
    want = Counter()
    for key, text, *_ in data:
        out = gone.get((key, text), set())
        want[key, None if text is None else "\n".join(s for i, s in enumerate(text.split("\n")) if i not in out), len(out)] += 1
    assert Counter((r.doc_id, r.text, r.n_removed_lines) for r in got.collect()) == want


def test_repeated_lines_of_many_words_are_runs_where_asked(spark):
    rng = random.Random(6)
    some = [" ".join(rng.choices("abcdefgh", k=n)) for n in (60, 51, 50, 30, 25, 20, 2)]
    data = [(k, "\n".join(rng.choice([*some, "", f"own {k}"]) for _ in range(rng.randint(1, 5))), "en", "s", 1, 1, "h") for k in range(40)]
    data += [(50, some[0], "en", "s", 1, 1, "h"), (51, f" {some[0]}\t\nthat is new", "en", "s", 1, 1, "h"), (None, some[1], "en", "s", 1, 1, "h"), data[3], (53, some[2], "en", "s", 1, 1, "h"), (54, None, "en", "s", 1, 1, "h")]
    gone, places = brute_lines(data), {}
    for key, text in sorted({(x[0], x[1]) for x in data if x[1] is not None}, key=lambda p: (p[0] is not None, p[0] or 0)):
        own = [(i, s.strip(" \t\n\x0b\x0c\r")) for i, s in enumerate(text.split("\n"))]
        own = [x for x in own if x[1]]
        for n in (1, 2):
            for k in range(len(own) - n + 1):
                if sum(len(s.split()) for _, s in own[k : k + n]) > 50:
                    places.setdefault(tuple(s for _, s in own[k : k + n]), []).append((key, text, own[k : k + n]))
    for found in places.values():
        for key, text, part in found[1:]:
            gone.setdefault((key, text), set()).update(i for i, _ in part)
    assert gone[51, data[41][1]] == {0} and (53, some[2]) not in gone
    want = Counter()
    for key, text, *_ in data:
        out = gone.get((key, text), set())
        want[key, None if text is None else "\n".join(s for i, s in enumerate(text.split("\n")) if i not in out), len(out)] += 1
    got = line_dedup.line_dedup(frame(spark, data), words=50)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert Counter((r.doc_id, r.text, r.n_removed_lines) for r in got.collect()) == want


def test_line_dedup_is_native_and_takes_no_rows(spark):
    assert "Python" not in line_dedup.line_dedup(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
