import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import minhash, substring_dedup
from quern.llm.components import components
from quern.llm.textbytes import Words, pieces
from tests.llm.docs import SCHEMA, frame, rows, words


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def near_copies(seed=2, groups=6, size=12):
    """Bases with copies of a few changed words: some copies are linked to their base alone."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(150)]
        for k in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 9) if k else 0):
                own[rng.randrange(len(own))] = f"new{g}x{k}x{rng.randint(0, 99)}"
            out.append((" " if k % 2 else "\n").join(own))
    rng.shuffle(out)
    return [(500 + k, t.upper() if k % 5 == 0 else t, "en", "s", 1, 1, "h") for k, t in enumerate(out)]


def brute_components(data):
    sets = [shingles(x[1]) for x in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and data[i][0] is not None and data[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for k, x in enumerate(data):
        if x[0] is not None:
            least[find(k)] = min(least[find(k)], x[0])
    return [(x[0], len(s), None if x[0] is None else least[find(k)]) for k, (x, s) in enumerate(zip(data, sets, strict=True))]


def test_components_of_near_copies_equal_brute_force(spark):
    data = rows() + near_copies()
    got = minhash.near_duplicates(frame(spark, data))
    assert got.columns == [*frame(spark, data).columns, "n_shingles", "component_id", "kept"]
    got = got.collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(data))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(x[:2] for x in data)


def test_a_star_around_a_base_is_one_component(spark, monkeypatch):
    """Copies that are near their base, but not each other, in blocks smaller than the group."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    base = [f"b{k}" for k in range(200)]
    data = []
    for k in range(40):
        own = list(base)
        if k:
            for j in range(4):
                own[(k * 5 + 47 * j) % 200] = f"c{k}x{j}"
        data.append((900 - k, " ".join(own), "en", "s", 1, 1, "h"))
    want = Counter(brute_components(data))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, data)).collect()) == want


def test_no_rows_no_components(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(100, k) for k in range(200, 260)] + [(7, 7), (None, 3), (61, 62), (62, 61)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10, 61), 10), **dict.fromkeys([100, *range(200, 260)], 100), 61: 61, 62: 61}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    estimates = []
    for n in (1, 2, 5, 40, 3000):
        common = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
        a, b = np.append(common, rng.integers(0, 2**63, n, dtype=np.uint64)), common
        s = minhash.sketches(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 4 * n, 7 * n, 7 * n]))
        assert (s[:2] != minhash._EMPTY).all() and (s[2] == minhash._EMPTY).all()
        if n >= 40:
            estimates.append(float((s[0] == s[1]).mean()))
    assert all(abs(e - 0.75) < 0.1 for e in estimates)


def test_few_pairs_of_the_threshold_share_no_band():
    """200 pairs at similarity 0.75: each must share a band."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        common = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a = np.sort(np.append(common, rng.integers(0, 2**63, 100, dtype=np.uint64)))
        s = minhash.band_keys(minhash.sketches(np.concatenate([a, np.sort(common)]), np.array([0, 400, 700])))
        assert (s[0] == s[1]).any()


def brute_substrings(data, window):
    seqs = [words(x[1]) for x in data]
    seen = Counter(tuple(w[k : k + window]) for w in seqs for k in range(len(w) - window + 1))
    out = []
    for x, w in zip(data, seqs, strict=True):
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out.append((x[0], len(w), len(gone), hashlib.sha256(" ".join(y for j, y in enumerate(w) if j not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window, bits", [(35, 1 << 20), (8, 1 << 20), (5, 1 << 9), (1, 1 << 12)])
def test_substring_dedup_equals_brute_force(spark, window, bits):
    rng = random.Random(window)
    passage = [f"p{k}" for k in range(60)]
    extra = []
    for k in range(80):
        w = [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 120))]
        if k % 3 == 0:
            a, n = rng.randint(0, 20), rng.choice([window - 1, window, window + 1, 40])
            at = rng.randint(0, len(w))
            w[at:at] = passage[a : a + n]
        extra.append((600 + k, " ".join(w), "en", "s", 1, 1, "h"))
    data = rows() + extra
    got = substring_dedup.substring_dedup(frame(spark, data), window=window, bits=bits, digests=True)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "copies", "hash", "n_words", "n_removed", "kept_sha256"]
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_substrings(data, window)


def test_substring_dedup_keeps_other_texts_as_they_are(spark):
    data = [(1, "a  b\nc", "en", "s", 1, 1, "h"), (2, None, "en", "s", 1, 1, "h"), (3, " ".join(map(str, range(50))), "en", "s", 1, 1, "h"), (4, "x " + " ".join(map(str, range(50))) + "\ny", "en", "s", 1, 1, "h")]
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, data), bits=1 << 16).collect()}
    assert got == {1: ("a  b\nc", 0), 2: (None, 0), 3: ("", 50), 4: ("x y", 50)}
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA), bits=1 << 16).collect() == []


def test_words_and_windows_from_buffers():
    texts = [None, "", "a bc", "bc", " x\ty ", "a bc a bc", "é日 é日", "long" * 40000 + " bc"]
    for size in (1, 7, 1 << 20):
        found = []
        for _, _, data, offsets in pieces(pa.array(texts).slice(0), size):
            w = Words(data, offsets)
            raw = data.tobytes()
            for d in range(len(offsets) - 1):
                found.append([(raw[w.starts[k] : w.ends[k]].decode(), int(w.hashes[k])) for k in range(w.first[d], w.first[d + 1])])
        assert [[x for x, _ in f] for f in found] == [words(t) for t in texts]
        by = defaultdict(set)
        for f in found:
            for x, h in f:
                by[x].add(h)
        assert all(len(h) == 1 for h in by.values()) and len({*map(tuple, by.values())}) == len(by)


def morse(n, a="a", b="b"):
    """n letters of a and b by the rule whose sums of powers cancel out, and the same with a and b exchanged."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return [(b if x else a) for x in bits], [(a if x else b) for x in bits]


def test_words_and_windows_built_by_a_rule_are_told_apart(spark):
    x, y = ("".join(w) for w in morse(1024))
    p, q = ("".join(w) for w in morse(64, "ab", "ba"))  # eight letters at a time
    shared = " ".join(f"s{k}" for k in range(34))
    texts = [f"{shared} {x}", f"{shared} {y}", x, y, f"{shared} {p}", f"{shared} {q}"]
    data = [(k, t, "en", "s", 1, 1, "h") for k, t in enumerate(texts)]
    got = substring_dedup.substring_dedup(frame(spark, data), bits=1 << 16)
    assert [r.n_removed for r in got.collect()] == [0] * len(data)
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, data)).collect()}
    assert near[2] == 2 and near[3] == 3
    for n in (32, 1024):
        lanes = [Words(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, 2 * n - 1])).windows(n, lanes=2) for w in morse(n)]
        assert lanes[0][1] != lanes[1][1] and lanes[0][2] != lanes[1][2]


def test_windows_are_those_of_their_words_alone():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(50)] + ["x" * 63, "x" * 64, "x" * 65, "x" * 66, None]
    (_, _, data, offsets), = pieces(pa.array(texts), 1 << 20)
    w = Words(data, offsets)
    for k in (1, 2, 3, 5, 18, 35):
        seen = defaultdict(set)
        for at, *h in zip(*w.windows(k, short=True, lanes=2), strict=True):
            d = int(w.text_of(np.array([at]))[0])
            own = words(texts[d])
            seen[tuple(own[at - w.first[d] : at - w.first[d] + k])].add(tuple(map(int, h)))
        assert all(len(h) == 1 for h in seen.values()) and len({h for v in seen.values() for h in v}) == len(seen)
        assert set(seen) == {tuple(x[a : a + k]) for x in map(words, texts) if x for a in range(max(len(x) - k + 1, 1))}


def counted(monkeypatch):
    """Rows of what near-dedup writes, by tag."""
    seen, write = Counter(), minhash.materialise

    def materialise(df, tag):
        out = write(df, tag)
        seen[tag] += out.count()
        return out

    monkeypatch.setattr(minhash, "materialise", materialise)
    return seen


def test_a_group_below_the_threshold_costs_no_pairs(spark, monkeypatch):
    """Sets whose similarities are all 0.73: candidates grow as the sets do, and comparing them in full gives no rows."""
    costs = []
    for n in (100, 200):
        data = [(k, " ".join([*(f"b{j}" for j in range(300)), *(f"own{k}x{j}" for j in range(55))]), "en", "s", 1, 1, "h") for k in range(n)]
        a, b = shingles(data[0][1]), shingles(data[1][1])
        assert 0.72 < len(a & b) / len(a | b) < 0.74
        with monkeypatch.context() as m:
            seen = counted(m)
            got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, data)).collect()]
        assert Counter(got) == Counter(brute_components(data))
        costs.append((seen["candidates"], seen["joins"]))
    assert 0 < costs[1][0] <= 3 * costs[0][0] and costs[0][1] == costs[1][1] == 0


def test_recall_near_the_threshold(spark):
    """10,000 pairs at similarities from 0.75 to 0.80, none like another pair: at least 0.999 of them are linked."""
    rng = random.Random(11)
    data, near = [], 0
    for k in range(10_000):
        w = [f"p{k}w{j}" for j in range(90)]
        other = list(w)
        at, n = rng.randint(4, 20), rng.randint(6, 8)
        other[at : at + n] = [f"q{k}w{j}" for j in range(n)]
        a, b = shingles(" ".join(w)), shingles(" ".join(other))
        near += 0.75 <= len(a & b) / len(a | b) <= 0.80
        data += [(2 * k, " ".join(w), "en", "s", 1, 1, "h"), (2 * k + 1, " ".join(other), "en", "s", 1, 1, "h")]
    assert near == 10_000
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, data), keep_text=False).collect()}
    want = {k: c for k, _, c in ((x[0], 0, x[0] - x[0] % 2 if linked(data, x[0]) else x[0]) for x in data)}
    assert sum(got[k] == want[k] for k in want) >= 0.999 * len(want)
    assert all(c in (k, k - k % 2) for k, c in got.items())


def linked(data, k):
    a, b = (shingles(data[j][1]) for j in (k - k % 2, k - k % 2 + 1))
    return 100 * len(a & b) >= 75 * len(a | b)


def test_common_elements_are_counted_exactly():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 300), dtype=np.uint64)) for _ in range(30)]
    for width in (7, 4096):
        got = minhash._common(sets[:12], sets[12:], width)
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(8)
    giant = " ".join(f"g{rng.randint(0, 10**6)}" for _ in range(400_000))
    assert len(giant) > 2 << 20
    passage = " ".join(giant.split()[300_000:300_060])
    data = [(1, giant, "en", "s", 1, 1, "h"), (2, f"{giant} more", "en", "s", 1, 1, "h"), (3, passage, "en", "s", 1, 1, "h"), (4, "", "en", "s", 1, 1, "h")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, data), keep_text=False).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, data), bits=1 << 22, digests=True).collect()}
    assert cut == {1: (400_000, 400_000), 2: (400_001, 400_000), 3: (60, 60), 4: (0, 0)}
