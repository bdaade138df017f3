import hashlib
import inspect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import byte_bpe, quality_classifier as qc, queries
from quern.llm.textbytes import pieces
from tests.llm.docs import SCHEMA, frame, rows
from tests.llm.test_bpe_media_lines import brute_lines
from tests.llm.test_near_and_substring import brute_components
from tests.llm.test_rules_shards_mix import expected

DIR = "/root/testdata/sf0.01"


def featured(texts):
    (_, _, data, offsets), = pieces(pa.array(texts), 1 << 24)
    return qc.features(data, offsets, [np.arange(len(texts), dtype=np.uint64)])


def test_scores_are_those_of_all_pairs():
    rng = np.random.default_rng(0)
    size = qc.BUCKETS + qc.STRUCTURE
    model = qc.Model(0.3, rng.normal(size=size).astype(np.float32), rng.normal(0, 0.3, (size, qc.RANK)).astype(np.float32))
    bounds, ids, values = featured(["a b c a", None, "", "THE %%% | x\ny 12"])
    for d, got in enumerate(model.logits(bounds, ids, values)):
        i, x = ids[bounds[d] : bounds[d + 1]], values[bounds[d] : bounds[d + 1]].astype(float)
        assert len(i)
        want = 0.3 + sum(model.weights[i] * x)
        want += sum(float(model.vectors[i[p]] @ model.vectors[i[q]]) * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert got == pytest.approx(want, abs=1e-3)


def test_features_do_not_depend_on_the_batch():
    texts = [r[1] for r in rows()]
    bounds, ids, values = featured(texts)
    for d, t in enumerate(texts):
        (_, _, data, offsets), = pieces(pa.array([t], pa.string()), 1 << 24)
        _, i, x = qc.features(data, offsets, [np.array([d], dtype=np.uint64)])
        assert i.tolist() == ids[bounds[d] : bounds[d + 1]].tolist() and np.allclose(x, values[bounds[d] : bounds[d + 1]])


def test_held_out_rows_are_told_apart(spark):
    scored = queries.op3_quality_classifier(spark, DIR)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    got = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in own) >= 0.95 * len(own)
    good, bad = [r.score for r in own if r.quality], [r.score for r in own if not r.quality]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97
    assert scored.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_fits_are_bounded_repeatable_and_defined_without_labels(spark):
    df = frame(spark)
    labels = spark.createDataFrame([(k, k % 2) for k in range(11, 60)] + [(None, 1), (12, None)], "doc_id long, quality int")
    a, b = (qc.train(df, labels, sample=20) for _ in range(2))
    assert a.bias == b.bias and (a.vectors == b.vectors).all()
    none = qc.train(df, labels.limit(0))
    got = qc.score(df, none, meta=("n_chars", "source")).collect()
    assert len(got) == len(rows()) and all(r.score == 0.5 for r in got)
    same = qc.train(df, labels.filter("quality = 1"))
    assert all(r.score > 0.9 for r in qc.score(df, same, keep_text=False).collect())
    assert qc.score(spark.createDataFrame([], SCHEMA), a).collect() == []
    clash = df.withColumn("score", F.lit("mine"))
    assert dict(qc.score(clash, a).dtypes)["score"] == "double"


def test_labels_source_language_and_id_are_no_inputs():
    text = inspect.getsource(queries.quality_model) + inspect.getsource(queries.op3_quality_classifier)
    assert text.count('meta=("n_chars",)') == 2


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output on the small tables."""
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {}
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def both(stages, name):
    return [r.asDict() for r in stages[name][0].collect()], [r.asDict() for r in stages[name][1].collect()]


def test_all_stages_but_the_last_return_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "mix", "encode"]
    for name, (before, after) in stages.items():
        if name != "encode":
            assert after.schema.names == before.schema.names and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_the_quality_stage_rejects_what_scores_low(spark, stages):
    before, after = both(stages, "quality")
    model = queries.quality_model(spark, stages["quality"][0], "/root/testdata/sf0.001")
    texts = [r["text"] for r in before]
    (_, _, data, offsets), = pieces(pa.array(texts), 1 << 26)
    chars = spark.createDataFrame([(k, r["n_chars"]) for k, r in enumerate(before)], "k long, n long").select("k", F.xxhash64(F.lit("n_chars"), F.floor(F.log2(F.greatest("n", F.lit(0)) + F.lit(1.0)))).alias("m")).orderBy("k").collect()
    scores = model.scores(*qc.features(data, offsets, [np.array([r.m for r in chars], dtype=np.int64).view(np.uint64)]))
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, s in zip(before, scores, strict=True) if s >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    assert sum((k in kept) == bool(v) for k, v in labels.items()) >= 0.95 * len(labels)


def test_the_line_stage_equals_brute_force(stages):
    before, after = both(stages, "lines")
    gone = brute_lines([(r["doc_id"], r["text"]) for r in before])
    want = {}
    for r in before:
        out = gone.get((r["doc_id"], r["text"]), set())
        text = "\n".join(s for i, s in enumerate(r["text"].split("\n")) if i not in out)
        if not out or text.strip(" \t\n\x0b\x0c\r"):
            want[r["doc_id"]] = text
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_the_near_stage_equals_brute_force(stages):
    before, after = both(stages, "near")
    want = brute_components([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(k for k, _, c in want if k == c)
    text = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == text[r["doc_id"]] for r in after)


def test_the_near_stage_keeps_one_row_whatever_its_id(spark):
    base = [f"b{k}" for k in range(200)]
    left, right = (" ".join(f"{side}{k}" if k in at else w for k, w in enumerate(base)) for side, at in (("l", range(10, 60, 10)), ("r", range(110, 160, 10))))
    bridge, lone, twice = " ".join(base), " ".join(f"n{k}" for k in range(80)), " ".join(f"t{k}" for k in range(80))
    docs = spark.createDataFrame([
        (7, left, "en", "s", 1), (3, right, "en", "s", 1), (None, bridge, "en", "s", 1),  # joined by the row without an id alone
        *[(None, lone, "en", "s", 1)] * 3, (None, f"{lone} more", "en", "s", 1),
        (9, twice, "en", "z", 1), (9, twice, "en", "a", 1), (9, twice, "en", "a", 1), (12, twice, "en", "a", 1), (9, f"{twice} more", "en", "a", 1),
        (20, "", "en", "s", 0), (20, "", "en", "s", 0), (21, "", "en", "s", 0), (None, " ", "en", "s", 0), (None, " ", "en", "s", 0), (22, None, "en", "s", None),
    ], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near(spark, docs, "")
    assert got.columns == docs.columns
    got = sorted((tuple(r)[:4] for r in got.collect()), key=str)
    worded = [r for r in got if (r[1] or "").strip()]
    assert len(worded) == 3 and (3, right, "en", "s") in worded
    assert [r[0] for r in worded if r[1].startswith(lone)] == [None]
    assert [(r[0], r[3]) for r in worded if r[1].startswith(twice)] == [(9, "a")]
    assert [r for r in got if not (r[1] or "").strip()] == sorted([(20, "", "en", "s"), (21, "", "en", "s"), (None, " ", "en", "s"), (None, " ", "en", "s"), (22, None, "en", "s")], key=str)


def test_the_mix_stage_takes_what_the_targets_say(stages):
    before, after = both(stages, "mix")
    sizes = Counter()
    for r in before:
        sizes[r["source"]] += expected(r["text"])[0]
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))}
    open_, left, target = dict(weight), sum(sizes.values()), {}
    while open_:  # pour by weight, close full sources, pour what is over again
        full = [s for s in open_ if left * open_[s] / sum(open_.values()) > 3 * sizes[s]]
        if not full:
            target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in full:
            target[s] = 3 * sizes[s]
            open_.pop(s)
        left = sum(sizes.values()) - sum(target.values())
    copies = Counter(r["doc_id"] for r in after)
    for r in before:
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        key = "|".join(["0", f"={r['doc_id']}", f"={r['source']}", "=" + hashlib.md5(r["text"].encode()).hexdigest()])
        extra = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32 < rate - int(rate)
        assert copies[r["doc_id"]] == int(rate) + extra


def test_the_last_stage_equals_the_library(stages):
    import tiktoken

    path, pattern = queries.byte_bpe()
    codec = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    before, after = both(stages, "encode")
    want = Counter()
    for r in before:
        ids = codec.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after) == want
