"""Every registered corpus query: against its SQL where it has one, else against what its contract says; and on empty tables."""

import hashlib
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import byte_bpe, common, line_dedup, mixing, queries
from tests.llm.docs import rows, words
from tests.llm.test_near_and_substring import near_copies, shingles
from tests.llm.test_rules_shards_mix import expected

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def documents(giant=True):
    """Awkward, repeated, null, empty and, but for SQL, giant texts; near copies; passages of lines and of words that several texts share."""
    rng = random.Random(21)
    texts = [x[1] for x in rows(n=30)] + [x[1] for x in near_copies(groups=2, size=6)]
    lines = ["\n".join(f"line {rng.randint(0, 30)} of {rng.randint(0, 3)}" for _ in range(rng.randint(1, 9))) for _ in range(25)]
    passage = " ".join(f"p{k}" for k in range(50))
    texts += lines + [f"{a} {passage} {a}" for a in "xyz"] + [passage, passage]
    texts += [] if not giant else ["\n".join(" ".join(f"g{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(8_000))]  # longer than PIECE_BYTES
    return [(k, t, "en", None if k % 7 == 3 else f"s{k % 5}", None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(documents(), KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(10, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("small")
    spark.createDataFrame(documents(giant=False), KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql_on_awkward_rows(spark, small, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, small)
    cursor = con.execute(queries.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(map(plain, r)) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


def test_giant_texts_are_taken_whole(spark, table):
    """Rules, lines and words of a text that is longer than a piece."""
    giant = documents()[-1]
    own = F.col("doc_id") == giant[0]
    r = queries.op1_quality_rules(spark, table).filter(own).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected(giant[1])
    r = queries.op7_line_dedup(spark, table).filter(own).first()
    assert (r.n_lines, r.n_removed_lines, r.kept_md5) == (8_000, 0, hashlib.md5(giant[1].encode()).hexdigest())
    r = queries.op9_substring_dedup(spark, table).filter(own).first()
    assert (r.n_words, r.n_removed, r.kept_sha256) == (320_000, 0, hashlib.sha256(" ".join(words(giant[1])).encode()).hexdigest())
    r = queries.op6_minhash(spark, table).filter(own).first()
    assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(giant[1])), giant[0], True)
    assert queries.op3_quality_classifier(spark, table).filter(own).count() == 1


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows_no_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_the_pipeline_takes_no_rows(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_shards_of_the_query_are_near_equal_and_gapless(spark, table):
    got, data = queries.op2_sharding(spark, table).collect(), {x[0]: (x[1] or "").encode() for x in documents()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in data.items()} and len(got) == len(data)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for shard in range(8):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= largest + 0.04 * total / 8
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_media_of_the_query_hold_the_payload(spark, table):
    got, seen = queries.op4_media_columns(spark, table).collect(), {}
    data = {x[0]: (x[1] or "").encode() for x in documents()}
    assert len(got) == len(data)
    for r in got:
        t = data[r.doc_id]
        p = t.ljust(max(192, -(-len(t) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert seen.setdefault(t, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
        samples = int(r.feature.split("samples=")[1].split(":")[0])
        assert samples == 2 * (377 * len(p) // 192 if r.feature.startswith("ima_adpcm") else len(p))
    assert {r.feature.split(":")[0] for r in got} == {"mulaw", "alaw", "ima_adpcm"}


@pytest.fixture(scope="module")
def ids():
    import tiktoken

    path, pattern = queries.byte_bpe()
    codec = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    return {x[0]: codec.encode_ordinary(x[1] or "") for x in documents()}


def test_ids_of_the_query_are_the_librarys(spark, table, ids):
    data = {x[0]: (x[1] or "").encode() for x in documents()}
    want = {(k, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(data[k]).hexdigest()) for k, x in ids.items()}
    got = queries.op5_byte_bpe(spark, table).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert set(map(tuple, got)) == want and len(got) == len(data)


def test_counts_of_the_query_are_exact(spark, table, ids):
    lengths = [len(x) for x in ids.values()]
    got = queries.op10_token_counts(spark, table).collect()
    assert {r.n_tokens: r.n_docs for r in got} == Counter(lengths)
    for r in got:
        assert (r.docs_at_least, r.tokens_at_least) == (sum(n >= r.n_tokens for n in lengths), sum(n for n in lengths if n >= r.n_tokens))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)


def test_words_that_the_mix_takes(spark, table):
    got, data = queries.op8_mixing(spark, table).collect(), {x[0]: x for x in documents()}
    sizes = Counter()
    for x in data.values():
        sizes[x[3]] += len(words(x[1]))
    for r in got:
        assert (r.size, r.source_size) == (len(words(data[r.doc_id][1])), sizes[data[r.doc_id][3]])
        assert 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
    again = {r.doc_id: r.taken for r in queries.op8_mixing(spark, table).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_tables_of_many_sources_are_dealt_out(spark, table, monkeypatch):
    df = common.documents(spark, table)
    few = sorted(map(str, mixing.with_copies(df).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 0)
    many = mixing.with_copies(df)
    assert sorted(map(str, many.collect())) == few and len(few) == df.count()


def test_documents_are_not_shuffled_by_source(spark, table):
    for df in (mixing.with_copies(common.documents(spark, table)), mixing.mix(common.documents(spark, table))):
        df.collect()
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_only_neighbours_that_never_meet_are_put_together():
    heads, tails = [[0, 5], [3, 9], [40], [2, 7]], [[103, 109], [], [102, 107], []]
    assert byte_bpe.stitch(heads, tails, 100, 50) == [(0, 103), (3, None), (None, 102), (2, -1)]


def test_intermediate_data_need_a_shared_folder_on_a_cluster(spark):
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(session("local[2]")).startswith("file://")


def test_a_filter_lets_all_members_through(spark):
    for n in (0, 5, 5000):
        has = common.member_filter(spark.range(n).select(F.xxhash64("id")))
        got = {r.id for r in spark.range(20_000).filter(has(F.xxhash64("id"))).collect()}
        assert set(range(n)) <= got and len(got) <= n + 2000


def test_salted_joins_are_joins(spark):
    left = spark.createDataFrame([(k % 3 if k % 5 else None, k) for k in range(40)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k int, w string")
    for how in ("left", "inner", "left_semi"):
        assert sorted(map(str, common.salted_join(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_line_dedup_broadcasts_no_table_that_grows(spark, small, monkeypatch):
    """Fingerprints, first places and removed lines are far under Spark's threshold here, and yet must not go to the driver."""
    ran, kept = [], common.materialise

    def plan(df):
        df.collect()
        ran.append(df._jdf.queryExecution().executedPlan().toString())

    def seen(df, tag):
        plan(df)
        return kept(df, tag)

    monkeypatch.setattr(line_dedup, "materialise", seen)
    plan(queries.op7_line_dedup(spark, small))
    assert [("SortMergeJoin" in p, "Broadcast" in p) for p in ran] == [(False, False), (True, False), (True, False), (True, False)]
