import zlib
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import mixing, quality_rules, sharding
from tests.llm.docs import SCHEMA, frame, rows, words


def expected(text):
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = Counter(grams)
    covered = {j for k, g in enumerate(grams) if often[g] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    data = rows() + [(900, "a|b # $5 % &amp; <b> *x*\n" * 3, "en", "s0", 1, 1, "h")]
    for r in quality_rules.quality_rules(frame(spark, data)).collect():
        got = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words
        assert got == expected(r.text), r.text
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r.base_failed and r.kept)


def test_texts_too_long_for_packed_positions(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 3)  # most texts go the way of sorted windows
    for r in quality_rules.with_statistics(frame(spark)).select("text", "n_repeat_words").collect():
        assert r.n_repeat_words == expected(r.text)[4]


def test_rules_are_a_table(spark):
    own = (quality_rules.Rule("few words", "n_words", low=3), quality_rules.Rule("many symbols", "symbol_ratio", high=0.1))
    df = spark.createDataFrame([(1, "a b"), (2, "a b c #"), (3, "a b c"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: (r.broken_rules, r.kept) for r in quality_rules.quality_rules(df, rules=own, min_words=0, max_repeat_percent=100).collect()}
    assert got == {1: (["few words"], False), 2: (["many symbols"], False), 3: ([], True), 4: (["few words"], False)}


def test_no_python_on_the_native_paths(spark):
    for df in (quality_rules.quality_rules(frame(spark)), mixing.with_copies(frame(spark))):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString().replace("ExistingRDD", "")


def check_shards(got, data, n=8):
    assert len(got) == len(data)
    total = sum(r.size for r in got)
    largest = max(r.size for r in got)
    for s in range(n):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / n) <= largest + 2 * 0.02 * total / n
    assert Counter((r.key, r.size, r.text_crc32) for r in got) == Counter((x[0], len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in data)


def test_shards_are_near_equal_and_gapless(spark):
    data = rows(n=300)
    check_shards(sharding.shard_by_bytes(frame(spark, data)).collect(), data)


def test_a_hot_group_is_split_and_small_groups_stay_together(spark):
    data = [(k, "same text " * 5, "en", "s", 1, 1, "h") for k in range(300)] + [(1000 + k, f"pair {k // 2} " * 9, "en", "s", 1, 1, "h") for k in range(600)]
    got = sharding.shard_by_bytes(frame(spark, data), slack=0.05).collect()
    check_shards(got, data)
    assert len({r.shard for r in got if r.key < 1000}) > 1
    split = Counter(r.text_crc32 for r in {(r.text_crc32, r.shard): r for r in got if r.key >= 1000}.values())
    assert max(split.values()) == 1


def test_no_rows_no_shards(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_targets_share_all_words_and_stop_at_three_times(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), ("d", 0), (None, 70)], "source string, source_size long")
    got = {r.source: r for r in mixing.rates(totals).collect()}
    assert [got[s].weight for s in ("a", "b", "c", "d", None)] == [1, 2, 3, 1, 2]
    assert got["b"].target == 30 and got["d"].target == 0 and got[None].target == 210
    assert abs(sum(r.target for r in got.values()) - 1580) < 1e-6
    assert abs(got["c"].target / got["a"].target - 3) < 1e-9


def test_copies_follow_the_rate(spark):
    data = [(k, f"w{k} " * 10, "en", f"s{k % 4}", 1, 1, "h") for k in range(4000)] + [(None, "n o", "en", None, 1, 1, "h")] * 3
    got = mixing.with_copies(frame(spark, data), seed=3)
    again = mixing.with_copies(frame(spark, data), seed=3)
    assert sorted(got.select("doc_id", "copies").collect(), key=str) == sorted(again.select("doc_id", "copies").collect(), key=str)
    for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect():
        assert r.most <= 3 and abs(r.taken - r.target) <= max(0.1 * r.target, 12)
    mixed = mixing.mix(frame(spark, data), seed=3)
    assert mixed.columns == frame(spark, data).columns
    assert mixed.count() == got.agg(F.sum("copies")).first()[0]


def test_mixing_of_awkward_rows(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.with_copies(frame(spark)).count() == len(rows())
