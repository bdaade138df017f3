"""Columns of the input that are called what operators call theirs."""

import pytest
from pyspark.sql import functions as F

from quern.llm import byte_bpe, line_dedup, media_columns, minhash, mixing, quality_classifier, quality_rules, queries, sharding, substring_dedup
from tests.llm.docs import frame

NAMES = ["_words", "_lines", "_sorted", "_pairs", "_key", "_hash", "removed", "_id", "_k", "label", "c0", "m0", "t", "k", "s", "starts", "_media", "text_", "media_", "mix_source_", "key", "tie"]
OPERATORS = {
    "rules": quality_rules.quality_rules, "mixing": mixing.with_copies, "lines": line_dedup.line_dedup, "near": minhash.near_duplicates, "substrings": lambda df: substring_dedup.substring_dedup(df, bits=1 << 16),
    "bpe": lambda df: byte_bpe.encode(df, *queries.byte_bpe()), "media": media_columns.to_media, "described": lambda df: media_columns.describe(media_columns.to_media(df)), "pcm": lambda df: media_columns.to_pcm(media_columns.to_media(df)),
    "score": lambda df: quality_classifier.score(df, quality_classifier.train(df, df.limit(0).select("doc_id", F.lit(1).alias("quality")))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_they_are_carried_along(spark, name):
    df = frame(spark).withColumns({n: F.lit(f"mine {n}") for n in NAMES})
    got = OPERATORS[name](df)
    rows = got.collect()
    assert len(rows) == df.count()
    for n in NAMES:
        assert all(r[n] == f"mine {n}" for r in rows), n


def test_shards_need_no_other_columns(spark):
    df = frame(spark).withColumns({n: F.lit(1) for n in ("size", "shard", "slot", "part", "hash", "key")})
    assert sharding.shard_by_bytes(df).count() == df.count()
