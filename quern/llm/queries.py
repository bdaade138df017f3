"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken_rules", "; ").alias("broken_rules"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    out = shard_by_bytes(documents(spark, sf_dir), n_shards=8)
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import with_copies

    out = with_copies(documents(spark, sf_dir).select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The classifier, fitted on labelled rows of docs that aren't held out."""
    from .quality_classifier import held_out, train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(docs, labels.filter(~held_out()), meta=("n_chars",))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import held_out, score

    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    out = score(docs, quality_model(spark, docs, sf_dir), meta=("n_chars",), keep_text=False)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_columns import told

    return told(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def byte_bpe() -> tuple[str, str]:
    """The rank file and the pattern of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode

    return encode(documents(spark, sf_dir).select("doc_id", "text"), *byte_bpe())


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.md5("text").alias("kept_md5"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(documents(spark, sf_dir).select("doc_id", "text"), digests=True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import histogram, suffix_sums

    return suffix_sums(histogram(documents(spark, sf_dir), *byte_bpe()))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_sharding, op3_quality_classifier, op4_media_columns, op5_byte_bpe, op6_minhash, op7_line_dedup, op8_mixing, op9_substring_dedup, op10_token_counts)}

_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {}

SQL["op8_mixing"] = rf"""
WITH d AS (SELECT *, len({_W}) AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS s, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
c AS (SELECT *, sum(s) OVER ()::BIGINT AS total,
        sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER b, 0)::BIGINT AS w_left, coalesce(sum(3 * s) OVER b, 0)::BIGINT AS filled
      FROM t WINDOW b AS (ORDER BY (3 * s)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - filled)::DOUBLE / w_left AS lv FROM c),
g AS (SELECT max(lv) FILTER (WHERE lv * w <= 3 * s) AS lv FROM l),
r AS (SELECT l.source, l.s, coalesce(least(g.lv * l.w, (3 * l.s)::DOUBLE), (3 * l.s)::DOUBLE) AS target FROM l, g),
j AS (SELECT d.doc_id, d.size, r.s AS source_size, r.target, coalesce(r.target / nullif(r.s, 0)::DOUBLE, 0) AS rate,
        ('0x' || substr(md5('0|' || coalesce('=' || d.doc_id::VARCHAR, '-') || '|' || coalesce('=' || d.source, '-') || '|' || coalesce('=' || md5(d.text), '-')), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT * size AS taken, (floor(rate) + (u < rate - floor(rate))::INT)::INT AS copies FROM j
"""

SQL["op1_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_W} AS w FROM documents),
s AS (SELECT doc_id, t, w, len(w) AS n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, n - 1)) AS i, w, n FROM s WHERE n >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT s.doc_id, n, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS dup, coalesce(n_repeat, 0) AS n_repeat,
        length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS capitals,
        len(list_filter(w, lambda x: list_contains([STOPS], x))) AS stops,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣·]'))) AS bullets,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_trail
      FROM s LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n < 50 OR 100 * n_repeat > 50 * n AS failed, list_filter([
        CASE WHEN chars::DOUBLE / nullif(n, 0) < 2 OR chars::DOUBLE / nullif(n, 0) > 12 THEN 'mean word length' END,
        CASE WHEN symbols::DOUBLE / nullif(n, 0) > 0.2 THEN 'symbols per word' END,
        CASE WHEN letters::DOUBLE / nullif(chars, 0) < 0.6 THEN 'letters per character' END,
        CASE WHEN stops::DOUBLE / nullif(n, 0) < 0.02 THEN 'stop words' END,
        CASE WHEN dup::DOUBLE / nullif(n_lines, 0) > 0.5 THEN 'repeated lines' END,
        CASE WHEN capitals::DOUBLE / nullif(letters, 0) > 0.5 THEN 'capitals per letter' END,
        CASE WHEN bullets::DOUBLE / nullif(n_lines, 0) > 0.9 THEN 'bulleted lines' END,
        CASE WHEN n_trail::DOUBLE / nullif(n_lines, 0) > 0.3 THEN 'lines that trail off' END], lambda x: x IS NOT NULL) AS broken FROM m)
SELECT doc_id, n AS n_words, chars AS word_chars, symbols AS n_symbols, dup AS n_dup_lines, n_repeat AS n_repeat_words, failed AS base_failed,
  NOT failed AND len(broken) = 0 AS kept, array_to_string(broken, '; ') AS broken_rules FROM b
"""


def _quoted_stops() -> str:
    from .quality_rules import STOP_WORDS

    return ", ".join(f"'{x}'" for s in dict.fromkeys(STOP_WORDS) for x in (s, s.capitalize()))


SQL["op1_quality_rules"] = SQL["op1_quality_rules"].replace("STOPS", _quoted_stops())

SQL["op7_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l),
n AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b WHERE x <> ''),
w AS (SELECT doc_id, k, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, k) AS nth FROM w WHERE z IS NOT NULL),
g AS (SELECT DISTINCT doc_id, k + o AS k FROM f, (SELECT unnest([0, 1, 2]) AS o) WHERE nth > 1),
r AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.k IS NULL) AS kept, count(n.k) AS n_lines, count(g.k) AS n_removed
      FROM l LEFT JOIN n USING (doc_id, i) LEFT JOIN g ON n.doc_id = g.doc_id AND n.k = g.k GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed_lines, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(kept, '')) END AS kept_md5 FROM documents d LEFT JOIN r USING (doc_id)
"""

# a lower-case copy of A-Z alone; a text's 5-word shingles, or all of its words where it has fewer
SQL["op6_minhash"] = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM common JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)),
ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, ends.b FROM reach JOIN ends ON reach.y = ends.a),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

SQL["op9_substring_dedup"] = rf"""
WITH t AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM s),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
c AS (SELECT x.doc_id, p, word, max(CASE WHEN r.n > 1 THEN r.i END) OVER (PARTITION BY x.doc_id ORDER BY p) AS last FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.p = r.i),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE p - last < 35) AS n_removed,
        string_agg(word, ' ' ORDER BY p) FILTER (WHERE last IS NULL OR p - last >= 35) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
