"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    gated_recurrent,
    hamming_minhash,
    hard_negatives,
    hash_forest,
    histogram_sort,
    importance_resampling,
    mixing,
    positional_index,
    previous_factor,
    rule_ensemble,
    simhash_index,
    suffix_automaton,
    suffix_tree,
)
from .shared import documents

MIX_WEIGHTS, MIX_TOTAL, MIX_EPOCHS = [3.0, 1.0, 2.0], 1.5, 2.0


def op1_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.digests(positional_index.contaminated_documents(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")))


def _removed() -> Column:
    return F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def op2_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_automaton.substring_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", _removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(documents(spark, sf_dir))


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shard_documents(documents(spark, sf_dir), 24)


def op5_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_recurrent.scored(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), "toxic", 0.3)


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.scored(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), "quality", 0.7)


def op7_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = previous_factor.suffix_array_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", _removed().alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    return hash_forest.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op9_hamming_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_minhash.near_duplicates(documents(spark, sf_dir))


def op10_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(documents(spark, sf_dir).select("doc_id", "source", "text"), MIX_WEIGHTS, MIX_TOTAL, MIX_EPOCHS)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_weighted_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resampled(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), percent=10, least_words=20, buckets=10_000, longest=1, seed=2024)


def op12_threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mined(vectors, vectors.where("vec_id % 100 = 0"), positives=5, negatives=5, low=80, high=100, scale=256)


def op13_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_index.near_duplicates(documents(spark, sf_dir), n=3)


QUERIES = {
    "op1_positional_index": op1_positional_index,
    "op2_suffix_automaton": op2_suffix_automaton,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_histogram_sort": op4_histogram_sort,
    "op5_gated_recurrent": op5_gated_recurrent,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_previous_factor": op7_previous_factor,
    "op8_hash_prefix_forest": op8_hash_prefix_forest,
    "op9_hamming_minhash": op9_hamming_minhash,
    "op10_water_filling": op10_water_filling,
    "op11_weighted_selection": op11_weighted_selection,
    "op12_threshold_join": op12_threshold_join,
    "op13_simhash_index": op13_simhash_index,
}

ORACLES: dict[str, str] = {
    "op1_positional_index": r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(13, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
dg AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN lens WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dg JOIN win USING (g)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op9_hamming_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id WHERE r.m < l.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.m) AS component_id, w.doc_id = min(r.m) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
""",
    "op10_water_filling": """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST) AS free,
         1.5 * sum(source_size) OVER () AS share
  FROM s),
lv AS (SELECT arg_min((share - held) / free, cap / weight) AS level FROM r WHERE cap / weight >= (share - held) / free),
t AS (SELECT s.source, source_size, least(cap, level * weight)::DOUBLE AS target,
             CASE WHEN source_size > 0 THEN floor(least(cap, level * weight) / source_size)::BIGINT ELSE 0 END AS whole
      FROM s CROSS JOIN lv),
c AS (
  SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS want,
         sum(size) OVER (PARTITION BY d.source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, k) AS own
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= want OR (upto - own <= want AND want < upto AND want - (upto - own) > upto - want) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
""",
    "op11_weighted_selection": r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
           lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
dw AS (SELECT r, unnest(w) AS w FROM d),
iw AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
b AS (
  SELECT w, xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INT, 2))::BIGINT)),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])), 4294967295) % 10000 AS k
  FROM (SELECT w FROM dw UNION SELECT w FROM iw), crc),
s AS (SELECT k, count(*) AS n FROM dw JOIN b USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM iw JOIN b USING (w) GROUP BY k),
g AS (
  SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000.0::DOUBLE)
                            / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000.0::DOUBLE))))::BIGINT AS gain
  FROM s FULL JOIN t USING (k)),
f AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN b USING (w) JOIN g USING (k) GROUP BY r),
x AS (
  SELECT doc_id, r, coalesce(n, 0) AS n_features,
         CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN f USING (r)),
y AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM x),
z AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n
  FROM y WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, z.rank::BIGINT AS rank
FROM y LEFT JOIN z ON z.r = y.r AND z.rank <= 10 * z.n // 100
""",
    "op12_threshold_join": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
""",
}
