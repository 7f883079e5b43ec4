"""The operators as queries over the synthetic tables, with production parameters, each over whole tables and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontamination, exact_dedup, language, mixing, near_dedup, quality_rules, sentencepieces, substring_dedup, token_counts, token_files, toxicity
from .common import documents, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.score(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(documents(spark, sf_dir), digests=True).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.fit(docs))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_rules, op2_exact_dedup, op3_substring_dedup, op4_toxicity, op5_sentencepieces, op6_token_files, op7_language, op8_mixing, op9_near_dedup, op10_token_counts,
        op11_centroids, op12_decontamination,
    )
    return {f.__name__: f for f in every}


_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

_EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g
"""

_SUBSTRING = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35
), h AS (
  SELECT doc_id, s, md5_number(array_to_string(w[s:s + 34], ' ')) AS h FROM p
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM again
), lists AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""

_MIXING = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][CAST((i - 1) % 3 + 1 AS INT)] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s
), r AS (
  -- In order of capacity by weight, each source takes its share of what is left, or stops at twice its size.
  SELECT *, sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, i ROWS UNBOUNDED PRECEDING) - 2 * source_size AS capped,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w
), level AS (
  SELECT max((budget - capped) / free) FILTER (WHERE (budget - capped) * weight / free <= 2 * source_size) AS x FROM r
), t AS (
  SELECT source, source_size, CASE WHEN x IS NULL OR x * weight > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE x * weight END AS target FROM r, level
), u AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, CAST(floor(target / source_size) AS BIGINT)) END AS times FROM t
), k AS (
  SELECT source, key, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) AS upto, sum(size) AS size FROM d GROUP BY source, key
), cut AS (
  SELECT k.source, CASE WHEN upto - (target - times * source_size) < (target - times * source_size) - (upto - size) THEN key ELSE key - 1 END AS cut
  FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source
  WHERE size > 0 AND upto >= target - times * source_size AND upto - size < target - times * source_size
)
SELECT d.doc_id, d.size, u.source_size, round(u.target, 6) AS target, CAST(d.size * (u.times + CASE WHEN d.key <= coalesce(cut.cut, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""


def _centroid_rounds(rounds: int) -> str:
    """Vectors v (row, x) and first centroids c0 (c, m) to the clusters a<rounds> and the centroids c<rounds>."""
    out = []
    for k in range(rounds + 1):
        nearest = f"""
a{k} AS MATERIALIZED (
  SELECT row, arg_min(c, near) AS c, min(near)[1] AS d
  FROM (SELECT row, c, [list_sum(list_transform(list_zip(x, m), lambda p: CAST(p[1] - p[2] AS HUGEINT) * (p[1] - p[2]))), c] AS near FROM v, c{k}) GROUP BY row
)"""
        moved = f"""
c{k + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.m, o.m) AS m FROM c{k} o LEFT JOIN (
    SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS m
    FROM (SELECT c, i, CAST(sum(x[i]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM v JOIN a{k} USING (row), range(1, 65) AS t(i) GROUP BY c, i) GROUP BY c
  ) n USING (c)
)"""
        out += [nearest, moved] if k < rounds else [nearest]
    return ",".join(out)


_CENTROIDS = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), first AS (
  SELECT x, sha256('3:' || vec_id) AS h FROM v ORDER BY h NULLS LAST, x LIMIT 8
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x AS m FROM first
),{_centroid_rounds(10)}
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM v JOIN a10 USING (row) JOIN c10 USING (c)
"""

_BENCHMARK_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_DECONTAMINATION = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, {_BENCHMARK_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 10) AS l FROM (SELECT item_id, {_BENCHMARK_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), win AS MATERIALIZED (
  SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS s FROM b)
), places AS (
  SELECT row, l, w, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l
), met AS MATERIALIZED (
  SELECT row, l, s, t FROM (SELECT row, l, s, array_to_string(w[s:s + l - 1], ' ') AS t FROM places) WHERE t IN (SELECT t FROM win)
), hit AS (
  SELECT row, count(DISTINCT i) AS n FROM (SELECT row, unnest(range(s, s + l)) AS i FROM met) GROUP BY row
), items AS (
  SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM met JOIN win USING (t) WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
"""


def oracle_sql() -> dict[str, str]:
    """For the operators whose whole result plain SQL can say; the others are tested against brute force or held-out labels."""
    return {"op2_exact_dedup": _EXACT, "op3_substring_dedup": _SUBSTRING, "op8_mixing": _MIXING, "op11_centroids": _CENTROIDS, "op12_decontamination": _DECONTAMINATION}
