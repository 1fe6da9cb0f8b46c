"""The op queries: thin readings of the operators over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, exact_topk, hard_negatives, html_text, mixing, near_dup, packing, quality, secret_scan, substring_dedup, token_counts, token_files
from .common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(spark, token_files.write_token_files(table(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_token_files,
        op2_quality,
        op3_best_fit_packing,
        op4_exact_topk,
        op5_mix_sources,
        op6_token_counts,
        op7_secret_scan,
        op8_nearest,
        op9_html_text,
        op10_near_duplicates,
        op11_hard_negatives,
        op12_alignment,
        op13_substring_dedup,
    )
    return {f.__name__: f for f in named}


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""


OP5_SQL = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CAST('0x' || substr(md5('17|' || coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 8) AS BIGINT) AS draw FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s GROUP BY source),
w AS (SELECT source, source_size, CASE (n - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM a),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM t),
c AS (SELECT source, draw, sum(size) AS words FROM s GROUP BY source, draw),
r AS (SELECT source, draw, words, sum(words) OVER (PARTITION BY source ORDER BY draw) AS upto FROM c),
f AS (SELECT p.source, min_by(CASE WHEN r.upto - r.words + r.upto < 2 * (target - floor(rate) * source_size) THEN r.draw + 1 ELSE r.draw END, r.draw) AS threshold
  FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source WHERE target - floor(rate) * source_size > 0 AND r.upto > target - floor(rate) * source_size GROUP BY p.source),
k AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.source, p.rate, (floor(p.rate) + CASE WHEN s.draw < coalesce(f.threshold, 0) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN f ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, rate, copies FROM k
"""


#: For the layout of the given pages only: SQL has no parser; other layouts are tested on their own pages.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:h1|p|div|ul|li)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text, length(coalesce(array_to_string(blocks, chr(10)), ''))::BIGINT AS n_chars FROM b
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
u AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, e.j FROM r JOIN e ON e.i = r.other)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_inner_product(a.e, x.e) AS BIGINT) AS score FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


OP13_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(words) - 19)) AS i, words FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS seq FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + 19)))) AS gone FROM r WHERE n > 1 GROUP BY doc_id),
o AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(generate_series(1, len(words)), lambda x: NOT list_contains(gone, x)), lambda x: words[x]), ' ')) AS kept_sha256 FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_topk": OP4_SQL,
        "op5_mix_sources": OP5_SQL,
        "op9_html_text": OP9_SQL,
        "op10_near_duplicates": OP10_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op13_substring_dedup": OP13_SQL,
    }
