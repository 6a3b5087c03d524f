"""The thin queries over the operators, by the contracts of their digests, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, fingerprints, licenses, lm, media, mixing, neardup, negatives, pii, prefixtrees, quality, quantised, suffixes
from .common import crc32_of_id, documents, load


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(spark, load(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), width=4)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.scored(docs, quality.fit(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_of_id("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op11_prefix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrees.deduplicated(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.coded(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scans, op2_document_fingerprints, op3_media_columns, op4_minhash_near_dedup, op5_pii, op6_suffix_array_dedup, op7_lm_scoring, op8_bpe, op9_quality_classifier, op10_mixing, op11_prefix_tree_dedup, op12_hard_negatives, op13_vector_codes)
}

OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('{mixing.SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * {float(mixing.MOST)}::DOUBLE AS cap FROM per
), filled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * {mixing.SHARE}::DOUBLE
             - COALESCE(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), goal AS (
  SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap ELSE max(CASE WHEN cap / weight > level THEN level END) OVER () * weight END AS target FROM filled
), measured AS (
  SELECT source, CAST(floor(sqrt(sqrt(size::DOUBLE)) * {mixing.MEASURE}) AS BIGINT) AS m, CAST(sum(size) AS BIGINT) AS words FROM sized WHERE size > 0 GROUP BY 1, 2
), levels AS (
  SELECT source, m, CAST(COALESCE(sum(words) OVER (PARTITION BY source ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
         CAST(sum(words * m) OVER (PARTITION BY source ORDER BY m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM measured
), solved AS (
  SELECT l.source, m, (g.target - {float(mixing.MOST)}::DOUBLE * capped) / rest AS rate FROM levels l JOIN goal g ON l.source IS NOT DISTINCT FROM g.source
), rates AS (
  SELECT source, arg_max(rate, m) AS rate FROM solved WHERE rate * m <= {mixing.MOST} GROUP BY source
), expected AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN s.size > 0 THEN least({mixing.MOST * mixing.COPY},
           COALESCE(CAST(floor(r.rate * CAST(floor(sqrt(sqrt(s.size::DOUBLE)) * {mixing.MEASURE}) AS BIGINT) * {mixing.COPY}) AS BIGINT), {mixing.MOST * mixing.COPY})) ELSE 0 END AS e
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
), split AS (
  SELECT *, e // {mixing.COPY} AS whole, e % {mixing.COPY} AS part, (e % {mixing.COPY}) / {float(mixing.COPY)}::DOUBLE AS p FROM expected
), odds AS (
  SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM split
), quota AS (
  SELECT source, CAST(sum(CASE WHEN size >= {mixing.LONG} THEN part * size ELSE 0 END) AS BIGINT) / {float(mixing.COPY)}::DOUBLE AS long_words, any_value(target) - CAST(sum(whole * size) AS BIGINT) AS missing FROM odds GROUP BY source
), long_drawn AS (
  SELECT o.*, COALESCE(sum(o.size) OVER (PARTITION BY o.source ORDER BY o.odds, o.size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + o.size / 2.0::DOUBLE <= q.long_words AS drawn
  FROM odds o JOIN quota q ON o.source IS NOT DISTINCT FROM q.source WHERE o.part > 0 AND o.size >= {mixing.LONG}
), got AS (
  SELECT source, sum(size) AS got FROM long_drawn WHERE drawn GROUP BY source
), short_drawn AS (
  SELECT o.*, COALESCE(sum(o.size) OVER (PARTITION BY o.source ORDER BY o.odds, o.size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + o.size / 2.0::DOUBLE
         <= greatest(q.missing - COALESCE(g.got, 0), 0.0::DOUBLE) AS drawn
  FROM odds o JOIN quota q ON o.source IS NOT DISTINCT FROM q.source LEFT JOIN got g ON o.source IS NOT DISTINCT FROM g.source WHERE o.part > 0 AND o.size < {mixing.LONG}
), drawn AS (
  SELECT * FROM long_drawn UNION ALL SELECT * FROM short_drawn UNION ALL SELECT *, FALSE FROM odds WHERE part = 0
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN drawn THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn
"""

OP11_SQL = f"""
WITH cut AS (
  SELECT row_number() OVER () AS num, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT num, doc_id, s, array_to_string(list_slice(words, s, s + {prefixtrees.WINDOW - 1}), ' ') AS win
  FROM (SELECT num, doc_id, words, unnest(generate_series(1, len(words) - {prefixtrees.WINDOW - 1})) AS s FROM cut)
), owned AS (
  SELECT num, s FROM (SELECT num, doc_id, s, min(doc_id) OVER (PARTITION BY win) AS owner FROM starts) WHERE owner < doc_id
), gone AS (
  SELECT DISTINCT num, s + k AS j FROM owned, (SELECT unnest(generate_series(0, {prefixtrees.WINDOW - 1})) AS k)
), each AS (
  SELECT num, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM cut
), left_over AS (
  SELECT e.num, string_agg(word, ' ' ORDER BY e.j) AS kept, count(*) AS n FROM each e ANTI JOIN gone g ON e.num = g.num AND e.j = g.j GROUP BY e.num
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM cut c LEFT JOIN left_over l ON c.num = l.num
"""

OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor({negatives.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), negative AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""


def _op13_sql() -> str:
    """The codebooks' rounds as one chain of tables, from books0 to the last."""
    q = quantised
    each = f"SELECT unnest(generate_series(1, {q.PARTS})) AS part"
    steps = [
        f"""rows AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({q.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, part, list_slice(v, (part - 1) * (len(v) // {q.PARTS}) + 1, part * (len(v) // {q.PARTS})) AS x FROM rows, ({each})
), books0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM parts QUALIFY entry < {q.ENTRIES}
)"""
    ]
    for r in range(q.ROUNDS + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
  SELECT vec_id, label, p.part, entry, x, CAST(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS error
  FROM parts p JOIN books{r} b ON p.part = b.part QUALIFY row_number() OVER (PARTITION BY vec_id, p.part ORDER BY error, entry) = 1
)"""
        )
        if r < q.ROUNDS:
            steps.append(
                f"""means{r} AS (
  SELECT part, entry, list(mean ORDER BY place) AS e FROM (
    SELECT part, entry, place, CAST(CASE WHEN sum(c) >= 0 THEN sum(c) // count(*) ELSE -((count(*) - 1 - sum(c)) // count(*)) END AS BIGINT) AS mean
    FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS place FROM near{r}) GROUP BY part, entry, place
  ) GROUP BY part, entry
), books{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, COALESCE(m.e, b.e) AS e FROM books{r} b LEFT JOIN means{r} m ON b.part = m.part AND b.entry = m.entry
)"""
            )
    last = q.ROUNDS
    steps.append(
        f"""coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM near{last} GROUP BY vec_id, label
), digest AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books{last}
)"""
    )
    return "WITH " + ", ".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"


ORACLES: dict[str, str] = {
    "op1_license_scans": licenses.scan_sql(),
    "op10_mixing": OP10_SQL,
    "op11_prefix_tree_dedup": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_vector_codes": _op13_sql(),
}
