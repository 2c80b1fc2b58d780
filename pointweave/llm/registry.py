"""Queries of this subpackage over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, html_text, impact_search, mixing, packing, phrases, quality, residual_packing, sharding, simhash, storage, token_counts, token_files, transport_stream

END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, storage.new_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    read = token_files.read_token_files(manifest)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = transport_stream.load(transport_stream.store(table(spark, sf_dir, "documents")))
    first, last = F.get("points", F.lit(0)), F.element_at("points", -1)
    shown = F.format_string("points=%d pts=%d..%d packet=%d..%d continuity_errors=%d broken=%d sum=%d energy=%d", F.size("points"), first["pts"], last["pts"], first["packet"], last["packet"], "continuity_errors", "broken_units", "sample_sum", "sample_energy")
    return held.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        shown.alias("feature"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = quality.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return drawn.select("row.doc_id", "log_weight", "gumbel_key", "selected")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op7_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return named.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = residual_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), moved, F.col("vec_id") % 50 == 0)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OPERATORS = (op1_mixing, op2_token_files, op3_transport_stream, op4_packing, op5_quality, op6_html_text, op7_impact_search, op8_simhash, op9_sharding, op10_token_counts, op11_residual_packing, op12_hard_negatives, op13_phrases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


SEARCH_SQL = """
WITH finite AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asking AS (SELECT DISTINCT vec_id, q FROM finite WHERE vec_id % 20 = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM asking a JOIN finite b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


NEGATIVES_SQL = """
WITH finite AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT DISTINCT * FROM finite WHERE vec_id % 50 = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.q, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM anchors a JOIN finite b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id, q ORDER BY score DESC, vec_id) <= 5),
paired AS (
  SELECT p.anchor_id, p.q, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND p.q = n.q AND NOT n.same
  WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score),
ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, q, positive_id ORDER BY negative_score DESC, negative_id)::INT AS rank FROM paired)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3"""


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM split, range(1, 6) AS t(k)),
counted AS (SELECT lang, k, p, count(*) AS f FROM runs GROUP BY ALL),
words AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counted WHERE k > 1 AND f >= 100),
inner_parts AS (SELECT c.lang, c.p[i:i + m - 1] AS p, max(c.f) AS longest FROM candidates c, range(2, 5) AS t(m), range(1, 5) AS u(i) WHERE m < c.k AND i + m - 1 <= c.k GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inner_parts i ON c.lang = i.lang AND c.p = i.p WHERE i.longest IS NULL OR 100 * i.longest < 100 * c.f),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, n, cut, ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM kept c JOIN words USING (lang), range(1, 5) AS t(cut), counted x, counted y
  WHERE cut < c.k AND x.lang = c.lang AND x.p = c.p[1:cut] AND y.lang = c.lang AND y.p = c.p[cut + 1:c.k]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM lowest)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op12_hard_negatives": NEGATIVES_SQL, "op13_phrases": PHRASES_SQL, "op7_impact_search": SEARCH_SQL, "op9_sharding": sharding.oracle("doc_id", "documents")}
