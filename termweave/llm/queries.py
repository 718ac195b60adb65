"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import language, media, mixing, neighbours, packing, pagetext, quality, simhash, suffixes, warc
from ._shared import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(media.stored(table(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    space = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.score(docs, space).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    back = warc.archived(pages)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(pages.schema["page_id"].dataType).alias("refers_to"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remaining(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learnable(F.col("doc_id")))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.clip_rows(media.stored(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_media": op1_media,
    "media_clips": media_clips,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_suffixes": op7_suffixes,
    "op8_pagetext": op8_pagetext,
    "op9_language": op9_language,
    "op10_neighbours": op10_neighbours,
}

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))) AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size::DOUBLE * 2.0::DOUBLE AS room
  FROM sizes
), filled AS (
  SELECT *, room / weight AS full_at,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
         sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - room AS room_before,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) + weight AS weight_left
  FROM ranked
), levels AS (
  SELECT *, (budget - room_before) / weight_left AS level FROM filled
), level AS (
  SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, source NULLS FIRST LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM level) IS NULL THEN room ELSE least(room, weight * (SELECT level FROM level)) END AS target
  FROM levels
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS words,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), laps AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM placed
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, words - epochs * source_size - start)))::BIGINT AS taken
FROM laps
"""

WARC_SQL = """
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""

ORACLES = {"op4_warc": WARC_SQL, "op3_mixing": MIXING_SQL}
