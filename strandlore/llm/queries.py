"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlore.llm import langid, license_scan, media, mixing, packing, pii, sharding, simhash, topk, warc
from strandlore.session import shared_folder
from strandlore.sources.tables import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file that is installed with the tokenizers on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "media")
    media.encode_media(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    return media.media_features(spark.read.parquet(path))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_mixing, op4_warc, op5_simhash, op6_topk, op7_pii, op8_media, op9_sharding, op10_packing)}

ORACLES = {
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper) AS again FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to FROM r""",
    "op6_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
o AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM d),
s AS (SELECT src, sum(size)::BIGINT AS words FROM o GROUP BY 1),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY src) - 1) % 3]::BIGINT AS w, 2 * words AS stop FROM s),
f AS (
  SELECT *, row_number() OVER (ORDER BY stop::DOUBLE / w, src) AS n,
         (sum(words) OVER () * 3 - coalesce(sum(stop) OVER (ORDER BY stop::DOUBLE / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)::BIGINT AS lft,
         (sum(w) OVER (ORDER BY stop::DOUBLE / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 2)::BIGINT AS opn FROM w),
g AS (SELECT *, stop * opn <= lft * w AS stopped FROM f),
h AS (SELECT lft AS l, opn AS p FROM g WHERE NOT stopped ORDER BY n LIMIT 1),
t AS (
  SELECT src, words, CASE WHEN stopped THEN stop::DOUBLE ELSE (w * l)::DOUBLE / p::DOUBLE END AS target,
         (('0x' || substr(md5('7:offset:' || src), 1, 5))::INTEGER::DOUBLE + 0.5) / 1048576.0::DOUBLE AS u
  FROM g LEFT JOIN h ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY class, k, doc_id) AS nth FROM o),
c AS (
  SELECT doc_id, size, words AS source_size, target,
         least(floor(u + (CASE WHEN words > 0 THEN target / words ELSE 0 END) * nth)
             - floor(u + (CASE WHEN words > 0 THEN target / words ELSE 0 END) * (nth - 1)), 2)::INTEGER AS copies
  FROM r JOIN t USING (src))
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c""",
}
