"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilrow.llm import (
    decontaminate, langid, lempelziv, licenses, neardup, negatives, packing, periodic, pii, sharding, substring, tokens, tokenstore, toxicity,
)
from vigilrow.llm.common import crc_fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_fold("doc_id", 4) != 2))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (F.coalesce(crc_fold("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels.where(crc_fold("doc_id", 5) != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (F.coalesce(crc_fold("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_lempel_ziv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempelziv.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def byte_encoder() -> tokens.Encoder:
    import public_tokenizers

    return tokens.byte_level(public_tokenizers.path("byte_bpe_50k.json"))


def op5_wavelet_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenstore.write(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_encoder, end_id=0)
    return tokenstore.digest(spark, path)


def op6_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def word_encoder(**options) -> tokens.Encoder:
    import public_tokenizers

    return tokens.word_level(public_tokenizers.path("word_bpe_49k.json"), **options)


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), word_encoder, end_id=2)


def op8_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.digest(licenses.scan(docs, licenses.template_idf(docs)))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op11_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, lambda ident: ident % 100 == 0, label=label)


def op12_maximal_pair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.periodic_runs(periodic.with_planted_tails(docs)))


def op13_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_toxicity, op3_minimax_shards, op4_lempel_ziv_fingerprint, op5_wavelet_token_store, op6_fm_index_dedup, op7_retrieval_packing, op8_minmax_near_duplicates, op9_license_scan,
        op10_benchmark_decontamination, op11_strassen_hard_negatives, op12_maximal_pair_runs, op13_deobfuscated_pii,
    )
}
#: SQL twins of those that have a short one; tests compare the others with brute force.
ORACLE: dict[str, str] = {
    "op11_strassen_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS "rank",
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY "rank" <= 5
""",
}
