"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import ann, decontam, jaccard, langid, mixing, quality, secret_scan, sharding, token_counts, warc

#: Labels of a classifier are learned where crc32 of the id as text, modulo this, is not `held`.
LANG_FOLDS, LANG_HELD = 3, 1
QUALITY_FOLDS, QUALITY_HELD = 5, 0
QUALITY_THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20).withColumnRenamed("id", "vec_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024, budgets=(1024,))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs, F.coalesce(fold("doc_id", LANG_FOLDS) != LANG_HELD, F.lit(False)))
    return langid.identify(docs, net).select("doc_id", F.coalesce(fold("doc_id", LANG_FOLDS) == LANG_HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 5, 75, 100).drop("text_hash")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("id", QUALITY_FOLDS) != QUALITY_HELD)
    return quality.score(docs, model).select("doc_id", F.coalesce(fold("doc_id", QUALITY_FOLDS) == QUALITY_HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_nearest, op2_decontamination, op3_secrets, op4_mixing, op5_token_counts, op6_language, op7_sharding, op8_ngram_join, op9_quality, op10_warc)}
ORACLES: dict[str, str] = {}
