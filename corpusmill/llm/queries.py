"""The operators' queries over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_sliced, exact_dedup, hard_negatives, language_id, mixing, ngram_join, packing, pii, secrets, sharding, suffixes, toxicity, whitening


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _span_columns(*kinds: str) -> list[Column]:
    """Counts of the base kinds, the digest of their spans, all spans."""
    counts = [F.size(_of("spans", kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    base = F.sha2(_joined(_of("spans", *kinds)).cast("binary"), 256)
    return [*counts, base.alias("base_sha256"), _joined(F.col("spans")).alias("spans")]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_pii_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal(_documents(spark, folder))
    return found.select("doc_id", *_span_columns("email", "ip", "card", "phone"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, folder))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(_documents(spark, folder))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_documents(spark, folder))


def op5_bit_sliced_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return bit_sliced.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = language_id.identify_documents(_documents(spark, folder))
    return found.select("doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous")


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_documents(spark, folder))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder))


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar(_documents(spark, folder), n=3, percent=90)


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_documents(spark, folder))
    return found.select("doc_id", *_span_columns("assign", "access", "hex"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.score_documents(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))  # null beyond 63 bits


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_disclosure": op1_pii_disclosure,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_balanced_shards": op4_balanced_shards,
        "op5_bit_sliced_top_k": op5_bit_sliced_top_k,
        "op6_language_id": op6_language_id,
        "op7_source_mix": op7_source_mix,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_ngram_join": op9_ngram_join,
        "op10_secret_scan": op10_secret_scan,
        "op11_toxicity": op11_toxicity,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
