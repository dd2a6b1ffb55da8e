"""The registered queries of the operators, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (decontaminate, divergence, jaccard_join, langid, line_dedup, merkle, mixing, packing, quality, sharding,
                            suffix_dedup, token_counts, toxicity)
from tallyframe.llm import sql
from tallyframe.llm.store import documents, fold, table

SHARDS = 24
SEED = 20240229


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 4) == 2)
    model = langid.fit(docs.filter(~F.coalesce("held_out", F.lit(False))).select("lang", "text"))
    return langid.predict(docs, model)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir), jaccard_join.Similarity(words=3, percent=90))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    sample = (labels.withColumn("draw", F.xxhash64("doc_id", F.lit(SEED))).orderBy("draw", "doc_id")
              .limit(toxicity.SAMPLE))
    model = toxicity.fit(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    return toxicity.score(docs, model)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits", "byte_bits",
        "pair_bits", "order_bits", "perplexity")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.read_vocabulary(token_counts.VOCABULARY)
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), short_items=True)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), F.xxhash64("text").alias("_h"))
    placed = sharding.shard(rows, [F.col("doc_id").asc_nulls_last(), F.col("_h"), F.col("size")], SHARDS, SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(mixing.measure(documents(spark, sf_dir)))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir), with_text=True)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_jaccard_join, op3_toxicity, op4_suffix_dedup, op5_quality, op6_token_counts,
                                  op7_decontamination, op8_sharding, op9_mixing, op10_line_dedup, op11_source_divergence,
                                  op12_best_fit_packing, op13_merkle_manifest)}
ORACLE_SQL: dict[str, str] = {"op11_source_divergence": sql.DIVERGENCE, "op13_merkle_manifest": sql.MERKLE}
