"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.llm import (chat, decontamination, graph_search, language, manifest, mixing, ngram_join,
                           pii, quality, repair, repeats, sharding, tokens)
from driftline.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.personal_data(read_table(spark, sf_dir, "documents")))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(decontamination.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


SQL["op7_benchmark_decontamination"] = decontamination.CONTAMINATION_SQL


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents")).drop("text_hash")


SQL["op9_ngram_jaccard_join"] = ngram_join.JACCARD_SQL


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(*mixing.mix(read_table(spark, sf_dir, "documents")))


@query
def op5_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read_table(spark, sf_dir, "documents"))


@query
def op4_language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit_languages(docs))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"),
                                  read_table(spark, sf_dir, "labels"))


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in turns.schema}
    probe = spark.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_back(chat.chat_windows(turns.unionByName(probe)))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"))


@query
def op6_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(read_table(spark, sf_dir, "embeddings"),
                                F.col("vec_id") % 20 == 0)


@query
def op13_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tamper_check(read_table(spark, sf_dir, "documents"))


SQL["op13_dataset_manifest"] = manifest.MANIFEST_SQL


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_of_damage(read_table(spark, sf_dir, "conversations"))


@query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(repeats.repeated_passages(read_table(spark, sf_dir, "documents")))


SQL["op12_suffix_dedup"] = repeats.REPEATS_SQL


SQL["op11_conversation_repair"] = repair.REPAIR_SQL
