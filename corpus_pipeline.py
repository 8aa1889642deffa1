"""From raw documents to shards: the pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the documents of the next one.  Stages that drop rows pass all others through where they
are read (`without`): what is shuffled are the dropped texts and, beyond eight million dropped rows,
the growing share that the bitmap of 16 MB then marks in vain.

Edge cases are those of the operators.  Rows are told apart by id and text, so rows that share an
id are judged one by one; of rows that share both the first by its JSON text stays.  Other columns,
whatever their names, pass the stages that drop rows.  A stage whose documents are all dropped
hands an empty table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import decontamination, language, mixing, ngram_join, sharding
from driftline.llm.common import Scratch, once_each, read_table, without


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that holds a third of them, go."""
    return language.known_language(docs, language.fit_languages(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the smallest id."""
    found = ngram_join.ngram_components(docs)
    kept = without(docs, ngram_join.one_of_each(found))
    again = found.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1")
    if again.isEmpty():
        return kept
    return once_each(kept, again.select("doc_id", "text_hash"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("n_hit > 0").select("doc_id", "text_hash").distinct())


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, none to two times each, so that sources reach their targets."""
    return mixing.mix_documents(docs)


def balanced_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix."""
    return sharding.balanced_shards(docs, keep=("lang", "source", "n_chars"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("balanced_sharding", balanced_sharding),
]
#: Learned languages and drawn documents have no SQL form; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return scratch.result(docs, "pipeline")
