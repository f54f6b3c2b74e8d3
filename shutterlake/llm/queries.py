"""Registered queries of the corpus operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.binary_records import record_report
from shutterlake.llm.centroids import OP11_SQL, cluster_report
from shutterlake.llm.common import table
from shutterlake.llm.decontamination import contamination
from shutterlake.llm.exact_dedup import OP9_SQL, exact_duplicates
from shutterlake.llm.jaccard_join import OP8_SQL, near_duplicates
from shutterlake.llm.importance import OP12_SQL, resampled
from shutterlake.llm.language_id import language_held_out
from shutterlake.llm.mixing import OP5_SQL, mixture
from shutterlake.llm.secret_scan import digest, secrets
from shutterlake.llm.suffix_dedup import repeated_spans
from shutterlake.llm.token_counts import length_report
from shutterlake.llm.toxicity import toxicity
from shutterlake.llm.url_filter import Mining, judge


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secrets(table(spark, sf_dir, "documents")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), p=Mining(unlisted=None))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_report(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_repeated_words")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_held_out(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings")).drop("candidates")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_source_mixing": op5_source_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_token_records": op13_token_records,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op5_source_mixing": OP5_SQL,
    "op8_ngram_jaccard": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
