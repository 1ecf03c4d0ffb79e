"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import centroids, filteraudit, language, lmscore, mixing, pieces, pii, simhash, substring, syncmers, tokenfiles, topk, toxicity
from tessera.llm._common import table


def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in training order, with the places that a document takes."""
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_position", "second_position"]
    return mixing.in_order(mixing.mixed(table(spark, sf_dir, "documents"))).select(columns)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled of good quality; background: all documents."""
    return lmscore.scored(table(spark, sf_dir, "documents"), lmscore.target_of(table(spark, sf_dir, "labels")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encoded(table(spark, sf_dir, "documents")))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings")).drop("compared")


QUERIES = {
    "op3_lm_scoring": op3_lm_scoring,
    "op2_exact_top_k": op2_exact_top_k,
    "op4_pii": op4_pii,
    "op8_token_files": op8_token_files,
    "op10_sentencepiece": op10_sentencepiece,
    "op1_mixing_sources": op1_mixing_sources,
    "op6_toxicity": op6_toxicity,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op7_substring_dedup": op7_substring_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op11_language_id": op11_language_id,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE: dict[str, str] = {
    "op2_exact_top_k": topk.ORACLE,
    "op1_mixing_sources": mixing.ORACLE,
    "op7_substring_dedup": substring.ORACLE,
    "op12_filter_interaction_audit": filteraudit.ORACLE,
    "op13_centroid_clustering": centroids.ORACLE,
}
