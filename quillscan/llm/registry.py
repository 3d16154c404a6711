"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm import ann, lang_id, mixing, near_dup, packing, quality, secrets, token_counts, url_filter, wavelet
from quillscan.llm.common import table


def op1_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, books = ann.build_index(table(spark, sf_dir, "embeddings"))
    return ann.search(index, books, index.where(F.col("vec_id") % 20 == 0).select("vec_id", "vec"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op6_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read(wavelet.write(table(spark, sf_dir, "documents")))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "pages"), lang_id.fit(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_length_histogram, op2_harmonic_packing, op3_additive_quantisation, op4_source_mixing, op5_secret_scan, op6_wavelet_files, op7_quality_cascade, op8_url_automaton, op9_probminhash, op10_language_id)}

ORACLES = {"op7_quality_cascade": quality.ORACLE, "op8_url_automaton": url_filter.ORACLE}
