"""The queries of this package over the given tables, with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm import bpe_codec, decontaminate, fill_middle, language_model, line_dup, near_dup, pivot_clusters, quality, secrets, suffix_dup, token_automaton, toxicity, url_templates

QUERIES = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_byte_bpe_codec(spark: SparkSession, root: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, root, "documents"), digests=True)


@query
def op6_token_automaton(spark: SparkSession, root: str) -> DataFrame:
    return token_automaton.count_tokens(table(spark, root, "documents"))


@query
def op5_prob_minhash(spark: SparkSession, root: str) -> DataFrame:
    return near_dup.classes(table(spark, root, "documents")).select("doc_id", "class_id")


@query
def op4_fuzzy_lines(spark: SparkSession, root: str) -> DataFrame:
    """One row for each document: which of its lines go, and the document and line that stay instead."""
    found = line_dup.duplicate_lines(table(spark, root, "documents"))
    gone = F.col("removed")
    return found.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone["line"].alias("removed_lines"), gone["kept_doc"].alias("kept_docs"), gone["kept_line"].alias("kept_lines"))


@query
def op2_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality.quality(table(spark, root, "documents"))


SQL["op2_quality_rules"] = quality.SQL


@query
def op10_simhash_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    found = decontaminate.contaminated(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), "similarity")


SQL["op10_simhash_decontamination"] = decontaminate.SQL


@query
def op1_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    spans = F.col("spans")
    counts = [secrets.counted(spans, kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    found = secrets.scan(table(spark, root, "documents"))
    return found.select("doc_id", *counts, F.sha2(secrets.listed(spans, 3), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"))


@query
def pipeline(spark: SparkSession, root: str) -> DataFrame:
    return corpus_pipeline.run(spark, root)


@query
def op7_toxicity_cnn(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.score(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op9_attention_lm(spark: SparkSession, root: str) -> DataFrame:
    return language_model.score(table(spark, root, "documents"))


@query
def op3_repeated_strings(spark: SparkSession, root: str) -> DataFrame:
    return suffix_dup.repeated_bytes(table(spark, root, "documents")).drop("kept")


@query
def op13_fill_in_middle(spark: SparkSession, root: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, root, "documents"), digests=True)


SQL["op13_fill_in_middle"] = fill_middle.SQL


@query
def op12_ptolemaic_clusters(spark: SparkSession, root: str) -> DataFrame:
    return pivot_clusters.clusters(table(spark, root, "embeddings"))


SQL["op12_ptolemaic_clusters"] = pivot_clusters.SQL


@query
def op11_url_templates(spark: SparkSession, root: str) -> DataFrame:
    return url_templates.judge(table(spark, root, "pages"))


SQL["op11_url_templates"] = url_templates.SQL
