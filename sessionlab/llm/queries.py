"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlab.llm.chosen_path import similar
from sessionlab.llm.context_tree import context_tree_scores
from sessionlab.llm.decontaminate import leaks
from sessionlab.llm.golomb_dedup import EXACT_SQL, exact_dedup
from sessionlab.llm.html_extract import extract
from sessionlab.llm.language_id import language_id
from sessionlab.llm.line_dedup import LINE_SQL, line_dedup
from sessionlab.llm.pattern_tree import DIVERGENCE_SQL, divergence
from sessionlab.llm.piecewise import fingerprint_neighbours
from sessionlab.llm.sentencepieces import encode, read_model
from sessionlab.llm.substring_dedup import substring_dedup
from sessionlab.llm.suffix_dedup import suffix_dedup
from sessionlab.llm.vantage_point import CLUSTER_SQL, centroid_clusters

#: Where the public vocabularies lie; read on the driver only.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"), length=100).drop("kept")


@query("op3_substring_dedup")
def op3(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"), window=13).drop("kept")


@query("op10_language_id")
def op10(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


@query("op5_line_dedup", LINE_SQL)
def op5(spark, sf_dir):
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


@query("op2_decontaminate")
def op2(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_ngram_jaccard")
def op8(spark, sf_dir):
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op6_sentencepiece")
def op6(spark, sf_dir):
    model = read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    return encode(table(spark, sf_dir, "documents"), model, ["doc_id"]).drop("ids")


@query("op4_html_extraction")
def op4(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


@query("op9_fingerprints")
def op9(spark, sf_dir):
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


@query("op7_context_tree")
def op7(spark, sf_dir):
    return context_tree_scores(table(spark, sf_dir, "documents"))


@query("op11_centroid_clustering", CLUSTER_SQL)
def op11(spark, sf_dir):
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


@query("op12_exact_dedup", EXACT_SQL)
def op12(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op13_source_divergence", DIVERGENCE_SQL)
def op13(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))
