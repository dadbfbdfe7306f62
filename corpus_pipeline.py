"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next stage's
docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlab.llm.chosen_path import deduplicate
from sessionlab.llm.common import stage
from sessionlab.llm.decontaminate import decontaminate
from sessionlab.llm.language_id import UNKNOWN, fit, predict, remainder
from sessionlab.llm.line_dedup import line_dedup
from sessionlab.llm.queries import TOKENIZERS
from sessionlab.llm.sentencepieces import encode, read_model

#: A document whose language is less sure than this is rejected.
MIN_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with MIN_SCORE at least; lang stays as it was."""
    net = fit(docs.where(remainder(4) != 2).select("doc_id", "text", "lang"))
    told = predict(docs, net, [F.col(c) for c in docs.columns])
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that are boilerplate of their source."""
    return line_dedup(docs).drop("n_lines", "n_dropped").withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones."""
    return deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether decoding them gave the text back."""
    return encode(docs, read_model(f"{TOKENIZERS}/piece_bpe_32k.model"), ["doc_id", "source", "lang"])


STAGES = [("language_id", identify_language), ("line_dedup", drop_boilerplate), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("sentencepiece", tokenize)]

#: The first stage is a trained network and the last a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
