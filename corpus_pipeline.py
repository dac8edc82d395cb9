"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame; all but the last return the columns of documents.

Of all stages: null ids stay null and never make rows one; null and empty texts are
texts without words; very long texts are read whole; repeated rows each get their
verdict; ties go as the operators' modules say; extra columns pass through untouched,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common, jaccard, language, packing, quality, substrings
from textloom.llm.common import Workspace

#: Least share of a text's n-grams that its language's filter must have.
MIN_COVERAGE = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (null and empty texts among them); lines over their host's limit are cut from the others. A null source is a host of its own."""
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go; without any label all go. Learns from the labelled documents themselves."""
    filters = language.learn(docs)
    judged = language.predict(docs, filters, names=("__lang", "__score", "__cover"))
    return judged.where((F.col("__lang") != "und") & (F.col("__cover") >= MIN_COVERAGE)).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, the one with the least id stays, with all rows of that id; documents without words or id stay."""
    return jaccard.keep_one(docs, shingle=5, num=80, den=100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that a document with a smaller id has are cut; documents left empty by that go. Rows with equal ids are one document."""
    return substrings.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, each with every source's share. An empty text is its end id; a null source is a queue of its own."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup), ("packing", pack)]

#: SQL can't express the language filters and the tokenizer; tests/llm holds each stage against plain Python on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        mark = common.made()
        docs = ws.write(stage(spark, docs, sf_dir), name)
        common.release(mark)  # what the stage wrote for itself
        if i:
            ws.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
