"""Corpus pipeline: quality rules, near-duplicate removal, secret scan, mixture, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. ``run`` stores every
stage's rows in the shared folder and hands them to the next. Rejected documents and near copies go, secrets are masked, the
mixture repeats or leaves out documents, and the last stage returns the ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopledger.llm import fertility, mixture, prefixtree, secretscan, viterbi
from shopledger.llm.common import ship, table, written
from shopledger.llm.queries import FERTILITY_MODEL, PIECE_MODEL

FACTS = "__fertility_facts"
#: The stages use tokenizers, a fitted classifier and draws, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands."""
    ship(spark)
    rows = written(docs.withColumn(FACTS, fertility.facts(F.col("text"), FERTILITY_MODEL)), "quality")
    return fertility.judged(rows, FACTS).filter(fertility.KEPT).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every component."""
    ship(spark)
    return prefixtree.without_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    ship(spark)
    return secretscan.masked(docs, secretscan.fit(secretscan.practice(spark))).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    ship(spark)
    return mixture.repeated(docs, mixture.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document (a row per copy), and whether decoding gives its text back."""
    ship(spark)
    return viterbi.encode(docs, PIECE_MODEL).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "restored")


STAGES = [("quality", quality), ("near_copies", near_copies), ("secret_scan", secret_scan), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
