"""A training-data pipeline over `documents`: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import fmindex, linededup, minhash, packing, toxicity
from skein.llm.common import save, table
from skein.llm.queries import vocabulary


def _same_columns(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    n = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return changed.select(*[n.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go."""
    tagger = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, tagger)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go, and documents of which nothing is left."""
    return _same_columns(linededup.dedup_lines(docs, report=False), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays (five-word shingles, similarity 0.8)."""
    return minhash.drop_near_duplicates(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that occur in a benchmark item go; the rest of the document stays."""
    return _same_columns(fmindex.remove(docs, table(spark, sf_dir, "benchmark")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: Learned scores, hash classes and a packing can't be written as SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
