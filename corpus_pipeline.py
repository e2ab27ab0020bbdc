"""Cleaning and packing of a corpus: stages of the numbered operators, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.exact_dedup import drop_copies
from tidegrid.llm.jaccard_join import one_of_each
from tidegrid.llm.queries import packed
from tidegrid.llm.ranking import fit_quality, with_quality
from tidegrid.llm.store import free_name, store, table
from tidegrid.llm.supervised import remainder
from tidegrid.llm.toxicity import fit_toxicity, with_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees don't call toxic."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    name = free_name(docs, "score")
    return with_toxicity(docs, model, name=name).filter(F.col(name) < 0.5).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that rank above the quantile of bad ones."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    name = free_name(docs, "score")
    return with_quality(docs, model, name=name).filter(F.col(name) >= 0.7).drop(name)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: five words to a shingle, similarity of 0.8 or more."""
    return one_of_each(docs, width=5, num=80, den=100)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("packing", packing)]

#: Trained scores, byte-pair ids and greedy packing have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
