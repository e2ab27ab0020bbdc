"""Bounded labelled samples for the classifiers, and the parts they share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most: those with the smallest hash of their key.
SAMPLE_ROWS = 12_000


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def known_labels(labels: DataFrame, label: str, train: Column, key: str = "doc_id") -> DataFrame:
    """(__id, y) of the keys for which ``train`` holds; rows without key or label are left out, and the largest of several labels counts."""
    known = labels.select(F.col(key).cast("long").alias("__id"), F.col(label).cast("int").alias("y"), train.alias("__train"))
    return known.filter("__id is not null and y is not null and __train").groupBy("__id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents for which ``train`` holds.

    Rows without key or label are left out; a key that has several labels counts by the largest, one that has several texts by the text of the least
    hash. So there is one row per key; the keys are bounded by ``rows`` and are broadcast to the documents.
    """
    known = known_labels(labels, label, train, key)
    some = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    return docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("text")).join(F.broadcast(some), "__id").groupBy("__id").agg(F.min_by(F.struct("text", "y"), F.struct(F.xxhash64("text"), "text")).alias("s")).select("s.text", "s.y")


def byte_profile(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256)


def share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0
