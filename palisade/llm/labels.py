"""Labelled rows for classifiers: a bounded, deterministic sample, and the held-out folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fold(doc_id, parts: int):
    """crc32 of the doc_id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def sample(labels: DataFrame, label: str, parts: int, held: int, bound: int) -> DataFrame:
    """At most ``bound`` rows (doc_id, label) whose fold is not ``held``, the least by a hash.

    Rows without id or label are left out; of several labels of one id the largest counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    rows = rows.where(fold("doc_id", parts) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def sampled_docs(docs: DataFrame, rows: DataFrame, bound: int) -> DataFrame:
    """The texts (doc_id, text, label) of a sample of at most ``bound`` rows, which is broadcast.

    One text is taken for an id with several rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = d.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    return got.select("doc_id", "text", "label").limit(bound)


def auc(score, label) -> float:
    """The area under the ROC curve, ties counted as half."""
    import numpy as np

    score, label = np.asarray(score, float), np.asarray(label)
    _, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    pos = int((label == 1).sum())
    neg = len(label) - pos
    return float((rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else float("nan")
