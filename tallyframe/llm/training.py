"""What the two text classifiers share: the bounded training sample and FTRL steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fold_of

SAMPLE_ROWS = 8000  # expected labelled rows that a model is fitted on


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(text, y) for at most about ``rows`` labelled documents outside the held-out fold.

    Labels that are null are ignored; if an id is labelled more than once, the mean
    counts, 0.5 as 1; of documents with one id, one is taken. Ids are chosen by hash.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col(label).cast("double").alias("y"))
    given = given.where("doc IS NOT NULL AND y IS NOT NULL").where(fold_of(F.col("doc"), folds) != held_out)
    given = given.groupBy("doc").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    share = min(1.0, rows / max(given.count(), 1))
    chosen = given.where(F.pmod(F.xxhash64("doc", F.lit(label)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # The sample's size is bounded by ``rows``, so its ids may be broadcast.
    text = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    return text.join(F.broadcast(chosen), "doc").dropDuplicates(["doc"]).select("doc", "text", "y")


class Ftrl:
    """Follow-the-regularised-leader, per coordinate, with L1 and L2 terms."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        after = n + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[at] = after


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
