"""Quality classifier: logistic regression over hashed word n-grams, learned by FTRL.

Features of a text are shares of hashed n-grams in three views of its words: the words
themselves (1 and 2 words), their shapes, that is case, length class and the marks around
them (1 to 3), and which of a word's predecessors it repeats (1 to 3). A feature's value
is the square root of its share of the view. The model is fitted on a bounded sample of
labelled rows in one task, has L1-sparse weights and is scored as a sparse dot product
over the whole text of every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fold_of, free_name, mixed, release, released
from tallyframe.llm.training import SAMPLE_ROWS, Ftrl, labelled_sample, sigmoid

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
EPOCHS = 4
CACHE_WORDS, CACHE_BYTES = 200_000, 16 << 20
BIAS = 0  # the feature every text has
_AROUND = re.compile(r"^(\W*)(.*?)(\W*)$", re.DOTALL)


def word_shape(word: str) -> str:
    lead, core, tail = _AROUND.match(word).groups()
    case = (
        "" if not core else "0" if core.isdigit() else "A" if core.isupper() else "a" if core.islower()
        else "Aa" if core.istitle() else "mixed"
    )
    return f"{lead[:3]}\t{case}\t{min(len(core), 31).bit_length()}\t{tail[:3]}"


class Words(dict):
    """word -> (hash of the word, hash of its shape); emptied when it has grown to CACHE_WORDS or its words to CACHE_BYTES."""

    size = 0

    def __missing__(self, word: str) -> tuple[int, int]:
        self.size += len(word)
        if len(self) >= CACHE_WORDS or self.size >= CACHE_BYTES:
            self.clear()
            self.size = len(word)
        h = xxhash.xxh3_64_intdigest
        found = self[word] = h(word.lower()), h(word_shape(word), 7)
        return found


def features(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text and their values, by ascending hash."""
    found = (text or "").split()
    if not found:
        return np.array([BIAS], np.uint64), np.ones(1)
    h, shape = np.array([words[w] for w in found], np.uint64).T
    same = np.zeros(len(h), np.uint64)
    for back in (3, 2, 1):
        same[back:][h[back:] == h[:-back]] = back
    views = []
    for kind, (seq, sizes) in enumerate(((h, (1, 2)), (shape, (1, 2, 3)), (mixed(same + np.uint64(11)), (1, 2, 3)))):
        gram = seq
        for size in range(1, max(sizes) + 1):
            if size > 1:
                gram = mixed(gram[: len(seq) - size + 1] * np.uint64(31)) + seq[size - 1 :]
            if len(gram):
                views.append(mixed(gram + np.uint64(97 * kind + size)))
    names, values = [np.array([BIAS], np.uint64)], [np.ones(1)]
    for view in views:
        name, count = np.unique(view, return_counts=True)
        names.append(name)
        values.append(np.sqrt(count / len(view)))
    name, value = np.concatenate(names), np.concatenate(values)
    order = np.argsort(name)
    return name[order], value[order]


def numbered(names: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, ascending, and the place of each name among them, found piece by piece to hold little at once."""
    known = np.unique(names)
    at = np.empty(len(names), np.int32)
    for start in range(0, len(names), piece):
        at[start : start + piece] = np.searchsorted(known, names[start : start + piece])
    return known, at


def fit(names: np.ndarray, values: np.ndarray, ends: np.ndarray, y: np.ndarray, alpha: float = 0.5, l1: float = 0.05, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Names and weights, without zeros, of a model for rows laid end to end, row k from ends[k] to ends[k + 1]; they are taken in a fixed order."""
    if not len(y):
        return np.empty(0, np.uint64), np.empty(0)
    known, at = numbered(names)
    model = Ftrl(len(known), alpha, 1.0, l1, l2)
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in order.permutation(len(y)):
            i, x = at[ends[k] : ends[k + 1]], values[ends[k] : ends[k + 1]].astype(np.float64)
            w = model.weights(i)
            model.update(i, (sigmoid(float(w @ x)) - y[k]) * x, w)
    w = model.weights()
    used = np.flatnonzero(w)
    return known[used], w[used]


PIECE = 64  # rows handed on together


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The fitted model, whose size is bounded by the sample's.

    Features reach the one task that fits the model in small pieces and are held there as
    packed arrays, about 12 bytes a feature.
    """

    def described(batches):
        words = Words()
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                part = batch.slice(start, PIECE)
                both = [features(t, words) for t in part.column(2).to_pylist()]
                cut = pa.array(np.cumsum([0, *(len(n) for n, _ in both)]), pa.int32())
                name = pa.array(np.concatenate([n for n, _ in both]).view(np.int64))
                value = pa.array(np.concatenate([v for _, v in both]).astype(np.float32))
                lists = [pa.ListArray.from_arrays(cut, c) for c in (name, value)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["doc", "y", "names", "x"])

    def fitted(batches):
        names, values, sizes, y = [], [], [], []
        for batch in batches:
            names.append(batch.column(2).flatten().to_numpy().view(np.uint64).copy())
            values.append(batch.column(3).flatten().to_numpy().copy())
            sizes.append(batch.column(2).value_lengths().to_numpy())
            y.append(batch.column(1).to_numpy())
        if not y:
            return
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        names = np.concatenate(names)
        values = np.concatenate(values)
        name, w = fit(names, values, ends, np.concatenate(y))
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(w)], names=["name", "w"])

    sample = labelled_sample(docs, labels, label, folds, held_out, rows).select("doc", "y", "text")
    found = sample.mapInArrow(released(described), "doc long, y double, names array<long>, x array<float>")
    in_order = found.repartition(1).sortWithinPartitions("doc")
    model = in_order.mapInArrow(released(fitted), "name long, w double").toPandas().sort_values("name", key=lambda s: s.to_numpy().view(np.uint64))
    return model["name"].to_numpy(np.int64).view(np.uint64), model["w"].to_numpy(np.float64)


def scorer(model: tuple[np.ndarray, np.ndarray]):
    """A column function: text -> score from 0 to 1."""
    names, weights = model

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for texts in batches:
            out = np.empty(len(texts))
            for k, text in enumerate(texts):
                name, x = features(text, words)
                at = np.minimum(np.searchsorted(names, name), max(len(names) - 1, 0))
                hit = names[at] == name if len(names) else np.zeros(len(name), bool)
                out[k] = sigmoid(float(weights[at[hit]] @ x[hit]))
            yield pd.Series(out)
        words.clear()
        release()

    return F.pandas_udf(score, "double", F.PandasUDFType.SCALAR_ITER)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, held_out, score and predicted.

    Null and empty texts score by the model's bias alone. With no usable label, or all of
    one kind, the model still gives a score (0.5 where it is empty). A null id is not held
    out. Only id and text are read; an empty table gives no rows.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    score = scorer(train(read, labels))
    return read.select(
        F.col("doc_id").alias(id_col),
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier predicts as good."""
    name = free_name(docs, "quality_score")
    scored = docs.withColumn(name, scorer(train(docs.select("doc_id", F.col(text_col).alias("text")), labels))(F.col(text_col)))
    return scored.where(F.col(name) >= THRESHOLD).drop(name)


