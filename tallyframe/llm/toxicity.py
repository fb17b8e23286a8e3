"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words without marks around them, and, for
longer words, their first four and five letters, all hashed. The score is

    sigmoid(b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2))

so that pairs of terms, such as an insult and the mention of a group, count beyond their
single weights. Single weights are learned by FTRL (L1-sparse), factors by AdaGrad with
L2 decay, on a bounded sample of labelled rows in one task. Terms get weights if they
are in at least MIN_ROWS rows of the sample and as often in toxic ones, or as seldom, as
chance would hardly have it (MIN_DEVIATION standard deviations); without that choice the
factors of thousands of chance terms learn the sample by heart.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fold_of
from tallyframe.llm.training import SAMPLE_ROWS, Ftrl, labelled_sample, sigmoid

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
FACTORS, EPOCHS, MIN_ROWS, MIN_DEVIATION = 6, 6, 3, 4.0
CACHE_WORDS = 200_000
BIAS = 0
_MARKS = re.compile(r"^[\W_]+|[\W_]+$")


class Terms(dict):
    """word -> hashes of its terms; emptied when it has grown to CACHE_WORDS."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        core, h = _MARKS.sub("", word.lower()), xxhash.xxh3_64_intdigest
        found = (h(core),) if core else ()
        found += tuple(h(core[:k], k) for k in (4, 5) if len(core) > k)
        self[word] = found
        return found


def terms(text: str | None, known: Terms) -> np.ndarray:
    """Distinct hashed terms of a text, ascending, led by the bias."""
    found = {t for w in set((text or "").split()) for t in known[w]}
    return np.append(np.uint64(BIAS), np.sort(np.fromiter(found, np.uint64, len(found))))


def margin(w: np.ndarray, v: np.ndarray) -> float:
    s = v.sum(axis=0)
    return float(w.sum() + 0.5 * (s @ s - (v * v).sum()))


def fit(rows: list[tuple[np.ndarray, float]], alpha: float = 1.0, l1: float = 0.1, l2: float = 0.01, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, weights and factors of a model for rows of (terms, label)."""
    none = np.empty(0, np.uint64), np.empty(0), np.empty((0, FACTORS))
    if not rows:
        return none
    names, at, count = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True, return_counts=True)
    ends = np.cumsum([0, *(len(r[0]) for r in rows)])
    toxic = np.bincount(at, np.repeat([r[1] for r in rows], np.diff(ends)), len(names))
    share = np.clip(sum(r[1] for r in rows) / len(rows), 1e-6, 1 - 1e-6)
    deviation = np.abs(toxic - count * share) / np.sqrt(count * share * (1 - share))
    common = (count >= MIN_ROWS) & (deviation >= MIN_DEVIATION) | (names == BIAS)
    lists = [at[a:b][common[at[a:b]]] for a, b in zip(ends, ends[1:])]
    model = Ftrl(len(names), alpha, 1.0, l1, l2)
    order = np.random.default_rng(1)
    v = order.normal(0, 0.005, (len(names), FACTORS))
    v[names == BIAS] = 0
    power = np.full(v.shape, 1e-2)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            i = lists[k]
            w, f = model.weights(i), v[i]
            error = sigmoid(margin(w, f)) - rows[k][1]
            model.update(i, np.full(len(i), error), w)
            g = error * (f.sum(axis=0) - f) + decay * f
            power[i] += g * g
            v[i] = f - rate * g / np.sqrt(power[i])
        v[names == BIAS] = 0
    w = model.weights()
    # A factor row acts only beside others; those still near their random start carry nothing.
    v[~common | (np.abs(v).max(axis=1) < 0.02)] = 0
    used = np.flatnonzero((w != 0) | v.any(axis=1))
    return names[used], w[used], v[used]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fitted model, whose size is bounded by the sample's."""

    def described(batches):
        known = Terms()
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "y": pdf["y"], "names": [terms(t, known).view(np.int64) for t in pdf["text"]]})

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc")
        names, w, v = fit([(n.view(np.uint64), y) for n, y in zip(pdf["names"], pdf["y"])])
        return pd.DataFrame({"name": names.view(np.int64), "w": w, "v": list(v)})

    sample = labelled_sample(docs, labels, label, folds, held_out, rows)
    found = sample.mapInPandas(described, "doc long, y double, names array<long>")
    model = found.groupBy().applyInPandas(fitted, "name long, w double, v array<double>").toPandas()
    names = model["name"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    v = np.stack(model["v"].to_list()) if len(model) else np.empty((0, FACTORS))
    return names[order], model["w"].to_numpy(np.float64)[order], v[order]


def scorer(model: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """A column function: text -> score from 0 to 1."""
    names, weights, factors = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known = Terms()
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            found = terms(text, known)
            at = np.minimum(np.searchsorted(names, found), max(len(names) - 1, 0))
            at = at[names[at] == found] if len(names) else np.empty(0, np.int64)
            out[k] = sigmoid(margin(weights[at], factors[at]))
        return pd.Series(out)

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, held_out, score and predicted.

    Null and empty texts score by the model's bias alone; where no label can be used, the
    model is empty and every score is 0.5. A null id is not held out. Only id and text are
    read; an empty table gives no rows.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    score = scorer(train(read, labels))
    return read.select(
        F.col("doc_id").alias(id_col),
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
