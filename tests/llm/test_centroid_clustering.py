"""Clustering by cells against a plain model, and on odd rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark import SparkContext

from tallyframe.llm import centroid_clustering as C
from tallyframe.llm.common import read_table

SCHEMA = "vec_id long, embedding array<float>, row long, cells string, x int"


def brute(rows, k=8, rounds=10):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all()]
    if not kept:
        return []
    x = np.floor(1024 * np.array([v for _, v in kept], np.float64)).astype(np.int64)
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x[n].tolist()) for n, (i, _) in enumerate(kept) if i is not None)
    cen = np.array([v for _, v in order[:k]], np.int64)
    for turn in range(rounds + 1):
        d = ((x[:, None] - cen[None]) ** 2).sum(axis=2)
        which = d.argmin(axis=1)
        if turn < rounds:
            cen = np.array([x[which == c].sum(axis=0) // (which == c).sum() if (which == c).any() else cen[c] for c in range(len(cen))])
    best = d[np.arange(len(x)), which]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cen.tolist()]
    return sorted(
        ((i, int(c), int(b), int(best[which == c].sum()), int(best.sum()), sha[c]) for (i, _), c, b in zip(kept, which, best)), key=str
    )


def test_whole_table(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    got = sorted(map(tuple, C.centroid_clustering(vectors).collect()), key=str)
    assert got == brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()])


@pytest.mark.parametrize("n", [0, 3, 40])
def test_odd_rows(spark, n):
    g = np.random.default_rng(n)
    rows = [(i, [float(np.float32(v)) for v in g.normal(size=64)]) for i in range(n)]
    rows += rows[:2] * 3  # repeated rows and ids
    same = [0.25] * 64
    rows += [(100 + i, same) for i in range(5 * (n > 3))]  # ties
    odd = [(7, None), (8, []), (9, [1.0] * 63), (10, [None] + [1.0] * 63), (11, [float("nan")] * 64), (12, [float("inf")] + [0.0] * 63)]
    rows += odd + ([(None, same)] if n else [])
    made = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA)
    got = sorted(map(tuple, C.centroid_clustering(made).collect()), key=str)
    assert got == brute(rows)


def test_cells_decide_most_and_never_wrongly():
    g = np.random.default_rng(4)
    x = C.integers(g.normal(size=(4000, 64)) / 8 + g.choice(4, size=(4000, 1)) / 4)
    cen = x[:8]
    cuts = np.quantile(x, [k / C.CELLS for k in range(1, C.CELLS)], axis=0, method="lower").astype(np.int64).T
    cells = C.cells_of(x, cuts)
    open_ = C.possible(cells, C.lookup(cen, cuts, x.min(axis=0), x.max(axis=0)))
    d = ((x[:, None] - cen[None]) ** 2).sum(axis=2)
    assert open_[d == d.min(axis=1, keepdims=True)].all()
    assert (open_.sum(axis=1) == 1).mean() > 0.5
    which, best = C.nearest(x, cen, open_)
    assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_functions_sent_to_tasks_are_small(spark, monkeypatch):
    """Larger ones become broadcast files, which stay on the disk of the driver and the executors."""
    sent = []
    broadcast = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(len(value)) or broadcast(self, value))
    g = np.random.default_rng(6)
    rows = [(i, [float(np.float32(v)) for v in g.normal(size=64)]) for i in range(60)]
    made = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA)
    got = sorted(map(tuple, C.centroid_clustering(made).collect()), key=str)
    assert got == brute(rows) and sent == []
