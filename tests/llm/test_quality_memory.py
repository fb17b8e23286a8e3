"""The model's features are numbered with little memory beside them."""

from __future__ import annotations

import tracemalloc

import numpy as np

from tallyframe.llm import quality


def test_fit_holds_little_beside_its_features(monkeypatch):
    rng = np.random.default_rng(3)
    names = np.sort(rng.integers(0, 1 << 62, 200_000, np.int64).view(np.uint64))[rng.integers(0, 200_000, 3_000_000)]
    ends = np.arange(0, len(names) + 1, 50_000)
    monkeypatch.setattr(quality, "EPOCHS", 1)
    tracemalloc.start()
    name, w = quality.fit(names, np.ones(len(names), np.float32), ends, np.arange(len(ends) - 1) % 2.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(name) == len(w) > 0
    assert most < 3 * names.nbytes


def test_numbers_equal_those_of_unique():
    names = np.random.default_rng(4).integers(0, 5000, 10_007).astype(np.uint64) * np.uint64(3_000_000_000_000_000)
    known, at = quality.numbered(names, piece=999)
    want, places = np.unique(names, return_inverse=True)
    assert (known == want).all() and (at == places).all() and at.dtype == np.int32
