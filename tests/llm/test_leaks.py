"""Recall of benchmark items by length and number, against where they were put."""

from __future__ import annotations

import numpy as np
import pytest

from tallyframe.llm import decontaminate as D
from tallyframe.llm.common import read_table


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").where("length(text) > 400").orderBy("doc_id").collect()
    return [r["text"].split() for r in rows]


def index_of(items, texts):
    df = np.zeros(1 << D.BITS, np.int64)
    for t in texts:
        df[np.unique(D.names_of(" ".join(t)) & (1 << D.BITS) - 1)] += 1
    idf = np.log((len(texts) + 1) / (df + 1)) + 0.1
    found = []
    for part in D._spaces(items):
        index = D.Index(part, idf)
        index.finish(np.zeros((len(index.vocabulary), 0)))
        found.append(index)
    return found


@pytest.mark.parametrize("size", [3, 4, 6, 8, 10, 15, 20, 30, 31, 40, 100])
def test_items_of_every_length_are_found_where_they_stand(texts, size):
    """Spans of some texts, put word by word into the middle of others."""
    g = np.random.default_rng(size)
    long = [t for t in texts if len(t) >= 250]
    spans = [t[at : at + size] for t in (long[g.integers(len(long))] for _ in range(60)) for at in [g.integers(0, len(t) - size)]]
    items = [(k, D.names_of(" ".join(s))) for k, s in enumerate(spans)]
    items = [(k, n) for k, n in items if len(n)]
    indexes = index_of(items, texts)
    for k, _ in items:
        host = long[g.integers(len(long))]
        at = int(g.integers(0, len(host)))
        found = {i for i, *_ in D.leaks_of(indexes, " ".join(host[:at] + spans[k] + host[at:]))}
        assert k in found, spans[k]


def test_the_bound_rules_no_candidate_out(texts):
    g = np.random.default_rng(1)
    items = [(k, D.names_of(" ".join(t[at : at + 40]))) for k, t in enumerate(texts[:80]) for at in [int(g.integers(0, max(len(t) - 40, 1)))]]
    for index in index_of(items, texts):
        for t in texts:
            names = D.names_of(" ".join(t))
            start, x = index.project(names)
            want = start[((x @ index.queries.T) >= D.COSINE).any(axis=1)]
            assert set(want.tolist()) <= set(index.project(names, D.COSINE)[0].tolist())


def test_a_thousand_items_are_all_found(spark, texts):
    """More items than a space has directions, of words that stand nowhere else too."""
    g = np.random.default_rng(2)
    spans = [[f"q{k}w{j}" if j % 9 == 0 else w for j, w in enumerate(t[at : at + 35])] for k in range(1000) for t in [texts[k % len(texts)]] for at in [int(g.integers(0, max(len(t) - 35, 1)))]]
    docs = [(k, " ".join(texts[(7 * k) % len(texts)][:60] + s + texts[(3 * k) % len(texts)][:60])) for k, s in enumerate(spans)]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    benchmark = spark.createDataFrame([(k, " ".join(s)) for k, s in enumerate(spans)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.benchmark_leaks(made, benchmark).collect()}
    assert {(k, k) for k in range(1000)} <= got


def test_a_very_long_item_is_searched_in_pieces(spark):
    g = np.random.default_rng(3)
    words = [f"w{v}" for v in g.integers(0, 30_000, 15_000)]
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "item_id long, text string")
    other = [f"v{v}" for v in g.integers(0, 30_000, 500)]
    docs = spark.createDataFrame([(1, " ".join(other + words[:7000])), (2, " ".join(other))], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.benchmark_leaks(docs, benchmark).collect()} == {(1, 1)}


def test_passages_are_measured_only_where_an_item_is_possible(monkeypatch):
    item = D.names_of(" ".join(f"q{k}" for k in range(60)))
    index = D.Index([(0, item)], np.ones(1 << D.BITS))
    index.finish(np.zeros((len(index.vocabulary), 0)))
    measured, lengths = [], index._lengths
    monkeypatch.setattr(index, "_lengths", lambda *a: measured.append(a) or lengths(*a))
    assert D.leaks_of([index], " ".join(f"w{k}" for k in range(500))) == [] and not measured
    found = D.leaks_of([index], " ".join([*(f"w{k}" for k in range(100)), *(f"q{k}" for k in range(60)), *(f"w{k}" for k in range(100))]))
    assert [f[0] for f in found] == [0] and found[0][2:] == (1.0, 1.0)
