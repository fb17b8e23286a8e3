"""Components by rounds of stars: equal to a plain search, and no round more than the edges need."""

from __future__ import annotations

import numpy as np
import pytest

from tallyframe.llm import ngram_join
from tallyframe.llm.common import Scratch, components


@pytest.fixture
def written(monkeypatch):
    """Labels of the scratch tables written since the test began."""
    labels, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, label, *args: labels.append(label) or keep(self, df, label, *args))
    return labels


def searched(edges):
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def found(spark, edges):
    scratch = Scratch(spark)
    rows = components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    scratch.drop(*list(scratch.names))
    return {r["node"]: r["component"] for r in rows}


def test_equal_to_a_search(spark):
    rng = np.random.default_rng(5)
    chain = [(k, k + 1) for k in range(100, 120)]
    edges = [(int(a), int(b)) for a, b in rng.integers(-30, 30, (28, 2))] + chain + chain[:3] + [(7, 7), (None, 3), (4, None)]
    assert found(spark, edges) == searched(edges)


def test_stars_take_no_round(spark, written):
    edges = [(1, 2), (3, 1), (1, 3), (5, 9), (8, 5), (2, 2)]
    assert found(spark, edges) == {1: 1, 2: 1, 3: 1, 5: 5, 8: 5, 9: 5}
    assert written == ["cc_0"]
    assert found(spark, []) == {}


def test_join_ends_where_no_region_is_open(spark, written):
    word = [f"w{v}" for v in np.random.default_rng(1).integers(0, 9000, 400)]
    texts = [" ".join(word[:90]), " ".join(word[:88]), " ".join(word[100:180]), " ".join(word[100:179]), " ".join(word[200:290])]
    out = ngram_join.ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert "near" in written and "near2" not in written and sum(x.startswith("cc_") for x in written) == 1
