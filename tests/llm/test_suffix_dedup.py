"""Removal of repeated strings of bytes against a plain model, and on odd rows."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest

from tallyframe.llm.common import read_table
from tallyframe.llm.suffix_dedup import Blocks, REACH, suffix_dedup

SPAN = 400


def brute(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter()
    named = []
    for _, raw in raws:
        keys = [hashlib.blake2b(raw[s : s + SPAN], digest_size=16).digest() for s in range(len(raw) - SPAN + 1)]
        count.update(keys)
        named.append(keys)
    out = []
    for (i, raw), keys in zip(raws, named):
        gone = np.zeros(len(raw), bool)
        end = 0
        for s, key in enumerate(keys):
            if count[key] > 1:
                gone[max(s, end) : s + SPAN] = True
                end = s + SPAN
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def result(docs):
    return sorted(((*r[:5], bytes(r[5])) for r in map(tuple, suffix_dedup(docs).collect())), key=str)


def words(g, n):
    return " ".join("".join(chr(97 + c) for c in g.integers(0, 26, g.integers(1, 9))) for _ in range(n))


def test_whole_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    assert result(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_repeats_of_every_length_and_place(spark):
    g = np.random.default_rng(3)
    rows, n = [], 0
    for size in (399, 400, 401, 420, 447, 448, 500, 800, 2000):
        passage = words(g, 700)[:size]
        for before, after in ((0, 50), (300, 0), (700, 700)):
            rows.append((n, words(g, 200)[:before] + passage + words(g, 200)[:after]))
            n += 1
        rows.append((n, passage[7:] + words(g, 100)))  # a part of it, cut at another place
        n += 1
    assert len({len(t) for _, t in rows}) > 10
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and any(r[2] for r in got)


def test_odd_rows(spark):
    g = np.random.default_rng(5)
    base, long = words(g, 300), words(g, 30_000)
    near = base[:900] + "X" + base[901:]
    rows = [
        (1, base), (2, base), (2, base), (None, base), (3, near), (4, None), (5, ""), (None, None), (6, "short"), (7, "a" * 2000), (8, "ab" * 900),
        (9, "a" * 399), (10, "b" * 399), (11, "b" * 400), (12, "c" * 401), (13, long), (14, long[50_000:60_000] + base[:450]), (15, "é" * 450 + base[5:]),
        (16, "é" * 300), (17, "xyz" * 133 + "x"), (18, "xyz" * 134 + base), (19, words(g, 500)),
    ]
    made = spark.createDataFrame([(i, t, 1, 2, "d") for i, t in rows], "doc_id long, text string, cls long, m long, digest string")
    assert result(made) == brute(rows)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("kind", ["words", "same", "period"])
def test_equal_strings_are_cut_alike(kind):
    g = np.random.default_rng(7)
    raw = {"words": words(g, 400), "same": "q" * 3000, "period": "abcdefg" * 400}[kind].encode()
    one, two = Blocks(raw, SPAN), Blocks(words(g, 30).encode() + raw, SPAN)
    shift = two.size - one.size
    assert (two.cuts[two.cuts >= shift] - shift).tolist() == one.cuts.tolist()
    assert np.diff(one.cuts).max() <= REACH
