"""Copies go by id and text, whatever other columns are called."""

from __future__ import annotations

import numpy as np

from tallyframe.llm.ngram_join import ngram_jaccard_join, one_of_each_group


def words(seed):
    return [f"w{v}" for v in np.random.default_rng(seed).integers(0, 9000, 80)]


def test_a_text_that_shares_its_id_with_a_copy_stays(spark):
    a, c, d = (" ".join(words(k)) for k in range(3))
    rows = [(1, a), (2, a), (2, c), (3, c + " more"), (4, d), (4, d), (None, d), (5, None), (5, None), (6, " ")]
    made = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in rows], "doc_id long, text string, lost int, text_hash string, lost_text int")
    out = one_of_each_group(made)
    assert out.columns == made.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (2, c), (4, d), (None, d), (5, None), (5, None), (6, " ")], key=str)


def test_every_group_keeps_a_member(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    joined = ngram_jaccard_join(docs).cache()
    kept = one_of_each_group(docs).select("doc_id").join(joined, "doc_id")
    assert kept.select("component_id").distinct().count() == joined.select("component_id").distinct().count()


def test_an_empty_table(spark):
    assert one_of_each_group(spark.createDataFrame([], "doc_id long, text string")).count() == 0
