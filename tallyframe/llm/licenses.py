"""Licence scan: trained paragraph classifier with an unknown class, confirmed by templates.

Only DataFrame functions and Spark ML's JVM stages run here. Paragraphs (lines of a text)
are sparse counts of hashed 1- and 2-word grams, scored by a multinomial logistic
regression over the licence families and the class "unknown". It learns from variants of
the notices below, which lose and gain words by hash, and from a bounded sample of the
corpus' own paragraphs as unknown, without those that share most words with a notice.
A second, one-dimensional logistic regression on held-out variants and paragraphs
calibrates the probability that a paragraph is of any family at all; below KNOWN it stays
unknown. A prediction is confirmed if enough words of one of the family's notices stand
in the paragraph, or else dropped to unknown.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
FEATURES = 1 << 14
SAMPLE = 3000  # expected corpus paragraphs that stand for the unknown class
VARIANTS = 24  # of each notice
KNOWN = 0.5
CONFIRM = 0.6  # share of a notice's distinct words that must stand in the paragraph
SEED_MARK = 41

# Wordings by which the licence families are known.
NOTICES = [
    ("MIT", "released under the MIT License"),
    ("MIT", "licensed under the MIT License"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "licensed under the Apache License version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License you may obtain a copy of the License at apache org licenses LICENSE-2.0"),
    ("GPL-3.0", "this work is licensed under the GNU General Public License version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation version 3"),
    ("GPL-2.0", "this work is licensed under the GNU General Public License version 2"),
    ("LGPL", "licensed under the GNU Lesser General Public License"),
    ("AGPL", "licensed under the GNU Affero General Public License"),
    ("BSD", "released under the BSD License"),
    ("BSD", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("MPL-2.0", "this source code form is subject to the terms of the Mozilla Public License v 2.0"),
    ("CC-BY", "licensed under CC BY 4.0"),
    ("CC-BY", "this work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA", "licensed under CC BY-SA 4.0"),
    ("CC-BY-SA", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC", "licensed under CC BY-NC 4.0"),
    ("CC-BY-NC", "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0", "to the extent possible under law the author has waived all copyright dedicated to the public domain under CC0 1.0"),
    ("all-rights-reserved", "all rights reserved"),
    ("all-rights-reserved", "copyright all rights reserved no part of this work may be reproduced without permission"),
]


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, inner points and hyphens kept."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.-]+|[.-]+(?![\p{L}\p{N}])", " "))
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, paragraph, text, words) of the lines that have words."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n", -1)).alias("paragraph", "text"))
    return rows.where(F.col("text").rlike(r"[\p{L}\p{N}]")).withColumn("words", words_of(F.col("text")))


def featured(rows: DataFrame) -> DataFrame:
    pairs = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows)
    pairs = pairs.withColumn("grams", F.concat("words", "pairs"))
    return HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features").transform(pairs).drop("pairs", "grams")


def notices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(NOTICES, "family string, notice string")
    return rows.withColumn("notice_words", F.array_distinct(words_of(F.col("notice"))))


def variants(spark: SparkSession) -> DataFrame:
    """(family, variant, words): notices that lose about one word in eight, some with words before and after."""
    rows = notices(spark).select("family", "notice", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"), words_of(F.col("notice")).alias("words"))
    kept = F.filter("words", lambda w, i: (F.col("variant") == 0) | (F.pmod(F.xxhash64(w, i, F.col("variant")), F.lit(8)) > 0))
    around = F.array(*[F.lit(w) for w in ("copyright", "2020", "the", "authors", "this", "document", "is")])
    some = lambda mark: F.filter(around, lambda w, i: F.pmod(F.xxhash64(w, F.col("notice"), F.col("variant"), F.lit(mark)), F.lit(4)) == 0)
    plain = F.when(F.col("variant") % 2 == 0, kept).otherwise(F.concat(some(1), kept, some(2)))
    return rows.select("family", "variant", plain.alias("words"))


def similarity(words: Column, notice: Column) -> Column:
    return F.size(F.array_intersect(words, notice)) / F.size(notice)


def train(paras: DataFrame, total: int):
    """(classifier, calibration, families), fitted on the notices' variants and a bounded sample of paragraphs."""
    spark = paras.sparkSession
    families = sorted({f for f, _ in NOTICES})
    index = F.create_map(*[F.lit(x) for k, f in enumerate([*families, UNKNOWN]) for x in (f, float(k))])
    share = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 20))
    slot = F.xxhash64("text", "paragraph", F.lit(SEED_MARK))
    some = paras.where(F.pmod(slot, F.lit(1 << 20)) < share).select("words", slot.alias("slot"))
    for _, notice in NOTICES:
        some = some.where(similarity(F.col("words"), F.array_distinct(words_of(F.lit(notice)))) < CONFIRM)
    rows = variants(spark).select("words", "family", (F.col("variant") % 3 == 2).alias("held")).unionByName(
        some.select("words", F.lit(UNKNOWN).alias("family"), (F.pmod("slot", F.lit(1021)) % 3 == 2).alias("held"))
    )
    rows = featured(rows.withColumn("label", index[F.col("family")])).select("features", "label", "held").persist()
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40).fit(rows.where("NOT held"))
    unknown = float(len(families))
    held = evidence(model, rows.where("held").withColumn("label", (F.col("label") != unknown).cast("double")))
    both = held.agg(F.min("label"), F.max("label")).first()
    calibration = None
    if both[0] != both[1]:
        held = held.select(array_to_vector(F.array("evidence")).alias("line"), "label")
        line = LogisticRegression(featuresCol="line", regParam=1e-4, maxIter=40).fit(held)
        calibration = float(line.coefficients[0]), float(line.intercept)
    rows.unpersist()
    return model, calibration, families


def evidence(model, rows: DataFrame) -> DataFrame:
    """Adds class (the best family), p (its probability) and evidence (log odds of any family against unknown)."""
    found = model.transform(rows).withColumn("each", vector_to_array("probability"))
    last = F.element_at("each", -1)
    best = F.slice("each", 1, F.size("each") - 1)
    found = found.withColumn("p", F.array_max(best)).withColumn("class", F.array_position(best, F.col("p")).cast("int") - 1)
    return found.withColumn("evidence", F.log(F.greatest(1 - last, F.lit(1e-9)) / F.greatest(last, F.lit(1e-9))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence paragraph: id, paragraph (line number from 0), family, probability, template_share, text.

    Every line of every text is scored. Null and empty texts and lines without letters or
    digits give no rows; ids may be null; repeated rows are reported each. Other columns
    are not read; an empty table gives no rows.
    """
    paras = paragraphs(docs, id_col, text_col)
    model, calibration, families = train(paras, paras.count())
    if calibration is None:  # no paragraph to stand for the unknown class: nothing to scan
        calibration = 1.0, 0.0
    scored = evidence(model, featured(paras))
    known = 1 / (1 + F.exp(-(F.col("evidence") * calibration[0] + calibration[1])))
    names = F.array(*[F.lit(f) for f in families])
    found = scored.withColumn("probability", known).where(F.col("probability") >= KNOWN)
    found = found.select("doc", "paragraph", "text", "words", "probability", F.get(names, F.col("class")).alias("family"))
    # the best notice of the family, worked out in the row, so that repeated rows stay apart
    shares = [F.when(F.col("family") == f, similarity(F.col("words"), F.array_distinct(words_of(F.lit(n))))).otherwise(0.0) for f, n in NOTICES]
    out = found.withColumn("template_share", F.greatest(*shares)).where(F.col("template_share") >= CONFIRM)
    return out.select(F.col("doc").alias(id_col), F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", "template_share", "text")
