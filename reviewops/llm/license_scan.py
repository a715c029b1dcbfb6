"""Licence scan by a trained paragraph classifier (DataFrame and ML functions only).

Paragraphs are classified by multinomial logistic regression over word
bigrams.  Training rows are word windows of the licence templates, and for the
class ``none`` lines of a bounded sample of documents (``NEGATIVES``, smallest
hashes) from blocks that name no licence.  The features are the templates' own
bigrams, a fixed list, so the model is small and bounded.

Neighbouring non-blank lines are a block; words are numbered through it, so
where lines are wrapped does not matter.  Two kinds of paragraphs are scored:
every line, and for each block and template the stretch of at most ``REACH``
times the template's words that holds most of its bigrams.

A paragraph without any template bigram has the scores of the intercept, which
is ``none``; so the corpus' bigrams are joined with the weights and only
paragraphs that hold some are scored.  The class ``unknown`` is calibrated on
held-out windows: a licence needs at least the confidence that all but 2 % of
the rightly classified windows reach.  A prediction is confirmed by comparison
with the templates: enough of some template's bigrams must be in the
paragraph, and more than of any other family's.  A line that is no ``none`` but not sure or not confirmed is
``unknown``, unless it is part of a confirmed stretch.

A family counts once per confirmed line, and once per block for a confirmed
stretch over several lines or inside a longer one.
Null texts have no paragraphs; repeated rows each get the result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewops.llm.common import row_key, text_of, written

NEGATIVES, SURE, CONFIRM = 400, 0.02, 0.6
#: A stretch spans at most this many times the words of its template, in thousandths.
REACH = 1300
NONE, UNKNOWN = "none", "unknown"
#: Notices and opening paragraphs of public licences (fixed values).
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU General Public License, version 3", "GPL version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU General Public License, version 2", "GPL version 2",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License, version 3", "LGPL version 3"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License, version 3", "AGPL version 3"),
    "BSD": ("Released under the BSD 3-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("This work is released under the CC0 1.0 Universal Public Domain Dedication.", "Licensed under CC0 1.0."),
    "Proprietary": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.",),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(words: str) -> Column:
    """Neighbouring words of a column that holds them."""
    w, n = F.col(words), F.size(words)
    pairs = F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def with_words(rows: DataFrame) -> DataFrame:
    """Adds ``words``; a one-row generator keeps the planner from splitting the text once for each use."""
    return rows.select("*", F.explode(F.array(words_of(F.col("paragraph")))).alias("words"))


def fixed_rows(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A small table from values in the program."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


def blocks(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, block, body): runs of non-blank lines."""
    return docs.select(F.col(key), F.posexplode(F.split(text, r"\n(?:[^\S\n]*\n)+")).alias("block", "body"))


def numbered(rows: DataFrame) -> DataFrame:
    """(key, block, pos, line, whole, gram): each bigram of a block, the line of its first word, whether it lies in one line."""
    lines = F.explode(F.array(F.transform(F.split("body", "\n"), words_of)))
    rows = rows.select("key", "block", lines.alias("lines"))
    on = F.flatten(F.transform("lines", lambda w, i: F.array_repeat(i, F.size(w))))
    rows = rows.select("key", "block", F.explode(F.array(F.struct(F.flatten("lines").alias("words"), on.alias("on")))).alias("b")).select("key", "block", "b.*")
    n = F.size("words")
    first, second = F.slice("on", F.lit(1), n - 1), F.slice("on", F.lit(2), n - 1)
    rows = rows.filter(n > 1).select("key", "block", F.posexplode(F.arrays_zip(bigrams("words").alias("gram"), first.alias("line"), second.alias("next"))).alias("pos", "g"))
    return rows.select("key", "block", "pos", F.col("g.line").alias("line"), (F.col("g.line") == F.col("g.next")).alias("whole"), F.col("g.gram").alias("gram"))


def templates(spark: SparkSession) -> DataFrame:
    return fixed_rows(spark, [(f, i, t) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)], ("family", "version", "paragraph"))


def windows(rows: DataFrame) -> DataFrame:
    """Every window of at least four words and at least 60 % of a template: (family, words, version)."""
    n = F.size("words")
    spans = rows.select("*", F.explode(F.sequence(F.greatest(F.least(F.lit(4), n), F.ceil(n * 0.6).cast("int")), n)).alias("len"))
    return spans.select("family", "version", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at")).select(
        "family", "version", F.slice("words", F.col("at"), F.col("len")).alias("words"))


def trained(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", negatives: int = NEGATIVES):
    """(weights by bigram, intercepts, (family, bigrams, number of words) of the templates, least confidence); weights have one value per class."""
    spark = docs.sparkSession
    classes = [NONE, *sorted(TEMPLATES)]
    told = with_words(templates(spark)).withColumn("grams", F.array_distinct(bigrams("words")))
    vocabulary = sorted({g for r in told.select("grams").collect() for g in r[0]})
    sample = docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("_t")).orderBy(F.xxhash64("_id"), "_t").limit(negatives)
    none = blocks(sample, "_id", F.col("_t")).filter(~F.col("body").rlike("(?i)licen[sc]|copyright|rights reserved"))
    none = none.select(F.explode(F.split("body", "\n")).alias("paragraph"))
    none = with_words(none).select(F.lit(NONE).alias("family"), F.lit(0).alias("version"), "words")
    rows = windows(told).unionByName(none).withColumn("grams", F.array_distinct(bigrams("words")))
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")) - 1
    rows = rows.withColumn("label", number.cast("double")).withColumn("fold", F.pmod(F.xxhash64("grams"), F.lit(5)))
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features")
    rows = counted.transform(rows).cache()
    model = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=60).fit(rows.filter("fold > 0"))
    seen = model.transform(rows.filter(F.col("fold") == 0)).filter((F.col("prediction") == F.col("label")) & (F.col("label") > 0))
    sure = seen.select(F.array_max(vector_to_array("probability")).alias("p")).agg(F.percentile_approx("p", SURE, 10_000)).first()[0]
    rows.unpersist()
    matrix = model.coefficientMatrix.toArray()
    weights = [(g, *[float(x) for x in matrix[:, i]]) for i, g in enumerate(vocabulary)]
    table = written(fixed_rows(spark, weights, ("gram", *[f"w{i}" for i in range(len(classes))])), "weights")
    known = [(r["family"], r["grams"], r["n"]) for r in told.select("family", "grams", F.size("words").alias("n")).collect()]
    return table, [float(x) for x in model.interceptVector], known, float(sure or 0.5)


def scored(held: DataFrame, by: list[str], grams: DataFrame, intercept: list[float], known: list[tuple]) -> DataFrame:
    """(by, best, confidence, likeness, other) of paragraphs given by their distinct bigrams; ``other`` is the likeness to other families."""
    classes = [NONE, *sorted(TEMPLATES)]
    sums = [F.sum(f"w{i}").alias(f"s{i}") for i in range(len(classes))]
    out = held.join(F.broadcast(grams), "gram").groupBy(*by).agg(F.collect_set("gram").alias("grams"), *sums)
    score = F.array(*[F.col(f"s{i}") + F.lit(intercept[i]) for i in range(len(classes))])
    out = out.withColumn("z", score).withColumn("top", F.array_max("z"))
    out = out.withColumn("confidence", 1.0 / F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top"))))
    out = out.withColumn("best", F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("z", F.col("top")).cast("int")))
    share = [(family, F.size(F.array_intersect("grams", F.array(*[F.lit(g) for g in has]))) / F.lit(len(has))) for family, has, _ in known]
    own = F.greatest(F.lit(0.0), *[F.when(F.col("best") == family, x).otherwise(0.0) for family, x in share])
    other = F.greatest(F.lit(0.0), *[F.when(F.col("best") != family, x).otherwise(0.0) for family, x in share])
    return out.filter(F.col("best") != NONE).withColumn("likeness", own).withColumn("other", other).select(*by, "best", "confidence", "likeness", "other")


def stretches(hits: DataFrame, known: list[tuple]) -> DataFrame:
    """(key, block, t, start, stop): per block and template the words that hold most of its bigrams, if enough and more than others there."""
    of = fixed_rows(hits.sparkSession, [(g, t, len(has), n) for t, (_, has, n) in enumerate(known) for g in has], ("gram", "t", "n_grams", "n_words"))
    found = hits.select("key", "block", "pos", "gram").join(F.broadcast(of), "gram")
    enough = F.size("grams") >= F.col("n_grams") * CONFIRM
    # most blocks hold too few of a template's bigrams anywhere
    held = found.groupBy("key", "block", "t", "n_grams").agg(F.collect_set("gram").alias("grams")).filter(enough).select("key", "block", "t")
    found = found.join(held, ["key", "block", "t"]).withColumn("at", F.floor(F.col("pos") * 1000 / F.col("n_words")))
    reach = Window.partitionBy("key", "block", "t").orderBy("at").rangeBetween(0, REACH)
    found = found.select("key", "block", "t", "n_grams", "pos", F.collect_set("gram").over(reach).alias("grams"), F.max("pos").over(reach).alias("stop")).filter(enough)
    best = F.max(F.struct(F.size("grams").alias("n"), (F.col("pos") - F.col("stop")).alias("short"), (-F.col("pos")).alias("first"))).alias("m")
    best = found.groupBy("key", "block", "t").agg(best).withColumn("start", -F.col("m.first"))
    best = written(best.select("key", "block", "t", F.col("m.n").alias("n"), "start", (F.col("start") - F.col("m.short")).alias("stop")), "best")
    # licences share words: where stretches lie over each other, the one that holds more bigrams of its template stays
    more = best.select("key", "block", *[F.col(c).alias(f"{c}_") for c in ("n", "start", "stop")])
    middle = (F.col("start") + F.col("stop")) / 2
    over = (best["key"] == more["key"]) & (best["block"] == more["block"]) & (F.col("n_") > F.col("n")) & middle.between(F.col("start_"), F.col("stop_"))
    return best.join(more, over, "left_anti").select("key", "block", "t", "start", "stop")


def classified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", negatives: int = NEGATIVES) -> DataFrame:
    """(key, block, line, family, confidence, likeness) of the lines and stretches that are not ``none``; a stretch has its first line."""
    grams, intercept, known, sure = trained(docs, doc_id, text, negatives)
    rows = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), text_of(text).alias("_t"))
    # the weights are a fixed list of the templates' bigrams, so they are small enough to send to every task
    hits = numbered(blocks(rows, "key", F.col("_t"))).join(F.broadcast(grams.select("gram")), "gram").distinct()
    hits = written(hits, "licence-hits")
    ok = (F.col("confidence") >= sure) & (F.col("likeness") >= CONFIRM) & (F.col("likeness") > F.col("other"))
    lines = scored(hits.filter("whole").select("key", "block", "line", "gram").distinct(), ["key", "block", "line"], grams, intercept, known)
    lines = lines.withColumn("family", F.when(ok, F.col("best")).otherwise(UNKNOWN)).drop("best", "other")

    part = stretches(hits, known).join(hits, ["key", "block"]).filter(F.col("pos").between(F.col("start"), F.col("stop")))
    by = ["key", "block", "t"]
    ends = part.groupBy(*by).agg(F.min("line").alias("line"), F.max("line").alias("last"))
    family_of = F.element_at(F.array(*[F.lit(f) for f, _, _ in known]), F.col("t") + 1)
    sure_of = scored(part.select(*by, "gram").distinct(), by, grams, intercept, known).filter(ok & (F.col("best") == family_of))
    # one row per block and family: the stretch most like its template
    most = F.max(F.struct("likeness", "confidence", (-F.col("line")).alias("first"), "last")).alias("m")
    wide = sure_of.join(ends, by).groupBy("key", "block", F.col("best").alias("family")).agg(most)
    wide = written(wide.select("key", "block", (-F.col("m.first")).alias("line"), F.col("m.last").alias("last"), "family", "m.confidence", "m.likeness"), "stretches")

    lines = written(lines, "lines")
    inside = [lines["key"] == wide["key"], lines["block"] == wide["block"], lines["line"].between(wide["line"], wide["last"])]
    # a line of a wrapped stretch is no paragraph of its own
    told = lines.filter(F.col("family") != UNKNOWN).join(wide.filter("last > line"), inside, "left_anti")
    unknown = lines.filter(F.col("family") == UNKNOWN).join(wide, inside, "left_anti")
    same = told.select("key", "block", "family", F.col("line").alias("at"))
    on = [wide[c] == same[c] for c in ("key", "block", "family")]
    alone = wide.join(same, [*on, same["at"].between(wide["line"], wide["last"])], "left_anti").drop("last")
    return told.unionByName(unknown).unionByName(alone)


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", negatives: int = NEGATIVES) -> DataFrame:
    """One row per document: doc_id, licences (sorted, comma-joined; empty if none), n_licence, n_unknown, confidence (least, null if none)."""
    found = classified(docs, doc_id, text, negatives).groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))), ",").alias("licences"),
        F.sum(F.when(F.col("family") != UNKNOWN, 1).otherwise(0)).alias("n_licence"),
        F.sum(F.when(F.col("family") == UNKNOWN, 1).otherwise(0)).alias("n_unknown"), F.min("confidence").alias("confidence"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key")).join(found, "key", "left")
    return rows.select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_licence", F.lit(0)).cast("long").alias("n_licence"),
                       F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"), F.round("confidence", 6).alias("confidence"))
