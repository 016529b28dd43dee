"""Licence scan with a trained paragraph classifier (operator 8).

A paragraph (a line with a word) is turned into a sparse vector of hashed words and word
pairs; a multinomial logistic regression names a licence family or "unknown". Its
probabilities are softened by a temperature fitted on held-out paragraphs, and the
probability above which a family is believed is the least that lets through at most
MAX_FALSE of held-out unknown paragraphs. A family is confirmed if the paragraph holds
enough of the words of one of its templates. Spark's own transformers and SQL functions
only; no Python runs on rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintloom.llm.common import let

BUCKETS = 1 << 16
MAX_FALSE = 0.01
MIN_CONTAINMENT = 0.6
UNKNOWN = "unknown"
#: Opening sentences and notices of each family, in lower-case words.
TEMPLATES = {
    "MIT": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
    ),
    "Apache-2.0": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ),
    "GPL-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "BSD": (
        "licensed under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ),
    "CC-BY-NC-4.0": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    "CC-BY-4.0": (
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ),
    "proprietary": (
        "all rights reserved",
        "copyright all rights reserved no part of this publication may be reproduced or transmitted in any form without permission",
    ),
}
#: Sentences that share words with licences but are none.
DECOYS = (
    "a driver s license is required to rent a car",
    "the plumber was licensed and insured for all work in the state",
    "all rights of way are reserved for pedestrians",
    "she had reserved a table for the general public",
    "permission to enter was granted free of charge",
    "the software is described in version 3 of the document",
    "a copy of the notice may be obtained at the office",
    "this work is under way and the following conditions are met",
    "the warranty covers parts of any kind for two years",
    "the general said the public had received a copy",
)
#: Common words from which plain sentences are made.
FILLERS = "the of and to in a is that for it was on with as be at by this have from or one had not but what all were when we there can an your which their if will each about up out them then many some so these would other into has more two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def paragraph_words(line: Column) -> Column:
    """The words of a paragraph: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, number, words) of each line with a word; numbers count all lines from 0."""
    # words are made inside the explode: a filter behind it would make Spark split each line twice
    split = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("number"), paragraph_words(line).alias("words")))
    rows = docs.select("doc_id", F.explode(F.filter(split, lambda x: F.size(x["words"]) > 0)).alias("p"))
    return rows.select("doc_id", "p.number", "p.words")


def made_paragraphs(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n labelled paragraphs (words, family) made by rule: templates, decoys and plain sentences, with other words around and some words left out.

    Row k depends on k alone. Half of the rows are unknown.
    """
    texts = [(family, t) for family, ts in TEMPLATES.items() for t in ts]
    families, known = F.array(*[F.lit(f) for f, _ in texts]), F.array(*[F.lit(t) for _, t in texts])
    k = F.col("id")
    draw = lambda salt, top: F.pmod(F.xxhash64(F.lit(salt), k), F.lit(top)).cast("int")
    filler = lambda salt, count: F.transform(F.sequence(F.lit(1), count), lambda i: F.get(F.array(*map(F.lit, FILLERS)), F.pmod(F.xxhash64(F.lit(salt), k, i), F.lit(len(FILLERS))).cast("int")))
    around = lambda core: F.concat(F.slice(filler("a", F.lit(12)), F.lit(1), draw("na", 12)), core, F.slice(filler("b", F.lit(12)), F.lit(1), draw("nb", 12)))
    which = draw("which", len(texts))
    whole = F.split(F.get(known, which), " ")
    # up to one word in ten is left out
    core = F.filter(whole, lambda w, i: (F.pmod(F.xxhash64(F.lit("out"), k, i), F.lit(10)) > 0) | (F.size(whole) < 8))
    licence = F.struct(F.get(families, which).alias("family"), F.when(k % 3 == 0, core).otherwise(around(core)).alias("words"))
    decoy = around(F.split(F.get(F.array(*map(F.lit, DECOYS)), draw("decoy", len(DECOYS))), " "))
    plain = filler("p", draw("np", 60) + 1)
    unknown = F.struct(F.lit(UNKNOWN).alias("family"), F.when(draw("kind", 3) == 0, decoy).otherwise(plain).alias("words"))
    return spark.range(n).select(F.when(k % 2 == 0, licence).otherwise(unknown).alias("p")).select("p.words", "p.family")


@dataclass
class LicenseModel:
    """A fitted classifier with its temperature and the least probability at which a family is believed."""

    pipeline: PipelineModel
    families: list[str]
    temperature: float
    least: float

    def scored(self, rows: DataFrame, least: float = 0.0) -> DataFrame:
        """rows (words) with family, the most probable class but unknown, and probability, softened by the temperature.

        Rows whose probability is below least are left out. They are left out by an
        explode, not by a filter, which Spark would evaluate anew for each mention.
        """
        raw = vector_to_array(F.col("rawPrediction"))
        known = [(i, f) for i, f in enumerate(self.families) if f != UNKNOWN]

        def best(soft: Column) -> Column:
            total = F.aggregate(soft, F.lit(0.0), lambda a, x: a + x)
            return let(total, lambda t: F.array_max(F.array(*[F.struct(F.round(F.get(soft, F.lit(i)) / t, 9).alias("p"), F.lit(f).alias("f")) for i, f in known])))

        def soften(r: Column) -> Column:
            return let(F.array_max(r), lambda top: let(F.transform(r, lambda x: F.exp((x - top) / F.lit(self.temperature))), best))

        found = F.filter(F.array(let(raw, soften)), lambda x: x["p"] >= least)
        out = self.pipeline.transform(rows).select(*rows.columns, F.explode(found).alias("best"))
        return out.select(*rows.columns, F.col("best.f").alias("family"), F.col("best.p").alias("probability"))


def train(labelled: DataFrame) -> LicenseModel:
    """A model from labelled paragraphs (words, family). One in four, by hash, is held out to fit temperature and least probability.

    The labelled table is meant to be small; it is read a few times.
    """
    rows = labelled.where("words IS NOT NULL AND family IS NOT NULL").withColumn("held", F.pmod(F.xxhash64("words"), F.lit(4)) == 0)
    families = sorted({r[0] for r in rows.select("family").distinct().collect()} | {UNKNOWN})
    index = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    data = rows.withColumn("label", index.cast("double")).coalesce(1)
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    terms = SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")
    hashed = HashingTF(inputCol="terms", outputCol="counts", numFeatures=BUCKETS)
    # unit length, so that long paragraphs do not add up to certainty
    scaled = Normalizer(inputCol="counts", outputCol="features")
    regression = LogisticRegression(featuresCol="features", labelCol="label", regParam=1e-4, family="multinomial", maxIter=60)
    pipeline = Pipeline(stages=[pairs, terms, hashed, scaled, regression]).fit(data.where("NOT held"))
    held = pipeline.transform(data.where("held")).select("label", "family", vector_to_array("rawPrediction").alias("raw"))
    grid = [2.0**e for e in range(-2, 5)]
    tried = held.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    softer = F.transform("raw", lambda x: (x - F.array_max("raw")) / F.col("t"))
    loss = F.log(F.aggregate(softer, F.lit(0.0), lambda a, x: a + F.exp(x))) - F.get(softer, F.col("label").cast("int"))
    best = tried.groupBy("t").agg(F.avg(loss).alias("loss")).orderBy("loss", "t").first()
    model = LicenseModel(pipeline, families, best["t"] if best else 1.0, 0.0)
    wrong = model.scored(data.where("held").where(F.col("family") == UNKNOWN).select("words")).agg(F.percentile("probability", 1 - MAX_FALSE)).first()[0]
    model.least = max(0.5, wrong or 0.0)
    return model


def _containment(words: Column, family: Column) -> Column:
    """The largest share of the words of a template of the family that the paragraph holds."""
    best = F.lit(0.0)
    for name, texts in TEMPLATES.items():
        shares = []
        for t in texts:
            parts = sorted(set(t.split(" ")))
            shares.append(F.size(F.array_intersect(words, F.array(*map(F.lit, parts)))) / len(parts))
        best = F.when(family == name, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(best)
    return best


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """One row for each paragraph that is taken for a licence: doc_id, number, family, probability, containment and confirmed.

    Null and empty texts have no paragraphs. Long paragraphs are read whole. Repeated
    rows give repeated findings. Other columns of docs are not looked at; an empty table
    gives an empty result.
    """
    scored = model.scored(paragraphs(docs), model.least)
    share = F.round(_containment(F.col("words"), F.col("family")), 6)
    return scored.select("doc_id", "number", "family", "probability", share.alias("containment"), (share >= MIN_CONTAINMENT).alias("confirmed"))
