"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from directories.

Every line and every paragraph of a file is compared with the templates, so a short notice is found
wherever it stands and a licence file by its paragraphs. Terms are weighted by their rarity over all
files; terms that no template has only add to the length of a passage. A file without a licence of its
own takes that of the nearest directory above it that holds a licence file.

Rules for odd input: null and empty texts have no licence of their own; files without a path inherit
nothing; of equally similar templates the first by name is taken; of several licence files in a
directory the most similar, then the first by path. Repeated rows are treated alike; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import given_id, solid_id, stored

LEAST_COSINE = 0.6
# Notices of common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
_TERM = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def passages(text: str):
    """Lines, and paragraphs of more than one line."""
    for paragraph in re.split(r"\n[ \t]*\n", text):
        lines = paragraph.split("\n")
        yield from lines
        if len(lines) > 1:
            yield " ".join(lines)


class Matcher:
    """Cosine of passages to the templates."""

    def __init__(self, templates: dict[str, list[str]], idf: dict[str, float], unknown: float):
        self.idf, self.unknown = idf, unknown
        self.index: dict[str, list[tuple[int, float]]] = {}
        self.names: list[str] = []
        for name in sorted(templates):
            for text in templates[name]:
                weights = self.vector(terms(text))
                norm = math.sqrt(sum(w * w for w in weights.values()))
                for term, w in weights.items():
                    self.index.setdefault(term, []).append((len(self.names), w / norm))
                self.names.append(name)

    def vector(self, found: list[str]) -> dict[str, float]:
        return {t: n * self.idf.get(t, self.unknown) for t, n in Counter(found).items()}

    def best(self, text: str) -> tuple[str | None, float]:
        top: tuple[float, int] = (0.0, 0)
        for passage in passages(text):
            found = terms(passage)
            if self.index.keys().isdisjoint(found):
                continue
            weights = self.vector(found)
            norm = math.sqrt(sum(w * w for w in weights.values()))
            dots: dict[int, float] = {}
            for term, w in weights.items():
                for i, x in self.index.get(term, ()):
                    dots[i] = dots.get(i, 0.0) + w * x
            i = max(dots, key=lambda i: (dots[i], -i))
            top = max(top, (round(dots[i] / norm, 9), -i))
        return (self.names[-top[1]], top[0]) if top[0] else (None, 0.0)


def _count_terms(vocabulary: frozenset):
    def run(batches):
        counts: Counter = Counter()
        n = 0
        for pdf in batches:
            for text in pdf["text"]:
                counts.update(vocabulary.intersection(terms(text)))
                n += 1
        yield pd.DataFrame([("", n), *counts.items()], columns=["term", "n"])
    return run


def rarity(files: DataFrame, templates: dict[str, list[str]]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms over all files, and that of other terms."""
    vocabulary = frozenset(t for texts in templates.values() for x in texts for t in terms(x))
    rows = files.where("text is not null").select("text").mapInPandas(_count_terms(vocabulary), "term string, n long")
    counts = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = counts.get("", 0)
    return {t: math.log((total + 1) / (counts.get(t, 0) + 1)) + 1 for t in vocabulary}, math.log(total + 1) + 1


def _match(templates: dict[str, list[str]], idf: dict[str, float], unknown: float, least: float):
    def run(batches):
        matcher = Matcher(templates, idf, unknown)
        for pdf in batches:
            found = [matcher.best(t) if t else (None, 0.0) for t in pdf["text"]]
            pdf["license"] = [name if score >= least else None for name, score in found]
            pdf["score"] = [score for _, score in found]
            yield pdf.drop(columns="text")
    return run


def directory(path: Column) -> Column:
    """The path up to its last slash, which is not part of it."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """One row (file_id, path, license, score, found, licence_path) for each row of `files` (file_id, path, text).

    `found` is own, inherited or none; `licence_path` is the file that an inherited licence comes from;
    `score` is the best cosine of the file's own passages.
    """
    templates = templates or TEMPLATES
    idf, unknown = rarity(files, templates)
    # Stored, since what follows reads it three times: every text is matched once.
    own = stored(files.select(solid_id("file_id").alias("_id"), F.col("path").cast("string").alias("path"), "text").mapInPandas(
        _match(templates, idf, unknown, least_cosine), "_id long, path string, license string, score double"), "licences")
    named = own.where(F.col("license").isNotNull() & F.regexp_like(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(LICENSE_NAME)))
    holders = named.groupBy(directory(F.col("path")).alias("dir")).agg(
        F.min_by(F.struct("license", "path"), F.struct(-F.col("score"), F.col("path"))).alias("holder"))
    bare = own.where(F.col("license").isNull() & F.col("path").isNotNull()).select(directory(F.col("path")).alias("here")).distinct()
    steps = F.split("here", "/")
    above = bare.select("here", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("dir")))).alias("x")).select("here", "x.depth", "x.dir")
    above = above.unionByName(bare.where("here != ''").select("here", F.lit(0).alias("depth"), F.lit("").alias("dir")))
    nearest = above.join(holders, "dir").groupBy("here").agg(F.max_by("holder", "depth").alias("holder"))
    rows = own.withColumn("here", F.when(F.col("license").isNull(), directory(F.col("path")))).join(nearest, "here", "left")
    taken = F.col("license").isNull() & F.col("holder").isNotNull()
    return rows.select(
        given_id("_id").alias("file_id"), "path", F.coalesce("license", "holder.license").alias("license"), "score",
        F.when(F.col("license").isNotNull(), "own").when(taken, "inherited").otherwise("none").alias("found"),
        F.when(taken, F.col("holder.path")).alias("licence_path"))
