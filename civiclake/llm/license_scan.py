"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Every line of a text is a possible header, and a text as a whole is a possible licence file. Both are compared with
templates by the cosine of TF-IDF vectors over lower-cased words: lines with the notices (templates of one line), whole texts with
these and with whole licence texts (templates of several lines, which weigh words by their own vocabulary). Document frequencies of the templates' words are counted over all
files; a word that no template holds weighs like one that no file holds, so foreign text lowers a score.
The best template at ``SIMILAR`` or more is a file's own licence (ties: the smaller name). A file whose whole text reaches it is a licence
file and speaks for its directory (ties in a directory: the higher score, then the smaller path, then name). A file without
a licence of its own takes that of the nearest directory above it that has one.

The templates are a bounded table (``TEMPLATES_MOST`` rows, else refused). Each directory is resolved once by joining its
ancestors with the licensed directories; files join their directory by a salted key, so one directory may hold most files.

Nulls: a null text counts as empty; a null path has no directory and inherits nothing. Repeated rows pass row by row. An empty table
gives an empty result; without templates nothing has a licence. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiclake.llm.common import cut, text_or_empty
from civiclake.llm.suite import LLM

SIMILAR = 0.6
TEMPLATES_MOST = 2_000
SALTS = 32
WORD = re.compile(r"\w+(?:[.-]\w+)*")

# Short statements by which files name a licence; own wording of the customary notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License, version 3 or later."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, under the BSD 3-Clause License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("ISC", "Released under the ISC License."),
]


def template_table(spark: SparkSession) -> DataFrame:
    """The notices, and the whole texts in the folder ``licenses``, named by their files."""
    folder = Path(__file__).parent / "licenses"
    whole = [(x.name.removesuffix(".txt"), x.read_text("utf-8")) for x in sorted(folder.glob("*.txt"))]
    return spark.createDataFrame([*TEMPLATES, *whole], "license string, text string")


def is_whole(text: str) -> bool:
    return "\n" in text.strip()


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Matcher:
    """Templates as weighted words."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], files: int):
        self.idf = lambda w: log((1 + files) / (1 + frequency.get(w, 0))) + 1
        self.unseen = log(1 + files) + 1
        self.known = frozenset(w for _, text in templates for w in words_of(text))
        self.weight = {w: self.idf(w) for w in self.known}
        self.templates = []
        for name, text in sorted(templates):
            tf = Counter(words_of(text))
            vector = {w: n * self.weight[w] for w, n in tf.items()}
            self.templates.append((name, vector, sqrt(sum(v * v for v in vector.values()))))

    def best(self, text: str) -> tuple[float, str | None]:
        """The highest cosine and its licence."""
        words = words_of(text)
        shared = self.known.intersection(words)
        if not shared:
            return 0.0, None
        tf = Counter(words)
        vector = {w: tf[w] * self.weight[w] for w in shared}
        inside = sum(v * v for v in vector.values())
        outside = sum(n * n for w, n in tf.items() if w not in shared) * self.unseen**2
        norm = sqrt(inside + outside)
        if sqrt(inside) < SIMILAR * norm * (1 - 1e-12):  # no template can reach the threshold
            return 0.0, None
        best, name = 0.0, None
        for license_name, other, length in self.templates:
            score = sum(v * other[w] for w, v in vector.items() if w in other) / (norm * length) if length else 0.0
            if score > best + 1e-12:
                best, name = score, license_name
        return best, name


def _frequencies(words: frozenset):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for part in parts:
            for text in part["text"]:
                counts.update(words.intersection(words_of(text)))
        yield pd.DataFrame({"word": list(counts), "files": list(counts.values())}, dtype=object)

    return run


def _scan(shared, similar: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        notices, texts = shared.value
        for part in parts:
            out = []
            for text in part["text"]:
                lines = [x for x in text.split("\n") if x.strip()]
                score, name = max((notices.best(x) for x in set(lines)), key=lambda x: (x[0], [-ord(c) for c in x[1] or ""]), default=(0.0, None))
                whole, whole_name = notices.best(text) if len(lines) > 1 and score else (score, name)
                found, found_name = texts.best(text)
                if found > whole + 1e-12:
                    whole, whole_name = found, found_name
                is_file = whole >= similar
                if is_file and whole > score:
                    score, name = whole, whole_name
                out.append((score, name, is_file) if score >= similar else (0.0, None, False))
            score, name, is_file = map(list, zip(*out)) if out else ([], [], [])
            paths = [p if isinstance(p, str) else None for p in part["path"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].tolist(), "path": paths, "own_score": score, "own_license": name, "license_file": is_file}, dtype=object)

    return run


def scan_licenses(files: DataFrame, templates: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, path, own_license, own_score, license_file, license (own or inherited), inherited_from (a directory)."""
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), text_or_empty())
    rows = [(r[0], r[1]) for r in templates.select("license", "text").limit(TEMPLATES_MOST + 1).collect() if r[0] is not None and r[1]]
    if len(rows) > TEMPLATES_MOST:
        raise ValueError(f"more than {TEMPLATES_MOST} templates")
    words = frozenset(w for _, text in rows for w in words_of(text))
    counted = files.select("text").mapInPandas(_frequencies(words), "word string, files long").groupBy("word").agg(F.sum("files").alias("files"))
    frequency = {r["word"]: r["files"] for r in counted.collect()}  # a row per word of the templates
    matcher = files.sparkSession.sparkContext.broadcast((rows, frequency, files.count()))
    scanned = cut(files.mapInPandas(_scan(_Shared(matcher), similar), "doc_id long, path string, own_score double, own_license string, license_file boolean"))

    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    scanned = scanned.withColumn("dir", parent)
    order = F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_license").alias("l"))
    licensed = cut(scanned.filter("license_file and dir is not null").groupBy("dir").agg(F.min(order).alias("first")).select(F.col("dir").alias("above"), F.col("first.l").alias("license")))
    dirs = scanned.filter("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ancestors = dirs.withColumn("above", F.explode(F.array_distinct(above)))
    nearest = Window.partitionBy("dir").orderBy(F.desc(F.length("above")))
    given = ancestors.join(licensed, "above").withColumn("n", F.row_number().over(nearest)).filter("n = 1")
    given = given.select(F.col("dir").alias("of"), F.col("above").alias("inherited_from"), F.col("license").alias("given"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salted"))
    salt = F.pmod(F.xxhash64("path", "doc_id"), F.lit(SALTS)).cast("int")
    found = scanned.withColumn("salt", salt).join(given, (F.col("dir") == F.col("of")) & (F.col("salt") == F.col("salted")), "left")
    own = F.col("own_license")
    return found.select(
        "doc_id", "path", "own_license", "own_score", "license_file", F.coalesce(own, "given").alias("license"),
        F.when(own.isNull(), F.col("inherited_from")).alias("inherited_from"),
    )


class _Shared:
    """The matchers of a broadcast (notices, whole texts), made once per worker."""

    def __init__(self, data):
        self.data, self.made = data, None

    @property
    def value(self) -> tuple[Matcher, Matcher]:
        if self.made is None:
            rows, frequency, files = self.data.value
            self.made = tuple(Matcher([x for x in rows if is_whole(x[1]) == whole], frequency, files) for whole in (False, True))
        return self.made


@LLM.query("op1_license_scan")
def op1_license_scan(t) -> DataFrame:
    # Documents as files: a tree of source, language and id.
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return scan_licenses(t.documents.select("doc_id", path.alias("path"), "text"), template_table(t.spark))
