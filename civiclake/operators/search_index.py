"""Ranked catalogue search over an inverted index.

The index holds a posting for each word of each dataset: how often the word stands there, and how many words the dataset has. It is written
sorted by word when a catalogue lands, so a search reads the row groups of its own words only, never the catalogue.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiclake.session import full_shuffle

K1, B = 1.2, 0.75  # how soon repeats stop counting, and how much length does
WORD = r"[\p{L}\p{N}]+"


def _words(datasets: DataFrame) -> Column:
    text = F.concat_ws(" ", "title", "notes", F.array_join("tags", " "))
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def write_index(datasets: DataFrame, folder: str) -> None:
    """Postings (portal, word, id, times, length) and sizes (portal, n, mean_length) of datasets (portal, id, title, notes, tags)."""
    rows = datasets.select("portal", "id", _words(datasets).alias("words")).withColumn("length", F.size("words"))
    # By word and id: a word that every dataset has is dealt over several files. Words are counted where they arrive, so that no task
    # holds the words of all the datasets it reads.
    found = rows.select("portal", "id", "length", F.explode("words").alias("word")).repartitionByRange(full_shuffle(datasets.sparkSession), "word", "id")
    found = found.groupBy("portal", "word", "id", "length").agg(F.count("*").alias("times"))
    found.sortWithinPartitions("word", "portal", "id").write.parquet(f"{folder}/postings")
    rows.groupBy("portal").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length")).coalesce(1).write.parquet(f"{folder}/sizes")


def search_ranked(spark: SparkSession, folder: str, query: str, limit: int = 10) -> DataFrame:
    """portal, place, id, score, words_found: the ``limit`` best datasets of each portal for the words of a query.

    The score sums over the query's words: ``ln(1 + (n - d + 0.5) / (d + 0.5))``, n datasets of which d have the word, times
    ``t (K1 + 1) / (t + K1 (1 - B + B length / mean_length))``, t being how often it stands in the dataset. Rounded to six places; ties by id.
    A dataset without any of the words is not found; a query without a word finds nothing.
    """
    words = sorted({w for w in re.findall(r"[^\W_]+", query.lower())})
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("word").isin(words) if words else F.lit(False))
    sizes = spark.read.parquet(f"{folder}/sizes")
    seen = postings.groupBy("portal", "word").agg(F.count("*").alias("d"))  # a row per portal and word of the query
    weights = seen.join(sizes, "portal").withColumn("weight", F.log1p((F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5)))
    t = F.col("times").cast("double")
    part = F.col("weight") * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    # Dealt by id first: one task may read all postings of a word that every dataset has.
    scored = postings.join(F.broadcast(weights), ["portal", "word"]).repartition("portal", "id").groupBy("portal", "id").agg(
        F.round(F.sum(part), 6).alias("score"), F.count("*").cast("int").alias("words_found"))
    best = Window.partitionBy("portal").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).select("portal", "place", "id", "score", "words_found")
