"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each result as Parquet in the
shared work folder and reads it again, so a lost executor costs one stage's tasks at most. All but the last return the columns of
documents, further columns included. Rows with a null doc_id pass the stages that compare documents, a null text counts as empty, and an empty
table gives an empty result. Documents are told apart by doc_id and text: rows of one doc_id with different texts are judged one by one
(their lines share places in the line stage), equal rows leave one, and of a class of near duplicates the text of the smallest doc_id
stays; with the same doc_id, that of the smaller hash.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclake.llm import bagminhash, decontaminate, line_dedup, quality, sentencepiece_ids
from civiclake.llm.common import table
from civiclake.llm.suite import LLM, ship
from civiclake.session import work_dir

OWN = "_civiclake_"  # prefix of helper columns, so that none clashes with a column of documents


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier holds for good and not toxic."""
    ship(spark)
    models = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn(OWN + "score", quality.scorer(docs, models)).filter(quality.passes(F.col(OWN + "score"))).select(*_names(docs))


def remove_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, or nearly repeat, an earlier one; n_chars follows the text."""
    ship(spark)
    rows = line_dedup.dedup_lines(docs, counted=OWN + "gone")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col(OWN + "gone") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*_names(docs))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, of the smallest doc_id; of equal rows one.

    Rows go by doc_id and text, so a doc_id that repeats with another text is a document by itself.
    """
    ship(spark)
    found = bagminhash.classes(docs)
    gone = found.filter("not kept")
    twice = found.filter("kept and copies > 1")
    once = _named(docs, gone.union(twice), "left_anti")
    again = _named(docs, twice, "left_semi", first_only=True)
    return once.union(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark; another text under the same doc_id stays."""
    ship(spark)
    return _named(docs, decontaminate.contaminated_texts(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents left."""
    ship(spark)
    return sentencepiece_ids.digests(docs, str(public_tokenizers.path(sentencepiece_ids.MODEL)))


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _named(docs: DataFrame, found: DataFrame, how: str, first_only: bool = False) -> DataFrame:
    """Rows of docs whose (doc_id, text) is (``left_semi``) or is not (``left_anti``) among those found; one of equal ones if ``first_only``."""
    rows = docs.withColumns({OWN + "id": F.col("doc_id").cast("long"), OWN + "text": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    wanted = found.select(F.col("doc_id").alias(OWN + "id"), F.col("text_id").alias(OWN + "text")).distinct()
    rows = rows.join(wanted, [OWN + "id", OWN + "text"], how)
    if first_only:
        rows = rows.dropDuplicates([OWN + "id", OWN + "text"])
    return rows.select(*_names(docs))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", reject_low_quality),
    ("line_dedup", remove_duplicate_lines),
    ("near_dedup", keep_one_of_each_class),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

# SQL has neither the classifier nor the tokenizer; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


@LLM.query("pipeline", ORACLE_SQL)
def pipeline(t) -> DataFrame:
    return run(t.spark, t.folder)
