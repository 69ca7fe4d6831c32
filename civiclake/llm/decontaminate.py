"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased words (runs of letters, digits and underscores). Runs of ``GRAM`` words (an item with fewer words is one
run as a whole) link documents to test items. Every run that a document shares with an item is a hit, however many documents
hold it: of an edited copy that occurs often, the few runs left are frequent ones. Rare is the seed: runs at two different places of the item (one, if it
has only one) in the same document. Four unchanged words in a row hold two such runs, and so does a copy of which every fourth word is changed, while
chance meetings on a single common run form no pair. Each hit gives a diagonal; diagonals of a
pair fall into bins of ``BIN`` words, and the part of the document around a bin is aligned with the item, many pairs at once in
numpy. A pair is kept when its best local score (a match counts 1, a mismatch or a gap -0.5) reaches ``SIMILAR`` of the item's
words; parts that hold too few of these words to reach it are not aligned. Pairs without a seed are not found.

The items' runs are tested on the documents' side through a bitmap of fixed size (8 MB), which lets others pass and
loses none; the join on the run decides. Whole documents are read; only parts around a bin are aligned.

Nulls: null texts, doc_ids and item_ids take no part, nor do texts without a word. Repeated rows count once per doc_id: the
best score of a (doc_id, item_id) stays. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.llm.common import batches, cut, hash_words, rolling, slices
from civiclake.llm.line_dedup import bitmap, hit
from civiclake.llm.suite import LLM

GRAM = 3
BIN = 64
SIMILAR = 0.5
PENALTY = 0.5
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def gram_rows(texts: list[str], wide: set[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: (number, place, hash) of its runs. ``wide`` lists the lengths to take; without it, GRAM or the whole of a shorter text."""
    words, counts = [], []
    for text in texts:
        own = words_of(text)
        words += own
        counts.append(len(own))
    counts = np.array(counts, dtype=np.int64)
    hashes = hash_words(words)
    starts = np.cumsum(counts) - counts
    out = []
    for width in sorted(wide if wide is not None else set(np.minimum(counts, GRAM).tolist()) - {0}):
        chosen = np.flatnonzero((counts >= width) if wide is not None else (np.minimum(counts, GRAM) == width))
        runs = rolling(hashes, width, 0x9E3779B97F4A7C15 + 2 * width)
        each = counts[chosen] - width + 1
        at = slices(starts[chosen], each)
        out.append((np.repeat(chosen, each), at - np.repeat(starts[chosen], each), runs[at]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, place, key = map(np.concatenate, zip(*out))
    return number, place, key.view(np.int64)


def _item_grams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        texts = part["text"].tolist()
        number, place, key = gram_rows(texts, None)
        size = np.array([len(words_of(x)) for x in texts], dtype=np.int64)
        yield pd.DataFrame({"item_id": part["item_id"].to_numpy()[number], "id": key, "at": place, "size": size[number]})


def smith_waterman(items: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    """The best local score of each (item, part), both as arrays of word hashes, with linear gaps; one numpy row step per item word."""
    rows, width = max(map(len, items)), max(map(len, parts))
    a = np.zeros((len(items), rows), np.int64)
    b = np.zeros((len(parts), width), np.int64)
    a_in, b_in = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i, (x, y) in enumerate(zip(items, parts)):
        a[i, :len(x)], a_in[i, :len(x)], b[i, :len(y)], b_in[i, :len(y)] = x, True, y, True
    best = np.zeros(len(items))
    above = np.zeros((len(items), width + 1))
    slope = PENALTY * np.arange(width + 1)
    for t in range(rows):
        match = (a[:, t, None] == b) & a_in[:, t, None] & b_in
        row = np.maximum(above - PENALTY, 0)
        row[:, 1:] = np.maximum(row[:, 1:], above[:, :-1] + np.where(match, 1.0, -PENALTY))
        # A gap from any place further left, by a running maximum.
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        above = np.where(a_in[:, t, None], row, above)
        best = np.maximum(best, np.where(a_in[:, t], row.max(1), 0))
    return best


def _hashed(texts: list[list[str]]) -> list[np.ndarray]:
    flat = hash_words([w for words in texts for w in words]).view(np.int64)
    return np.split(flat, np.cumsum([len(x) for x in texts])[:-1])


def _aligned(similar: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), 500):
                some = part.iloc[start:start + 500]
                items = _hashed([words_of(x) for x in some["item_text"]])
                texts = _hashed([x.split(" ") for x in some["part"]])
                # No score is above the number of the item's words that the part holds.
                fit = [i for i, (x, y) in enumerate(zip(items, texts)) if np.isin(x, y).sum() >= similar * len(x)]
                if not fit:
                    continue
                items, texts, some = [items[i] for i in fit], [texts[i] for i in fit], some.iloc[fit]
                score = smith_waterman(items, texts) / np.array([len(x) for x in items])
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "text_id": some["text_id"].to_numpy(), "item_id": some["item_id"].to_numpy(), "score": score})

    return run


def _cut_parts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words around each bin of diagonals of a document."""
    for part in parts:
        out = []
        for doc_id, text_id, text, bins in zip(part["doc_id"], part["text_id"], part["text"], part["bins"]):
            words = words_of(text)
            for one in bins:
                item_id, size = one["item_id"], one["size"]
                slack = max(32, size // 4)
                for place in (b * BIN for b in one["places"]):
                    own = words[max(0, place - slack):max(0, place + BIN + size + slack)]
                    if own:
                        out.append((doc_id, text_id, item_id, " ".join(own)))
        yield pd.DataFrame(out, columns=["doc_id", "text_id", "item_id", "part"])


def contaminated_texts(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, text_id, item_id, score (share of the item's words), for each pair that reaches ``similar``.

    Texts go by doc_id and ``text_id``, a 64-bit hash of the text, and every different text of an item_id is an item by itself, so repeated ids lose none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    items = items.select(F.col("item_id").cast("long").alias("own_id"), F.col("text").cast("string").alias("text")).filter("own_id is not null and text is not null").distinct()
    items = items.withColumn("item_id", F.xxhash64("own_id", "text"))
    runs = cut(items.select("item_id", "text").mapInPandas(_item_grams, "item_id long, id long, at long, size long"))
    wide = {r[0] for r in runs.select(F.least("size", F.lit(GRAM))).distinct().collect()}  # at most GRAM values
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(runs.select("id")))

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].tolist()
            for some in batches(texts, 600_000):
                number, place, key = gram_rows(texts[some], wide)
                keep = hit(bits.value, key)
                own = {c: part[c].to_numpy()[some][number[keep]] for c in ("doc_id", "text_id")}
                yield pd.DataFrame({**own, "id": key[keep], "pos": place[keep]})

    hits = docs.mapInPandas(probe, "doc_id long, text_id long, id long, pos long").join(runs, "id")
    pairs = hits.groupBy("doc_id", "text_id", "item_id").agg(F.collect_set(F.floor((F.col("pos") - F.col("at")) / BIN)).alias("places"), F.min("at").alias("least"), F.max("at").alias("most"), F.max("size").alias("size"))
    seeded = pairs.filter((F.col("most") > F.col("least")) | (F.col("size") <= GRAM))
    by_doc = seeded.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("item_id", "places", "size")).alias("bins"))
    # Written out: a task that cuts and aligns in one go holds two Python workers at a time, and an executor keeps them all from then on.
    parts = cut(docs.join(by_doc, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "bins").mapInPandas(_cut_parts, "doc_id long, text_id long, item_id long, part string"))
    texts = items.select("item_id", F.col("text").alias("item_text"))
    scored = parts.join(texts, "item_id").select("doc_id", "text_id", "item_id", "part", "item_text").mapInPandas(_aligned(similar), "doc_id long, text_id long, item_id long, score double")
    best = scored.filter(F.col("score") >= similar).groupBy("doc_id", "text_id", "item_id").agg(F.max("score").alias("score"))
    named = best.join(items.select("item_id", "own_id"), "item_id")
    return named.groupBy("doc_id", "text_id", F.col("own_id").alias("item_id")).agg(F.max("score").alias("score"))


def contaminated(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, item_id, score of the pairs that reach ``similar``, the best over the texts of a doc_id and of an item_id."""
    return contaminated_texts(docs, items, similar).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


@LLM.query("op10_decontaminate")
def op10_decontaminate(t) -> DataFrame:
    return contaminated(t.documents, t.benchmark)
