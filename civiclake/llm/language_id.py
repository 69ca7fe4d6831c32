"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is folded to lower case, code point by code point, and everything that is no letter becomes a blank. Its features are the letters and the runs of two
to ``ORDER`` code points of one word, the blank before it and the blank after it included, each hashed to one of 2**bits
buckets. Training counts the buckets per language over every document that may be learned from, once on Spark: each task sends the buckets
it met with their counts, and one sum per language and bucket comes back. The matrix of log-probabilities (with add-``SMOOTH`` smoothing) is broadcast, and
each batch of texts is scored by looking its n-grams up and summing them per document and language. The score is the posterior of the language named.

The matrix holds ``CELLS`` numbers at most (16 MB): with very many languages the buckets are folded to fewer, which no document is left out of.

Nulls: a null text, or one without a letter, is ``und`` with score 0, and so is every text where nothing was learned. A null lang is never
learned from. A null doc_id counts as the empty text, whose crc32 is 0, so it is held out. Of languages with equal scores the smallest name wins. Repeated
rows are learned and scored row by row. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.llm.common import batches
from civiclake.llm.suite import LLM

ORDER = 4
BITS = 16
CELLS = 1 << 22
SMOOTH = 0.1
FOLDS = 5
BLOCK = 1_000_000  # code points that are hashed at a time
UNKNOWN = "und"
FACTOR = np.uint32(0x9E3779B1)


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (buckets, starts of the texts in them) for the texts laid end to end, ``ORDER`` arrays of buckets in one.

    ``1 << bits`` stands where no n-gram of that length starts.
    """
    codes = folded()[np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)]
    codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(ORDER, np.uint32)])
    last = len(codes) - ORDER
    none = np.int32(1 << bits)
    for start in range(0, last, BLOCK):
        end = min(last, start + BLOCK)
        window = codes[start:end + ORDER]
        held = np.zeros(end - start, np.uint32)
        inner = np.ones(end - start, bool)  # all but the first and the last are letters
        out = np.empty((ORDER, end - start), np.int32)
        for k in range(1, ORDER + 1):
            code = window[k - 1:k - 1 + end - start]
            held = (held ^ code) * FACTOR
            held ^= held >> np.uint32(15)
            if k == 1:
                whole = code > 0
            else:
                if k > 2:
                    inner &= window[k - 2:k - 2 + end - start] > 0
                whole = inner & ((code > 0) | (window[:end - start] > 0)) if k == 2 else inner
            out[k - 1] = np.where(whole, (held * np.uint32(0x85EBCA6B + 2 * k)) >> np.uint32(32 - bits), none)
        yield out, start


def places(texts: list[str]) -> np.ndarray:
    """Where each text starts in the codes of ``grams``: at the blank before it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.cumsum(sizes) - sizes


def has_letter(texts: list[str]) -> np.ndarray:
    return np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text leaves no remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def known_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


class Model:
    """Languages in the order of their names, log-priors, and log-probabilities of buckets with a last row of zeros."""

    def __init__(self, langs: list[str], docs: np.ndarray, counts: np.ndarray):
        self.langs, self.bits = langs, int(counts.shape[1]).bit_length() - 1
        self.prior = np.log(docs / max(1, docs.sum()))
        rates = np.log((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * counts.shape[1]))
        self.rates = np.concatenate([rates, np.zeros((len(langs), 1))], 1).astype(np.float32) if langs else np.zeros((0, 1), np.float32)

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """(text, language) sums of log-probabilities, without the priors."""
        out = np.zeros((len(texts), len(self.langs)))
        begin = places(texts)
        for buckets, start in grams(texts, self.bits):
            end = start + buckets.shape[1]
            first = int(np.searchsorted(begin, start, "right")) - 1
            after = int(np.searchsorted(begin, end, "left"))
            cuts = np.maximum(begin[first:after] - start, 0)
            for i, rates in enumerate(self.rates):
                out[first:after, i] += np.add.reduceat(rates[buckets].sum(0, dtype=np.float64), cuts)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and its posterior for each text; no letter, no language."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        scores = self.log_likelihoods(texts) + self.prior
        best = scores.argmax(1)
        chance = 1 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
        known = has_letter(texts)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], np.where(known, chance, 0.0)


def train(docs: DataFrame, bits: int = BITS) -> Model:
    """The model of all documents that may be learned from. Only sums per language and bucket come to the driver."""
    rows = docs.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    while len(found) << bits > CELLS and bits > 1:
        bits -= 1

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, own in part.groupby("lang", sort=False):
                texts = own["text"].tolist()
                total = sums.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                for some in batches(texts, BLOCK):
                    for buckets, _ in grams(texts[some], bits):
                        total += np.bincount(buckets.ravel(), minlength=len(total))
        for lang, total in sums.items():
            at = np.flatnonzero(total[:-1])
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": total[at]})

    langs = sorted(found)
    counts = np.zeros((len(langs), 1 << bits))
    sums = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    number = {lang: i for i, lang in enumerate(langs)}
    counts[sums["lang"].map(number).to_numpy(np.int64), sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
    return Model(langs, np.array([found[x] for x in langs], dtype=np.float64), counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of rows of ``known_rows``, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t if t is not None else "" for t in part["text"].tolist()]
            langs, scores = [], []
            for some in batches(texts, BLOCK):
                lang, score = shared.value.predict(texts[some])
                langs += lang
                scores.append(score)
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": langs, "score": np.concatenate([np.zeros(0), *scores])})

    # As text, so that ids beside a null are not turned into floating point.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text")
    return rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


@LLM.query("op12_language_id")
def op12_language_id(t) -> DataFrame:
    docs = known_rows(t.documents)
    return identify(docs, train(docs))
