"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model holds a whitespace marker after another character, so segmentation never joins two
marked words. Each task keeps a table of the distinct marked words it has met, has the library segment every new
one once, and puts a document's ids together by position. The table is bounded: when full it keeps the words used most,
which changes the time and never the ids. It stays in the task, because a table shared by the whole corpus would have to
send one row per word occurrence through a shuffle, several times the size of the texts.

A model that breaks the rule (or has another form of dummy prefix) gets whole texts encoded instead.
Nulls: a null text counts as empty, which gives the end id only. Repeated rows and null doc_ids pass row by row.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.llm.common import Numbered, batches, slices, text_or_empty
from civiclake.llm.suite import LLM

MARK = "▁"
MARKED_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
TABLE_WORDS = 200_000
MODEL = "piece_bpe_32k.model"


class Encoder:
    """One model with its table of distinct marked words."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.model.eos_id()
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.by_word = all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p in pieces) and self.model.normalize("a") == MARK + "a"
        width = len(str(self.model.vocab_size())) + 1
        self.decimal = np.array([list(f"{i} ".rjust(width).encode()) for i in range(self.model.vocab_size())], dtype=np.uint8)
        self.digits = np.cumsum(self.decimal != 32, axis=1) > 0
        self.digits[:, -1] = True
        self.words = Numbered(table_words)
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: list[str]) -> None:
        # The library puts the first marker of a word back itself, but for a word that is nothing else.
        ids = self.model.encode([w.replace(MARK, " ") for w in words], num_threads=1)
        if "" in words:
            ids[words.index("")] = [self.model.piece_to_id(MARK)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids, the end id last."""
        if not self.by_word:
            return [np.array([*x, self.end], dtype=np.int32) for x in self.model.encode(texts, num_threads=1)]
        if self.words.full():
            kept = self.words.shrink()
            self.flat = self.flat[slices(self.starts[kept], self.lengths[kept])]
            self.lengths = self.lengths[kept]
            self.starts = np.cumsum(self.lengths) - self.lengths
        number = self.words.__getitem__
        found = [np.array(list(map(number, marked_words(x))), dtype=np.int64) for x in self.model.normalize(texts)]
        if self.words.fresh:
            self._add(self.words.fresh)
            self.words.fresh = []
        self.words.used(found)
        return [np.append(self.flat[slices(self.starts[at], self.lengths[at])], np.int32(self.end)) for at in found]

    def text(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return self.decimal[ids][self.digits[ids]].tobytes()[:-1]


def marked_words(text: str) -> list[str]:
    """The marked words of a normalised text, each without its first marker."""
    if MARK + MARK in text:
        return [x[1:] for x in MARKED_WORD.findall(text)]
    return text.split(MARK)[1:] if text[:1] != "" else []


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _per_batch(docs: DataFrame, path: str, row, schema: str) -> DataFrame:
    """Rows of ``row(encoder, ids)`` beside each doc_id."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder(path)
        for part in rows:
            texts, doc_id = part["text"].tolist(), part["doc_id"]
            for cut in batches(texts, 600_000):
                out = pd.DataFrame([row(model, ids) for ids in model.ids(texts[cut])])
                out.insert(0, "doc_id", doc_id.iloc[cut].to_numpy())
                yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return rows.mapInPandas(run, "doc_id long, " + schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int, the end id last), decoded; whole texts."""
    return _per_batch(docs, path, lambda model, ids: {"ids": ids, "decoded": model.text(ids)}, "ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without sending ids and texts back to the JVM."""

    def row(model: Encoder, ids: np.ndarray) -> dict:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return {"n_tokens": len(ids), "ids_sha256": sha(model.joined(ids)), "decoded_sha256": sha(model.text(ids).encode())}

    return _per_batch(docs, path, row, "n_tokens long, ids_sha256 string, decoded_sha256 string")


@LLM.query("op6_sentencepiece_ids")
def op6_sentencepiece_ids(t) -> DataFrame:
    return digests(t.documents, str(public_tokenizers.path(MODEL)))
