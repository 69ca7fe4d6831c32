"""Token counts; huge documents by overlap resynchronisation.

A text of up to ``whole_chars`` is counted at once, by the sum over its units: a unit is a run of white space with the run of
other characters after it. The splitter never keeps white space behind another character in one token, so units are
encoded apart, each distinct one once per task (a bounded table that keeps those used most). A text with white space
outside ASCII goes to the library in one piece. A longer text is cut into pieces that run ``overlap``
characters into the next; pieces are encoded apart, with offsets, and spliced where both encodings of the overlap
begin a pre-token at the same character. The splitter reads left to right and decides by the text from a
boundary on, so two scans that share one boundary agree from there: the splice is proven, as long as it stays ``MARGIN``
characters before the end of the left piece, beyond what the splitter and a special string look ahead. Where an overlap holds
no common boundary (one run of letters, say) it is doubled, and the left piece grows by doubling too, so that a run costs time in proportion to its length.

Nulls: a null text counts as empty (0 bytes, 0 tokens). Repeated rows and null doc_ids pass row by row. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.llm.common import Numbered, batches, text_or_empty
from civiclake.llm.suite import LLM

MODEL = "byte_bpe_50k.json"
LIMIT = 512
WHOLE_CHARS = 50_000
PIECE_CHARS = 30_000
OVERLAP = 256
MARGIN = 64
TABLE_UNITS = 500_000
TABLE_CHARS = 8_000_000  # of all units in the table, but for those of the last slice
UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
OTHER_SPACE = re.compile(r"[^\S \t-\r]")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Units:
    """Token counts of the distinct units a task has met."""

    def __init__(self, path: str, size: int = TABLE_UNITS):
        self.model = tokenizer(path)
        self.numbers, self.table, self.chars = Numbered(size), np.zeros(0, np.int64), 0

    def encode(self, texts: list[str]):
        return self.model.encode_batch(texts, add_special_tokens=False)

    def lengths(self, texts: list[str]) -> list[int]:
        out = []
        for i in range(0, len(texts), 20_000):
            out += [len(x) for x in self.model.encode_batch_fast(texts[i:i + 20_000], add_special_tokens=False)]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if self.numbers.full() or self.chars > TABLE_CHARS:
            self.table = self.table[self.numbers.shrink()]
            self.chars = sum(map(len, self.numbers))
            if self.chars > TABLE_CHARS:  # few units that are long: start anew
                self.numbers, self.table, self.chars = Numbered(self.numbers.limit), np.zeros(0, np.int64), 0
        number = self.numbers.__getitem__
        found = [np.array(list(map(number, [x] if OTHER_SPACE.search(x) else UNIT.findall(x))), dtype=np.int64) for x in texts]
        if self.numbers.fresh:
            self.table = np.append(self.table, np.array(self.lengths(self.numbers.fresh), dtype=np.int64))
            self.chars += sum(map(len, self.numbers.fresh))
            self.numbers.fresh = []
        self.numbers.used(found)
        return [int(self.table[x].sum()) for x in found]


@lru_cache(maxsize=2)
def units(path: str) -> Units:
    return Units(path)


class Piece:
    """One encoded piece: where each token starts in the document, and where pre-tokens begin."""

    def __init__(self, encoding, start: int, end: int):
        self.start, self.end = start, end
        offsets = np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2)
        words = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
        self.starts = offsets[:, 0] + start
        begins = np.ones(len(words), bool)
        begins[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        self.boundaries = np.unique(self.starts[begins])

    def tokens_before(self, place: int) -> int:
        return int(np.searchsorted(self.starts, place, "left"))


def splice(left: Piece, right: Piece) -> int | None:
    """A place where both pieces begin a pre-token and the left one is right up to there."""
    common = np.intersect1d(left.boundaries, right.boundaries, assume_unique=True)
    common = common[(common > right.start) & (common <= left.end - MARGIN)]
    return int(common[0]) if len(common) else None


def count_huge(encode, text: str, piece_chars: int = PIECE_CHARS, overlap: int = OVERLAP) -> int:
    """Tokens of one text by pieces; ``encode`` takes a list of strings.

    Where an overlap holds no common boundary, it is doubled, and with it the left piece once the overlap has come to half of it:
    so a run of any length is encoded a bounded number of times its length.
    """
    def piece(start: int, end: int) -> Piece:
        end = min(len(text), end)
        return Piece(encode([text[start:end]])[0], start, end)

    left, begin, total, more = piece(0, piece_chars + overlap), 0, 0, overlap
    while left.end < len(text):
        start = left.end - more
        right = piece(start, start + piece_chars + more)
        at = splice(left, right)
        if at is not None:
            total += left.tokens_before(at) - left.tokens_before(begin)
            left, begin, more = right, at, overlap
            continue
        more *= 2
        if more > (left.end - left.start) // 2:
            left = piece(left.start, left.start + 2 * (left.end - left.start))
    return total + len(left.starts) - left.tokens_before(begin)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, whole_chars: int = WHOLE_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = units(path)
        for part in rows:
            texts = part["text"].tolist()
            counts = []
            for cut in batches(texts):
                some = texts[cut]
                short = iter(model.counts([x for x in some if len(x) <= whole_chars]))
                counts += [next(short) if len(x) <= whole_chars else count_huge(model.encode, x) for x in some]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": part["n_bytes"], "n_tokens": counts, "over_limit": [n > limit for n in counts]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@LLM.query("op9_token_counts")
def op9_token_counts(t) -> DataFrame:
    return token_counts(t.documents, str(public_tokenizers.path(MODEL)))
