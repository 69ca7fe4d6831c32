"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    The folder is the one ``spark.checkpoint.dir`` names. Only a session on a local master
    without that setting (a test) gets a temporary folder.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="civiclake-checkpoint-"))
    return df.checkpoint()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash_words(words: list) -> np.ndarray:
    """A 64-bit hash per word (str or bytes), the same on every executor."""
    if not words:
        return np.zeros(0, U64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=True)


def rolling(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive hashes, by doubling.

    Runs that cross a document's end are for the caller to leave out.
    """
    if len(hashes) < width:
        return np.zeros(0, U64)
    out, have, power = None, 0, hashes.astype(U64, copy=False)
    size, bits = 1, width
    m = lambda n: U64(pow(factor, n, 1 << 64))
    while True:
        if bits & 1:
            if out is None:
                out, have = power, size
            else:
                n = len(hashes) - have - size + 1
                out = out[:n] + m(have) * power[have:have + n]
                have += size
        bits >>= 1
        if not bits:
            return mix(out[:len(hashes) - width + 1])
        n = len(hashes) - 2 * size + 1
        power = power[:n] + m(size) * power[size:size + n]
        size *= 2


def windows(counts: np.ndarray, width: int) -> np.ndarray:
    """For words of documents laid end to end: True where a run of ``width`` words stays in its document."""
    total = int(counts.sum())
    if total < width:
        return np.zeros(0, bool)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return left[:total - width + 1] >= width


def batches(texts, limit: int = 2_000_000):
    """Slices of a list of texts that hold about ``limit`` characters, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def runs_of(lengths: np.ndarray, limit: int):
    """Slices of rows whose lengths add up to ``limit`` at most, one row at least."""
    ends, start = np.cumsum(lengths, dtype=np.int64), 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, limit + (int(ends[start - 1]) if start else 0), "right")))
        yield slice(start, stop)
        start = stop


class Numbered(dict):
    """Numbers distinct strings as they come, in a table of bounded size.

    ``fresh`` holds those that are new since it was last emptied. ``shrink`` keeps those used most and
    numbers them anew; it returns the old numbers of the kept ones.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.fresh: list[str] = []
        self.uses = np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        number = self[word] = len(self)
        return number

    def used(self, numbers: list[np.ndarray]) -> None:
        uses = np.bincount(np.concatenate(numbers), minlength=len(self)) if numbers else np.zeros(len(self), np.int64)
        uses[:len(self.uses)] += self.uses
        self.uses = uses

    def full(self) -> bool:
        return len(self) > self.limit

    def shrink(self) -> np.ndarray:
        least = 2
        while np.count_nonzero(self.uses >= least) > self.limit // 2:
            least *= 2
        kept = np.flatnonzero(self.uses >= least)
        words = list(self)
        self.clear()
        self.update((words[i], n) for n, i in enumerate(kept.tolist()))
        self.uses = self.uses[kept] // 2
        return kept


def slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of runs of given starts and lengths, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
