"""Exact substring dedup by fixed-block anchors.

A text is its words ``[^\\x20\\x09-\\x0D]+``. A word is removed when a window of ``window`` consecutive
words covers it and the same window starts earlier (smaller doc_id, or the same document further left).

The earlier copy of a window holds a whole block of ``window // 2`` words that starts at a multiple of
that length. So the corpus is indexed by these non-overlapping blocks only, and every rolling run of a
block's length probes the index. A hit is extended: it counts where each run across a window is
repeated too, and these candidate windows are compared as a whole; neighbouring ones join to maximal repeats.

How it spreads: documents are dealt into chunks of consecutive ids (a few MB each). Chunks send sorted
sets of hashes to buckets of the hash range and get a bit per hash back, so a passage in a third of all
documents costs a few bytes per chunk, no pair of occurrences is ever formed, and "earlier" means a
smaller chunk or further left in the same one. The texts are shuffled once. Runs are compared by 47 bits
in the first round, which only narrows the search, and windows by 96 bits in the second.

Nulls: a null text has no words; a null doc_id sorts before all others. Rows that repeat a doc_id count
as separate documents, ordered by text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.llm.common import U64, hash_words, mix, rolling, table, text_or_empty, windows
from civiclake.llm.suite import LLM

WINDOW = 20
CHUNK_CHARS = 4_000_000
KNOTS = 64
ROUND1_BITS = 47
M1, M2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
ROW = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def in_chunks(docs: DataFrame, chunk_chars: int) -> tuple[DataFrame, int]:
    """doc_id, text and a chunk number that grows with doc_id; the number of chunks wanted.

    Quantiles of doc_id cut the ids into ranges, and each range is cut evenly, so chunks stay
    near their size where ids are dense or sparse, at any number of rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    share = [i / KNOTS for i in range(KNOTS + 1)]
    chars, knots = docs.agg(F.sum(F.length("text")), F.percentile_approx("doc_id", share, 10_000)).first()
    per_range = max(1, round((chars or 0) / chunk_chars / KNOTS))
    starts = sorted(set(knots or [0]))
    steps = [max(1, -(-(b - a) // per_range)) for a, b in zip(starts, starts[1:] + [starts[-1] + 1])]
    at = F.size(F.filter(F.lit(starts), lambda x: x <= F.col("doc_id")))
    at = F.greatest(at, F.lit(1))
    within = F.floor((F.col("doc_id") - F.element_at(F.lit(starts), at)) / F.element_at(F.lit(steps), at))
    within = F.least(F.greatest(within, F.lit(0)), F.lit(per_range - 1))
    chunk = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise((at - 1) * per_range + within)
    return docs.withColumn("chunk", chunk.cast("long")), len(starts) * per_range


class Words:
    """The words of a chunk's documents, end to end, in the order that decides which copy is earlier."""

    def __init__(self, docs: pd.DataFrame, window: int):
        docs = docs.sort_values(["doc_id", "text"], na_position="first")
        self.doc_id = docs["doc_id"].to_numpy()
        self.words, counts = [], []
        for text in docs["text"]:
            words = text.encode().split()  # splits at \\x20 and \\x09-\\x0D exactly
            self.words += words
            counts.append(len(words))
        self.counts = np.array(counts, dtype=np.int64)
        self.hashes = hash_words(self.words)
        self.window, self.block = window, window // 2

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Round-1 keys of the rolling runs of a block's length, and which of them start inside their document whole."""
        return rolling(self.hashes, self.block, M1) >> U64(64 - ROUND1_BITS), windows(self.counts, self.block)

    def blocks(self, n: int) -> np.ndarray:
        """Which of the first n positions start a reference block."""
        first = np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        return ((np.arange(len(first)) - first) % self.block == 0)[:n]

    def wholes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each window, and which windows stay inside their document."""
        return rolling(self.hashes, self.window, M1), rolling(self.hashes, self.window, M2), windows(self.counts, self.window)


def _planes(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte, so that the shuffle's compression finds the leading zeros."""
    return np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(U64).ravel(), dtype=U64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _send(chunk: int, keys: np.ndarray, marks: np.ndarray, width: int, buckets: int) -> dict:
    """One row per bucket of the key range; keys are sorted and below 2 ** width."""
    ends = [0, *np.searchsorted(keys, [U64((b << width) // buckets) for b in range(1, buckets)]).tolist(), len(keys)]
    rows = [(chunk, b, _planes(keys[i:j]), marks[i:j].tobytes()) for b, (i, j) in enumerate(zip(ends, ends[1:])) if j > i]
    return dict(zip(("chunk", "bucket", "data", "marks"), map(list, zip(*rows)))) if rows else {"chunk": [], "bucket": [], "data": [], "marks": []}


SENT = "chunk long, bucket long, data binary, marks binary"


def _round1_keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, whether each starts a block, the place of each run among them, and which runs are whole."""
    keys, whole = words.runs()
    distinct, place = np.unique(keys[whole], return_inverse=True)
    block = np.zeros(len(distinct), np.uint8)
    block[place[words.blocks(len(keys))[whole]]] = 1
    return distinct, block, place, whole


def _probe(window: int, buckets: int):
    def probe(key, docs: pd.DataFrame) -> pd.DataFrame:
        distinct, block, _, _ = _round1_keys(Words(docs, window))
        return pd.DataFrame(_send(key[0], distinct, block, ROUND1_BITS, buckets))

    return probe


def _meet(sets: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's keys of one bucket: two bits, seen in another chunk, and indexed as a block by any."""
    keys = [_numbers(x) for x in sets["data"]]
    place = np.unique(np.concatenate(keys), return_inverse=True)[1]
    seen = np.bincount(place)[place] > 1
    indexed = np.zeros(len(place), bool)
    indexed[place[np.frombuffer(b"".join(sets["marks"]), np.uint8) > 0]] = True
    ends = np.cumsum([len(k) for k in keys])[:-1]
    flags = [np.concatenate(x) for x in zip(np.split(seen, ends), np.split(seen & indexed[place], ends))]
    return pd.DataFrame({"chunk": sets["chunk"], "bucket": sets["bucket"], "n": [len(k) for k in keys], "data": map(_bits, flags)})


ANSWERED = "chunk long, bucket long, n long, data binary"


def _candidates(words: Words, answers: pd.DataFrame) -> np.ndarray:
    """Windows that hold an anchor hit and whose runs are all repeated in other chunks."""
    _, _, place, whole = _round1_keys(words)
    seen, anchor = np.zeros((2, len(whole)), np.int64)
    if len(place):
        answers = answers.sort_values("bucket")
        flags = [_flags(x, 2 * n) for x, n in zip(answers["data"], answers["n"])]
        seen[whole] = np.concatenate([f[:len(f) // 2] for f in flags])[place]
        anchor[whole] = np.concatenate([f[len(f) // 2:] for f in flags])[place]
    span = words.window - words.block + 1  # runs inside a window
    n = max(0, len(words.hashes) - words.window + 1)
    total = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[span:span + n] - c[:n]
    return windows(words.counts, words.window) & (total(seen) == span) & (total(anchor) > 0)


def _window_keys(words: Words, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct candidate windows (64 bits in order, 32 more bits); all candidate places, and which window each holds."""
    one, two, _ = words.wholes()
    at = np.flatnonzero(candidates)
    at = at[np.lexsort((at, two[at], one[at]))]
    new = _changes(one[at], two[at])
    return one[at[new]], (two[at[new]] >> U64(32)).astype(np.uint32), at, np.cumsum(new) - 1


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def _extend(window: int, buckets: int):
    def extend(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"chunk": [], "bucket": [], "data": [], "marks": []})
        words = Words(docs, window)
        candidates = _candidates(words, answers)
        one, two, _, _ = _window_keys(words, candidates)
        sent = _send(key[0], one, two, 64, buckets)
        # The candidates themselves pass by the next step under a group of their own (chunks start at -1).
        for name, value in (("chunk", key[0]), ("bucket", -2 - key[0]), ("data", _bits(candidates)), ("marks", b"")):
            sent[name].append(value)
        return pd.DataFrame(sent)

    return extend


def _first(sets: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's windows of one bucket: a bit, the same window is in an earlier chunk."""
    if sets["bucket"].iat[0] < 0:
        return pd.DataFrame({"chunk": sets["chunk"], "bucket": sets["bucket"], "n": -1, "data": sets["data"]})
    sets = sets.sort_values("chunk")
    one = [_numbers(x) for x in sets["data"]]
    two = np.frombuffer(b"".join(sets["marks"]), np.uint32)
    all_one = np.concatenate(one)
    order = np.lexsort((two, all_one))  # stable: equal windows stay in the order of chunks
    earlier = np.zeros(len(order), bool)
    earlier[order] = ~_changes(all_one[order], two[order])
    flags = np.split(earlier, np.cumsum([len(x) for x in one])[:-1])
    return pd.DataFrame({"chunk": sets["chunk"].to_numpy(), "bucket": sets["bucket"].to_numpy(), "n": [len(x) for x in one], "data": list(map(_bits, flags))})


def _repeats(words: Words, answers: pd.DataFrame) -> np.ndarray:
    """Per word, whether a window that starts earlier elsewhere covers it."""
    n = max(0, len(words.hashes) - words.window + 1)
    repeat = np.zeros(n, bool)
    if n:
        one, two, whole = words.wholes()
        # In the chunk itself: all but the first of equal windows.
        at = np.flatnonzero(whole)
        at = at[np.lexsort((at, two[at], one[at]))]
        repeat[at[~_changes(one[at], two[at])]] = True
        # In earlier chunks.
        candidates = _flags(answers["data"][answers["bucket"] < 0].iat[0], n)
        _, _, at, which = _window_keys(words, candidates)
        if len(at):
            answers = answers[answers["bucket"] >= 0].sort_values("bucket")
            earlier = np.concatenate([_flags(x, k) for x, k in zip(answers["data"], answers["n"])])
            repeat[at[earlier[which]]] = True
    covered = np.zeros(len(words.hashes) + 1, np.int64)
    starts = np.flatnonzero(repeat)
    np.add.at(covered, starts, 1)
    np.subtract.at(covered, starts + words.window, 1)
    return np.cumsum(covered)[:-1] > 0


def _rewrite(window: int):
    def rewrite(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        words = Words(docs, window)
        gone = _repeats(words, answers)
        out, start = [], 0
        for doc_id, n in zip(words.doc_id, words.counts.tolist()):
            drop = gone[start:start + n]
            kept = [w for w, d in zip(words.words[start:start + n], drop.tolist()) if not d]
            out.append((doc_id, n, int(drop.sum()), b" ".join(kept)))
            start += n
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    return rewrite


def _digest(window: int):
    def digest(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = _rewrite(window)(key, docs, answers)
        rows["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in rows.pop("kept")]
        return rows

    return digest


def substring_dedup(docs: DataFrame, window: int = WINDOW, chunk_chars: int = CHUNK_CHARS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the kept words joined by spaces, UTF-8 bytes), or its SHA-256 with ``digest``."""
    if window < 2 or window % 2:
        raise ValueError("window must be an even number")
    docs, chunks = in_chunks(docs, chunk_chars)
    buckets = max(32, chunks // 8)
    sets = docs.groupBy("chunk").applyInPandas(_probe(window, buckets), SENT)
    hits = sets.groupBy("bucket").applyInPandas(_meet, ANSWERED)
    found = docs.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInPandas(_extend(window, buckets), SENT)
    firsts = found.groupBy("bucket").applyInPandas(_first, ANSWERED)
    both = docs.groupBy("chunk").cogroup(firsts.groupBy("chunk"))
    if digest:
        return both.applyInPandas(_digest(window), ROW)
    return both.applyInPandas(_rewrite(window), ROW.replace("kept_sha256 string", "kept binary"))


@LLM.query("op3_substring_dedup")
def op3_substring_dedup(t) -> DataFrame:
    return substring_dedup(t.documents, digest=True)
