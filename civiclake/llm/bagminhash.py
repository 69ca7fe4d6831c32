"""MinHash near-dedup of multisets: BagMinHash signatures, banding, exact check, components.

A document is the multiset of its runs of ``SHINGLE`` words (words as between ASCII white space; all words as one
run where there are fewer). Its similarity to another is the weighted Jaccard: sum of minima over sum of maxima.

BagMinHash: each (run, dyadic interval of weight levels [0, 1), [1, 2), [2, 4), ...) has a Poisson process of points whose
rate is the interval's length. A point has a time, a level and one of the signature's slots, all drawn from hashes of the run,
so documents that share a run share its points. A point counts for a document whose weight lies above the level, and each
slot keeps the earliest time: two signatures agree in a slot with probability equal to the weighted Jaccard, without bias.
Points are generated only up to the time by which all slots are filled with near certainty; the few documents with
an empty slot are done again to a later time, so the result does not depend on that limit.

Documents with equal multisets collapse to the smallest doc_id before banding. Candidates that share a
band are checked by their exact weighted Jaccard on whole texts; classes are connected components of passing pairs.

Nulls: a null text counts as empty. Texts without a word form one class. A null doc_id stands alone, with a null class. Rows that repeat a
doc_id share its class; where their texts differ, each text's class is listed. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.llm.common import U64, batches, cut, hash_words, mix, rolling, slices, text_or_empty
from civiclake.llm.components import crowded, linked
from civiclake.llm.suite import LLM

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5  # a pair at 0.8 shares no band with a chance of 7e-5
GOLDEN, LEVEL, SLOT = U64(0x9E3779B97F4A7C15), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multisets of texts: (text number, run hash, weight), sorted."""
    words, counts = [], []
    for text in texts:
        own = text.encode().split()
        words += own
        counts.append(len(own))
    counts = np.array(counts, dtype=np.int64)
    starts = np.cumsum(counts) - counts
    hashes = hash_words(words)
    runs = np.maximum(counts - SHINGLE + 1, 0)
    whole = rolling(hashes, SHINGLE, int(GOLDEN))
    long = np.flatnonzero(runs)
    keys = [whole[slices(starts[long], runs[long])]] if len(long) else []
    doc = [np.repeat(long, runs[long])]
    for i in np.flatnonzero((counts > 0) & (runs == 0)):
        keys.append(rolling(hashes[starts[i]:starts[i] + counts[i]], int(counts[i]), int(GOLDEN)) + U64(int(counts[i])))
        doc.append(np.array([i]))
    keys, doc = np.concatenate(keys) if keys else np.zeros(0, U64), np.concatenate(doc)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], keys[at], np.diff(np.append(at, len(keys)))


def signatures(doc: np.ndarray, keys: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """The earliest time of each slot, (n, slots); infinite for a document without runs."""
    out = np.full(n * slots, np.inf)
    total = np.bincount(doc, weight, minlength=n)
    limit = slots * (log(slots) + 5) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        own = todo[doc]
        out.reshape(n, slots)[todo] = np.inf
        _points(doc[own], keys[own], weight[own], limit, slots, out)
        todo &= np.isinf(out.reshape(n, slots)).any(1)
        limit = limit * 3
    return out.reshape(n, slots)


def _points(doc, keys, weight, limit, slots, out) -> None:
    parts, k = [], 0
    while True:
        start = 0 if k == 0 else 1 << (k - 1)
        at = np.flatnonzero(weight > start)
        if not len(at):
            break
        parts.append((doc[at], mix(keys[at] + U64((k + 1) * int(GOLDEN) % (1 << 64))), np.full(len(at), float(start)), np.full(len(at), float(max(1, start))), weight[at]))
        k += 1
    doc, seed, start, size, weight = map(np.concatenate, zip(*parts))
    time, drawn, step = np.zeros(len(doc)), 0, 1
    while len(doc):
        number = np.arange(drawn + 1, drawn + step + 1, dtype=U64) * GOLDEN
        r = mix(seed[:, None] + number)
        u = ((r >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        times = time[:, None] + np.cumsum(-np.log(u) / size[:, None], axis=1)
        count = times <= limit[doc][:, None]
        wide = np.flatnonzero(size > 1)
        if len(wide):
            level = start[wide, None] + np.floor((mix(r[wide] ^ LEVEL) >> U64(11)).astype(np.float64) * 2.0**-53 * size[wide, None])
            ok = count.copy()
            ok[wide] &= level < weight[wide, None]
        else:
            ok = count
        row, col = np.nonzero(ok)
        slot = (mix(r[row, col] ^ SLOT) % U64(slots)).astype(np.int64)
        np.minimum.at(out, doc[row] * slots + slot, times[row, col])
        go = count[:, -1]
        doc, seed, start, size, weight, time = doc[go], seed[go], start[go], size[go], weight[go], times[go, -1]
        drawn += step
        step = min(64, max(1, drawn))


def bands(signature: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    values = signature.view(U64).reshape(len(signature), n_bands, rows)
    key = np.broadcast_to(np.arange(1, n_bands + 1, dtype=U64) * GOLDEN, values.shape[:2])
    for j in range(rows):
        key = mix(key * U64(0x100000001B3) + values[:, :, j])
    return key.view(np.int64)


def _signed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        texts = part["text"].tolist()
        for some in batches(texts, 600_000):
            doc, keys, weight = bags(texts[some])
            n = len(texts[some])
            one, two = np.zeros(n, U64), np.zeros(n, U64)
            np.add.at(one, doc, mix(keys) * weight.astype(U64))
            np.add.at(two, doc, mix(keys ^ LEVEL) * weight.astype(U64))
            first, place = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True)[1:]
            place = place.ravel()
            number = np.full(n, -1)
            number[first] = np.arange(len(first))
            own = number[doc] >= 0
            signed = signatures(number[doc[own]], keys[own], weight[own], len(first), BANDS * ROWS)
            key = list(bands(signed, BANDS, ROWS))
            empty = np.isin(np.arange(n), doc, invert=True)
            yield pd.DataFrame({
                **{c: part[c].iloc[some].to_numpy() for c in ("doc_id", "text_id", "row_id")}, "one": one.view(np.int64), "two": two.view(np.int64),
                "bands": [None if e else key[p] for e, p in zip(empty, place)],
            })


def bag(text: str) -> np.ndarray:
    """A text's multiset as a sorted set: the n-th occurrence of a run is an element of its own."""
    _, keys, weight = bags([text])
    again = slices(np.zeros(len(keys), np.int64), weight).astype(U64)
    return np.sort(mix(np.repeat(keys, weight) + again * SLOT))


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets as made by ``bag``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return shared / (len(a) + len(b) - shared)


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, text_id, class_id, kept, copies: one row per different (doc_id, text) of documents with a doc_id.

    A text is named by its doc_id and ``text_id``, a 64-bit hash of the text, so rows that repeat a doc_id are told apart. ``class_id`` is the smallest
    doc_id of the class; ``kept`` marks one row of each class, of that doc_id; ``copies`` counts equal rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).filter("doc_id is not null")
    docs = docs.withColumn("text_id", F.xxhash64("text")).withColumn("row_id", F.xxhash64("doc_id", "text_id"))
    signed = cut(docs.mapInPandas(_signed, "doc_id long, text_id long, row_id long, one long, two long, bands array<long>"))
    own = signed.groupBy("doc_id", "text_id", "row_id", "one", "two").agg(F.count("*").alias("copies"))
    first = F.struct("doc_id", "row_id")
    groups = cut(signed.groupBy("one", "two").agg(F.min(first).alias("first"), F.min_by("bands", first).alias("bands")).select("one", "two", "first.doc_id", F.col("first.row_id").alias("id"), "bands"))
    signed_groups = groups.filter("bands is not null").select("id", "bands")

    def items(ids: DataFrame) -> DataFrame:
        wanted = docs.join(ids.withColumnRenamed("id", "row_id"), "row_id", "left_semi")
        return wanted.groupBy(F.col("row_id").alias("id")).agg(F.min("text").alias("data")).join(signed_groups, "id")

    rows = crowded(signed_groups.select("id", F.explode("bands").alias("key")))
    known = linked(rows, items, lambda texts: [bag(x) for x in texts], lambda a, b: weighted_jaccard(a, b) >= similar, similar).withColumnRenamed("id", "known")
    placed = cut(groups.join(known, groups["id"] == known["known"], "left").select("one", "two", "doc_id", "id", "component"))
    linked_ones = placed.filter("component is not null")
    least = linked_ones.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("least"))
    class_of = cut(linked_ones.join(least, "component").select("one", "two", "least").union(placed.filter("component is null").select("one", "two", F.struct("doc_id", "id"))))
    found = own.join(class_of, ["one", "two"])
    return found.select("doc_id", "text_id", F.col("least.doc_id").alias("class_id"), (F.col("row_id") == F.col("least.id")).alias("kept"), "copies")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of its class, a row per row of docs; a null doc_id has a null class."""
    found = classes(docs, similar)
    rows = found.select("doc_id", "class_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "class_id")
    return rows.union(docs.filter(F.col("doc_id").cast("long").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id")))


@LLM.query("op7_near_duplicates")
def op7_near_duplicates(t) -> DataFrame:
    return near_duplicates(t.documents)
