"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find, one line kept per component.

A line is a part of a text between line feeds; blank lines are left alone. Two lines are alike when the Jaccard similarity of
their sets of ``GRAM`` consecutive characters is at least ``SIMILAR`` (a shorter line is one gram as a whole). Components of
alike lines keep their first line in the order of (doc_id, place in the text); all others go, and equal lines are the simplest case.

Signatures: a line of up to ``SHORT`` distinct grams takes the minimum of each of 40 hash functions; a line of at least
``SIMILAR * SHORT`` distinct grams hashes once and takes the minimum of each of 40 bins, empty ones filled from the next. The sets of
alike lines differ in size by no more than ``SIMILAR``, however often the lines repeat their grams, so any alike pair shares a kind of signature.
Lines are named by a 64-bit hash, grams too; equal hashes count as equal lines or grams. Keys and ids leave a task packed, a row per
bucket of keys, and each bucket is sorted as arrays; only keys of several ids, or of lines that come again, become rows. Line texts, places
and documents are only sent where a bitmap of fixed size (a broadcast of 8 MB) says that they may take part; it lets others pass and loses none.

Nulls: a null text counts as empty. Documents with a null doc_id stay as they are and are not compared. Rows that repeat a doc_id
count as one document: equal lines at the same place stay or go together. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.llm.common import U64, batches, cut, mix, rolling, text_or_empty
from civiclake.llm.components import crowded, linked
from civiclake.llm.suite import LLM

GRAM = 8
SIMILAR = 0.8
SHORT = 128
BANDS, ROWS = 10, 4  # a pair at 0.8 shares no band with a chance of 0.5 %, one at 0.9 with 2e-5
SLOTS = BANDS * ROWS
FACTORS = (mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1)
FIRST = 2  # the bit of a key that marks the first band of its kind
BITMAP_BITS = 26
BUCKET_BITS = 12  # leading bits of a key that name its bucket
FRAME_CHARS = 16_000_000  # of the lines in which a task looks for repeats before it signs them
HELD_KEYS = 1 << 20  # keys that a task holds before it deals them out, and before it sorts those of a bucket
SIGNED_CHARS = 100_000  # what is signed at a time, so that its arrays stay in the processor's cache
NONE = np.zeros(0, np.int64)
MIXED = mix(np.arange(1, (1 << 16) + 1, dtype=U64))  # hashes of the code points of the first plane


def grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines' grams, end to end, and how many each line has (one at least)."""
    counts = np.array([len(x) for x in lines], dtype=np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    codes = MIXED[points] if points.max(initial=0) < len(MIXED) else mix(points.astype(U64) + U64(1))
    runs = rolling(codes, GRAM, 0x9E3779B97F4A7C15)
    each = np.maximum(counts - GRAM + 1, 0)
    across = (np.cumsum(counts)[:-1, None] - np.arange(1, GRAM)).ravel()  # runs that cross a line's end
    within = np.ones(len(runs), bool)
    within[across[(across >= 0) & (across < len(runs))]] = False
    inside = runs[within]
    short = np.flatnonzero(each == 0)
    if not len(short):
        return inside, each
    starts = np.cumsum(counts) - counts
    whole = [rolling(codes[starts[i]:starts[i] + counts[i]], int(counts[i]), 0x9E3779B97F4A7C15)[0] + U64(int(counts[i])) if counts[i] else U64(0) for i in short]
    at = (np.cumsum(each) - each)[short]
    each[short] = 1
    return np.insert(inside, at, np.array(whole, dtype=U64)), each


def signatures(hashes: np.ndarray, each: np.ndarray, short: bool) -> np.ndarray:
    """(line, slot) minima, by 40 functions or by 40 bins."""
    starts = np.cumsum(each) - each
    if short:
        hashes = (hashes >> U64(32)).astype(np.uint32)
        product = np.empty_like(hashes)
        return np.stack([np.minimum.reduceat(np.multiply(hashes, f, out=product), starts) for f in FACTORS], 1).astype(U64)
    slot = hashes >> U64(32)
    slot *= U64(SLOTS)
    slot >>= U64(32)
    slot += np.repeat(np.arange(0, len(each) * SLOTS, SLOTS, dtype=U64), each)
    out = np.full(len(each) * SLOTS, 1 << 32, dtype=U64)
    np.minimum.at(out, slot.view(np.int64), hashes & U64(0xFFFFFFFF))
    out = out.reshape(-1, SLOTS)
    some = np.flatnonzero((out == U64(1 << 32)).any(1))
    own = out[some]
    filled = own.copy()
    for d in range(1, SLOTS):
        empty = filled == U64(1 << 32)
        if not empty.any():
            break
        near = np.roll(own, -d, axis=1)
        use = empty & (near != U64(1 << 32))
        filled[use] = near[use] + U64(d << 33)
    out[some] = filled
    return out


def distinct(hashes: np.ndarray, each: np.ndarray) -> np.ndarray:
    """How many different grams each line has. Lines of fewer than ``SIMILAR * SHORT`` grams are short either way and keep their count.

    Of a line whose first grams alone are more than ``SHORT`` different ones, only these are counted: it is not short, whatever follows.
    """
    out, starts = each.copy(), np.cumsum(each) - each
    head = SHORT + SHORT // 4
    wide = np.flatnonzero(each > head)
    if len(wide):
        own = np.sort(hashes[starts[wide][:, None] + np.arange(head)], axis=1)
        out[wide] = 1 + np.count_nonzero(own[:, 1:] != own[:, :-1], axis=1)
    for i in np.flatnonzero((each >= SIMILAR * SHORT) & ((each <= head) | (out <= SHORT))):
        own = np.sort(hashes[starts[i]:starts[i] + each[i]])
        out[i] = 1 + np.count_nonzero(own[1:] != own[:-1])
    return out


def bands(lines: list[str]) -> np.ndarray:
    """(line, 2 x BANDS) keys, those of functions before those of bins; zero where a line has no such signature. A bit marks the first of each kind."""
    out = np.zeros((len(lines), 2 * BANDS), np.int64)
    hashes, each = grams(lines)
    size = distinct(hashes, each)
    for kind, chosen in enumerate((size <= SHORT, size >= SIMILAR * SHORT)):
        at = np.flatnonzero(chosen)
        if not len(at):
            continue
        values = signatures(hashes[np.repeat(chosen, each)], each[at], kind == 0).reshape(len(at), BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(kind), values.shape[:2])
        for j in range(ROWS):
            key = mix(key * U64(0x100000001B3) + values[:, :, j])
        key &= ~U64(FIRST)
        key[:, 0] |= U64(FIRST)
        out[at, kind * BANDS:(kind + 1) * BANDS] = (key | U64(1)).view(np.int64)
    return out


def _signed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bands of a batch's lines; a line that a batch holds more than once is signed once."""
    for part in parts:
        part = part.drop_duplicates("id")
        signed = [bands(x) for x in _slices(part["line"].tolist(), SIGNED_CHARS)]
        if signed:
            yield pd.DataFrame({"id": part["id"].to_numpy(), "data": part["line"].to_numpy(dtype=object), "bands": list(np.concatenate(signed))})


def _slices(lines: list[str], limit: int) -> Iterator[list[str]]:
    return (lines[some] for some in batches(lines, limit))


def _frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together to about ``FRAME_CHARS``."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += sum(map(len, part["line"].tolist()))
        if size >= FRAME_CHARS:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys of a task's lines with the lines' ids, packed by bucket. A line that comes again is signed once; its first key then stands twice."""
    held, size = [], 0
    for part in _frames(parts):
        again = part["id"][part["id"].duplicated()].unique()
        part = part.drop_duplicates("id")
        ids, twice, start = part["id"].to_numpy(), part["id"].isin(again).to_numpy(), 0
        for lines in _slices(part["line"].tolist(), SIGNED_CHARS):
            keys, own = bands(lines), slice(start, start + len(lines))
            row, col = np.nonzero(keys)
            first = np.flatnonzero(twice[own])
            held.append(np.stack([keys[row, col], ids[own][row]], 1))
            held.append(np.stack([keys[first, (keys[first] != 0).argmax(1)], ids[own][first]], 1))
            start += len(lines)
            size += len(row) + len(first)
            if size >= HELD_KEYS:
                yield _dealt(np.concatenate(held))
                held, size = [], 0
    if size:
        yield _dealt(np.concatenate(held))


def _dealt(pairs: np.ndarray) -> pd.DataFrame:
    """A row for each bucket of (key, id): the pairs as bytes."""
    bucket = (pairs[:, 0].view(U64) >> U64(64 - BUCKET_BITS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    pairs, bucket = pairs[order], bucket[order]
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
    starts = np.append(0, ends[:-1])
    return pd.DataFrame({"bucket": bucket[starts].astype(np.int32), "pairs": [pairs[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist())]})


def _several(pairs: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, id): those whose key has several ids here or is ``known`` to, and first keys of an id that comes again; one of each other key; the keys known from now on."""
    order = np.argsort(pairs[:, 0])
    pairs = pairs[order]
    key, own = pairs.T
    starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
    sizes = np.diff(np.append(starts, len(key)))
    many = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
    if len(known):
        many |= np.isin(key[starts], known)
    again = starts[~many & (sizes > 1) & (key[starts] & FIRST != 0)]
    return np.concatenate([pairs[np.repeat(many, sizes)], pairs[again]]), pairs[starts[~many]], np.union1d(known, key[starts[many]])


def _meeting(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, id of the keys that several ids have, and a key of each id that comes again. A bucket is held as one pair for each key of one id, and keys alone for the others."""
    bucket, held, size, alone, known = None, [], 0, 0, NONE
    found = [np.zeros((0, 2), np.int64)]
    for part in parts:
        for own, packed in zip(part["bucket"].tolist(), part["pairs"].tolist()):
            if own != bucket or size - alone >= HELD_KEYS:
                if held:
                    out, rest, known = _several(np.concatenate(held), known)
                    found.append(out)
                    held, size, alone = [rest], len(rest), len(rest)
                if own != bucket:
                    bucket, held, size, alone, known = own, [], 0, 0, NONE
                if sum(map(len, found)) >= HELD_KEYS // 8:
                    yield _pairs(found)
                    found = found[:1]
            held.append(np.frombuffer(packed, np.int64).reshape(-1, 2))
            size += len(held[-1])
    if held:
        found.append(_several(np.concatenate(held), known)[0])
    yield _pairs(found)


def _pairs(found: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(np.concatenate(found), columns=["key", "id"]).drop_duplicates()


def keys_met(lines: DataFrame) -> DataFrame:
    """key, id: the keys that several of the lines (id, line) have, each id of a key once; of a line that comes again one key at least."""
    packed = lines.mapInPandas(_keys, "bucket int, pairs binary").repartition("bucket").sortWithinPartitions("bucket")
    return packed.mapInPandas(_meeting, "key long, id long").distinct()


def bitmap(ids: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bit per hash prefix; of fixed size, whatever the number of ids."""
    place = F.shiftrightunsigned("id", 64 - bits)
    rows = ids.groupBy(F.shiftrightunsigned(place, 5).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(31)).cast("int"))).alias("bits"))
    found = rows.toArrow()  # as columns: as rows of Python, two million words would take hundreds of MB of the driver
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def hit(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = ids.astype(np.int64).view(U64) >> U64(64 - (len(bits) * 32).bit_length() + 1)
    return ((bits[(place >> U64(5)).astype(np.int64)] >> (place & U64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)


def gram_sets(lines: list[str]) -> list[np.ndarray]:
    """The set of each line's grams: sorted hashes without repeats."""
    hashes, each = grams(lines)
    ends = np.cumsum(each)
    for start, end in zip((ends - each).tolist(), ends.tolist()):
        hashes[start:end].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[ends - each] = True
    return np.split(hashes[new], np.cumsum(np.add.reduceat(new, ends - each))[:-1]) if lines else []


def alike(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> bool:
    """Whether two sets of grams have the Jaccard similarity; sets that differ too much in size need no count."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similar * len(b):
        return False
    shared = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return bool(shared >= similar * (len(a) + len(b) - shared))


def maybe_in(ids: DataFrame):
    """A test of a long column for being among ``ids`` (id), by their bitmap."""
    bits = ids.sparkSession.sparkContext.broadcast(bitmap(ids))

    @F.pandas_udf("boolean")
    def test(own: pd.Series) -> pd.Series:
        return pd.Series(hit(bits.value, own.to_numpy()))

    return test


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, pos, line, id of the lines that are not blank, of documents with a doc_id."""
    rows = docs.filter("doc_id is not null").withColumn("text_id", F.xxhash64("text"))
    rows = rows.select("doc_id", "text_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.filter(F.trim("line") != "").withColumn("id", F.xxhash64("line"))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, pos of each line that goes because an alike one stays; written out."""
    spark = docs.sparkSession
    lines = lines_of(docs)
    met = cut(keys_met(lines.select("id", "line")))
    rows = crowded(met)

    def items(ids: DataFrame) -> DataFrame:
        bits = spark.sparkContext.broadcast(bitmap(ids))

        def candidates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                own = part.column(0).to_numpy()
                at = np.flatnonzero(hit(bits.value, own))
                yield part.take(pa.array(at[np.unique(own[at], return_index=True)[1]]))

        wanted = lines.select("id", "line").mapInArrow(candidates, "id long, line string").join(ids, "id", "left_semi")
        return wanted.groupBy("id").agg(F.min("line").alias("line")).mapInPandas(_signed, "id long, data string, bands array<long>")

    known = linked(rows, items, gram_sets, alike, SIMILAR)
    grouped = maybe_in(met.select("id"))
    places = lines.select("id", "doc_id", "text_id", "pos").filter(grouped("id")).join(known, "id", "left")
    places = cut(places.withColumn("component", F.coalesce("component", "id")).drop("id"))
    kept = cut(places.groupBy("component").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    return cut(places.join(kept, "component").filter("doc_id <> first.doc_id or pos <> first.pos").select("doc_id", "text_id", "pos"))


def _without(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """Texts without the lines that stand at the places ``gone``, and how many these are; no text where none goes."""
    out = []
    for whole, at in zip(text, gone):
        if at is None or not len(at):
            out.append((None, 0))
            continue
        lines = whole.split("\n")
        stay = np.ones(len(lines), bool)
        stay[np.asarray(at, dtype=np.int64)] = False
        out.append(("\n".join(compress(lines, stay.tolist())), len(lines) - int(stay.sum())))
    return pd.DataFrame(out, columns=["kept", "n_removed"])


def dedup_lines(docs: DataFrame, counted: str | None = None) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and any others), with the duplicate lines taken out of text; ``counted`` names a further column for their number."""
    spark = docs.sparkSession
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    gone = duplicate_lines(plain).groupBy(F.col("doc_id").alias("gone_doc"), F.col("text_id").alias("gone_text")).agg(F.collect_set("pos").alias("gone"))
    gone = cut(gone)
    changed = maybe_in(gone.select(F.xxhash64("gone_doc").alias("id")))(F.xxhash64("doc_id")) & F.col("doc_id").isNotNull()
    text = text_or_empty("row.text")
    some = whole.filter(changed).withColumn("text_id", F.xxhash64(text))
    some = some.join(gone, (F.col("doc_id") == F.col("gone_doc")) & (F.col("text_id") == F.col("gone_text")), "left")
    without = F.pandas_udf(_without, "kept string, n_removed long")
    some = some.withColumn("left", without(text, "gone"))
    kept = F.when(F.col("left.n_removed") > 0, F.col("left.kept")).otherwise(F.col("row.text"))
    some = some.select("row", kept.alias("kept"), F.col("left.n_removed").alias("n_removed"))
    rest = whole.filter(~changed | F.col("doc_id").isNull()).select("row", F.col("row.text").alias("kept"), F.lit(0).cast("long").alias("n_removed"))
    columns = [F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names]
    return some.union(rest).select(*columns, *([F.col("n_removed").alias(counted)] if counted else []))


@LLM.query("op5_line_dedup")
def op5_line_dedup(t) -> DataFrame:
    rows = dedup_lines(t.documents.select("doc_id", "text"), counted="n_removed")
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.size(F.split(text, "\n"))).cast("long").alias("n_kept"), "n_removed", F.sha2(text, 256).alias("kept_sha256"))
