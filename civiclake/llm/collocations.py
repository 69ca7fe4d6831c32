"""Phrase collocations: counts of phrases by a multikey three-way quicksort of suffix pointers, scored against their best cut.

A text is lower-cased in A-Z, split at ``[.,;:!?`` and line ends ``]`` into pieces, and those at blanks and tabs into words. A suffix is the
run of up to ``DEPTH`` words from one word on, inside its piece. Sorting the suffixes brings those with equal first words together: the
partition of suffixes that agree in their first d words is as large as the count of that phrase of d words.

1. Crowded leads. Each slice of texts reports the phrases of up to ``DEPTH - 1`` words that hold at least a fixed small share of its words. A phrase with
   twice that share of all words must be reported often enough to be seen in the sum. Their hashes set bits in a bitmap of 8 MB, the only broadcast.
   A bit too many does no harm.
2. Routing. Each slice sorts its own suffixes, so that equal ones become one with a weight, and deals them to buckets by a hash of
   their leading words: the first word; the first two if the first is crowded; three if those two are; and so on.
   So a phrase that is not crowded lies in one bucket whole, and no bucket grows with one phrase.
3. Counting. Each bucket sorts its suffixes by a three-way quicksort on one word at a time, on all partitions at once in numpy. A partition
   below the least count is abandoned: no phrase in it can reach it. An equal partition of a lead that is not crowded is a final count;
   those of crowded leads are summed over the buckets.
4. Scores. The frequent phrases, no longer the texts, are joined with themselves for the counts of their parts.

Nulls: a null text counts as empty, a null lang as ``und``. doc_id is not read, so repeated rows count as often as they occur.
Empty tables, and languages without a frequent phrase, give no rows. A word of any length is one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclake.llm.common import U64, batches, cut, hash_words, mix, text_or_empty
from civiclake.llm.line_dedup import bitmap, hit
from civiclake.llm.suite import LLM

DEPTH = 4
LEAST = 30
TOP = 2_000
SCALE = 2_000_000
COVERED = 80  # percent of a phrase's occurrences that lie in one longer phrase
SLICE_CHARS = 3_000_000
BUCKET_CHARS = 6_000_000  # characters of text for each bucket of suffixes
SALTS = 64
MARKS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(MARKS + b"\t", b"\n" * len(MARKS) + b" ")
STEP = U64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - 1
        return number


class Words:
    """The words of some texts end to end, numbered from 1, with 0 after each piece."""

    def __init__(self, texts: list[str]):
        data = b"\n".join([x.encode() for x in texts]).lower().translate(PLAIN)
        numbers = _Numbers({b"": -1, b"\n": 0})
        parts, start = [], 0
        while start < len(data):  # a few megabytes at a time, cut at a blank
            end = data.find(b" ", start + SLICE_CHARS)
            end = len(data) if end < 0 else end + 1
            tokens = data[start:end].replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
            parts.append(found[found >= 0])
            start = end
        self.names = list(numbers)[2:]
        self.ids = np.concatenate([*parts, np.zeros(DEPTH, np.int32)])
        self.hashes = word_hashes(self.names)

    def suffixes(self, block: int = 1_000_000) -> Iterator[list[np.ndarray]]:
        """Blocks of suffixes as one array for each of their words; 0 after a piece's end."""
        for start in range(0, len(self.ids) - DEPTH, block):
            at = np.flatnonzero(self.ids[start:min(start + block, len(self.ids) - DEPTH)]) + start
            if len(at):
                columns = [self.ids[at]]
                for d in range(1, DEPTH):
                    columns.append(np.where(columns[-1] > 0, self.ids[at + d], 0))
                yield columns


def word_hashes(names: list[bytes]) -> np.ndarray:
    """Hashes by word number; 0 for the end of a piece."""
    return np.concatenate([np.zeros(1, U64), pd.util.hash_array(np.array(names, dtype=object), categorize=False)]) if names else np.zeros(1, U64)


def lead_hashes(columns: list[np.ndarray], hashes: np.ndarray, lang: str) -> list[np.ndarray]:
    """Hashes of the first one, two ... words of each suffix, but for the last."""
    out, held = [], hash_words([lang])
    for column in columns[:-1]:
        held = mix(held * STEP + hashes[column])
        out.append(held)
    return out


class Sorted:
    """Multikey three-way quicksort of suffix pointers to the full depth.

    All open partitions take a step at the same time: a pivot, the middle pointer's word at the partition's depth, splits each into
    lower, equal and higher words, and the equal part goes on at the next word. The first word, numbered densely, is dealt out by counting.
    An equal partition holds the suffixes that agree in so many words; its weight is their count. Parts that weigh less than ``least`` are abandoned.

    ``pointer, words, weight``: a suffix of each equal partition, how many words agree, the weight. ``ends, end_weight``: a suffix for each different
    whole suffix that was not abandoned, and its weight; ``ends_only`` stops at single suffixes, whose longer partitions then go untold.
    """

    def __init__(self, columns: list[np.ndarray], weights: np.ndarray, least: int = 1, ends_only: bool = False):
        keys = np.stack(columns)
        order = np.argsort(columns[0], kind="stable")
        words = columns[0][order]
        sizes = np.diff(np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]]))) if len(order) else np.zeros(0, np.int64)
        depth, equal = np.ones(len(sizes), np.int64), np.ones(len(sizes), bool)  # equal: just found to agree in ``depth`` words
        found, ends = [(np.zeros(0, np.int64),) * 3], [(np.zeros(0, np.int64),) * 2]
        while len(sizes):
            starts = np.cumsum(sizes) - sizes
            weight = np.add.reduceat(weights[order], starts)
            enough = weight >= least
            told = enough & equal
            found.append((order[starts[told]], depth[told], weight[told]))
            done = enough & ((equal & (depth == DEPTH)) | ((sizes == 1) & ends_only))
            ends.append((order[starts[done]], weight[done]))
            enough &= ~done
            order, sizes, depth = order[np.repeat(enough, sizes)], sizes[enough], depth[enough]
            if not len(sizes):
                break
            starts = np.cumsum(sizes) - sizes
            part = np.repeat(np.arange(len(sizes)), sizes)
            word = keys[depth[part], order]
            pivot = word[starts + sizes // 2]
            side = (1 + (word > pivot[part]).astype(np.int8) - (word < pivot[part])).astype(np.int8)
            counts = np.bincount(3 * part + side, minlength=3 * len(sizes))
            begin = np.cumsum(counts) - counts
            moved = np.empty_like(order)
            for s in range(3):
                at = np.flatnonzero(side == s)
                own = counts[s::3]
                moved[np.arange(len(at)) + np.repeat(begin[s::3] - np.cumsum(own) + own, own)] = order[at]
            # Where the pivot is no word, the suffixes of the equal part end here.
            over = np.flatnonzero(pivot == 0)
            ended = moved[begin[3 * over + 1]]
            whole = np.add.reduceat(np.append(weights[moved], 0), np.stack([begin[3 * over + 1], begin[3 * over + 1] + counts[3 * over + 1]], 1).ravel())[::2] if len(over) else np.zeros(0, np.int64)
            ends.append((ended[whole >= least], whole[whole >= least]))
            kept = counts.copy()
            kept[3 * over + 1] = 0
            order = moved[np.repeat(kept > 0, counts)]
            filled = kept > 0
            depth = np.stack([depth, depth + 1, depth], 1).ravel()[filled]
            equal = (np.arange(len(counts)) % 3 == 1)[filled]
            sizes = counts[filled]
        self.pointer, self.words, self.weight = (np.concatenate(x) for x in zip(*found))
        self.ends, self.end_weight = (np.concatenate(x) for x in zip(*ends))


def by_lang(part: pd.DataFrame) -> Iterator[tuple[str, Words]]:
    for some in batches(part["text"].tolist(), SLICE_CHARS):
        for lang, rows in part.iloc[some].groupby("lang", sort=False):
            yield lang, Words(rows["text"].tolist())


def crowded_leads(docs: DataFrame, buckets: int) -> np.ndarray:
    """A bitmap of the hashes of phrases of up to ``DEPTH - 1`` words that hold more than half a mean bucket.

    A slice reports those with a quarter of that share of its own words (at least 2 of them). What it leaves out of a phrase is less than that quarter,
    so every phrase over half a bucket keeps at least a quarter in the sum; there are at most ``4 * buckets`` such sums for each number of words.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, words in by_lang(part):
                total = int(np.count_nonzero(words.ids))
                least = max(2.0, total / (4 * buckets))
                ids, counts = [np.zeros(1, np.int64)], [np.array([total])]
                for columns in words.suffixes():
                    hashes = lead_hashes(columns, words.hashes, lang)
                    open_ = np.arange(len(columns[0]))
                    for d in range(DEPTH - 1):
                        open_ = open_[columns[d][open_] > 0]
                        lead, which, n = np.unique(hashes[d][open_], return_inverse=True, return_counts=True)
                        ids.append(lead[n >= least].view(np.int64))
                        counts.append(n[n >= least])
                        open_ = open_[(n >= least)[which]]
                yield pd.DataFrame({"id": np.concatenate(ids), "n": np.concatenate(counts)})

    sums = cut(docs.mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")))
    total = sums.filter("id = 0").selectExpr(f"n / {4 * buckets} as least")
    return bitmap(sums.join(F.broadcast(total), F.expr("id <> 0 and n >= least")).select("id"))  # total is one row


def route(columns: list[np.ndarray], hashes: np.ndarray, lang: str, crowded: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hash that deals each suffix out, and for each number of leading words which suffixes have a crowded lead of that length."""
    leads = lead_hashes(columns, hashes, lang)
    key, inside, flags = leads[0], np.ones(len(leads[0]), bool), []
    for d, lead in enumerate(leads):
        inside = inside & (columns[d] > 0) & hit(crowded, lead)
        flags.append(inside)
        after = leads[d + 1] if d + 1 < len(leads) else mix(lead * STEP + hashes[columns[d + 1]])
        key = np.where(inside, after, key)
    return key, flags


def pack(names: list[bytes], columns: list[np.ndarray], weights: np.ndarray, chosen: np.ndarray) -> dict:
    """Suffixes of one bucket with the words they hold."""
    used, place = np.unique(np.stack([c[chosen] for c in columns]), return_inverse=True)
    place = place.reshape(len(columns), -1) + (used[0] != 0)
    return {"words": b"\n".join([names[i - 1] for i in used.tolist() if i]), "suffixes": place.astype(np.int32).tobytes(), "weights": weights[chosen].tobytes()}


def unpack(rows: pd.DataFrame) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """The suffixes of several slices under one numbering of words."""
    numbers: dict[bytes, int] = {}
    columns, weights = [], []
    for words, suffixes, weight in zip(rows["words"], rows["suffixes"], rows["weights"]):
        own = words.split(b"\n")
        table = np.array([0, *[numbers.setdefault(w, len(numbers) + 1) for w in own]], dtype=np.int32)
        columns.append(table[np.frombuffer(suffixes, np.int32).reshape(DEPTH, -1)])
        weights.append(np.frombuffer(weight, np.int64))
    return list(numbers), list(np.concatenate(columns, 1)), np.concatenate(weights)


def phrase_counts(docs: DataFrame, least: int = LEAST, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """lang, phrase, words, f: all phrases of one to ``DEPTH`` words that occur ``least`` times, and the number of all words
    of a language as the phrase of no words; written out."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty())
    docs = docs.filter("text <> ''")
    chars = docs.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * tasks, -(-chars // bucket_chars))
    bits = spark.sparkContext.broadcast(crowded_leads(docs, buckets))

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, words in by_lang(part):
                for columns in words.suffixes():
                    own = Sorted(columns, np.ones(len(columns[0]), np.int64), ends_only=True)
                    columns = [c[own.ends] for c in columns]
                    key = route(columns, words.hashes, lang, bits.value)[0]
                    bucket = ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    dealt, starts = np.unique(bucket[order], return_index=True)
                    rows = [pack(words.names, columns, own.end_weight, x) for x in np.split(order, starts[1:])]
                    yield pd.DataFrame({"bucket": dealt, "lang": lang, **{k: [r[k] for r in rows] for k in ("words", "suffixes", "weights")}})

    def count(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, own in rows.groupby("lang", sort=False):
            names, columns, weights = unpack(own)
            crowded = route(columns, word_hashes(names), lang, bits.value)[1]
            out.append((lang, "", 0, int(weights.sum()), False))
            for d, flags in enumerate(crowded):
                if flags.any():  # this bucket's share of crowded leads, of any size
                    part = Sorted([c[flags] if i <= d else np.zeros(int(flags.sum()), c.dtype) for i, c in enumerate(columns)], weights[flags])
                    whole = part.words == d + 1
                    out += _told(lang, names, columns, np.flatnonzero(flags)[part.pointer[whole]], part.words[whole], part.weight[whole], False)
            part = Sorted(columns, weights, least)
            final = ~np.stack([*crowded, np.zeros(len(weights), bool)])[part.words - 1, part.pointer]
            out += _told(lang, names, columns, part.pointer[final], part.words[final], part.weight[final], True)
        return pd.DataFrame(out, columns=["lang", "phrase", "words", "f", "final"])

    schema = "bucket long, lang string, words binary, suffixes binary, weights binary"
    dealt = docs.mapInPandas(deal, schema).repartition(max(tasks, buckets // 4), "bucket")
    counted = cut(dealt.groupBy("bucket").applyInPandas(count, "lang string, phrase string, words int, f long, final boolean"))
    shared = counted.filter("not final").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("words") == 0))
    return cut(counted.filter("final").drop("final").unionByName(shared))


def _told(lang, names, columns, pointer, words, weight, final) -> list[tuple]:
    ids = np.stack([c[pointer] for c in columns], 1).tolist()
    return [(lang, b" ".join([names[i - 1] for i in row[:n]]).decode(), n, f, final) for row, n, f in zip(ids, words.tolist(), weight.tolist())]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    known = phrase_counts(docs, least, bucket_chars)
    phrases = known.filter("words > 0")
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    split = phrases.filter("words > 1").withColumn("w", F.split("phrase", " "))
    # A phrase is dropped if the most frequent longer one around it holds enough of its occurrences.
    inner = split.filter("words > 2").select("lang", "f", F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(w, i, n), ' '))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    covered = F.coalesce(wide("longest") * 100 >= wide("f") * COVERED, F.lit(False))
    kept = split.join(longer, ["lang", "phrase"], "left").filter(~covered)
    cuts = cut(kept.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("tail"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)").alias("score")
    worst = both.groupBy("lang", "phrase").agg(F.min(F.struct(score, "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The best of each share of a language come first, so that no task holds a whole language.
    first = worst.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    totals = known.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = """
WITH t AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9),
            'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 10) || ' ') AS text
    FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(string_split(text, chr(10))) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
    FROM s, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 30),
inner_of AS (SELECT c.lang, c.a, array_to_string(c.w[i:i + m2 - 1], ' ') AS phrase
    FROM c, (SELECT unnest([2, 3]) AS m2) AS x, (SELECT unnest([1, 2, 3]) AS i) AS y WHERE m2 < c.m AND i + m2 - 1 <= c.m),
longer AS (SELECT lang, phrase, max(a) AS longest FROM inner_of GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase)
    WHERE longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM kept, (SELECT unnest([1, 2, 3]) AS k) AS z WHERE k < m),
scored AS (SELECT cuts.*, h.f AS l, e.f AS r, (2000000 * CAST(a AS HUGEINT)) // (CAST(h.f AS HUGEINT) + e.f) AS score
    FROM cuts JOIN g AS h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN g AS e ON e.lang = cuts.lang AND e.phrase = cuts.tail),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@LLM.query("op13_collocations", COLLOCATIONS_SQL)
def op13_collocations(t) -> DataFrame:
    return collocations(t.documents)
