"""Quality classifier by co-training of a text view and a page view.

The text view sees words (hashed, present or not) and shares of word forms; the page view sees metadata and layout:
language, source, length, lines, and the shares of kinds of characters. For each target (good quality, toxic) both views
are logistic regressions. They start from the labelled rows. In each round Spark scores every unlabelled document with both calibrated views; the rows that
one view is sure of (``SURE``) are pseudo-labels for the other, whatever their number. What a view learns from them are sums over all such
rows, by class and by group of sources: in how many a feature is present, which decides the features that count, and the mean row, which enters
the next fit with its rows' weight. All pseudo-labels of a class weigh at most as much as its labelled rows. Each view is calibrated on labelled
rows kept apart (Platt) after each fit, a logistic regression over the two calibrated scores combines them, and every
document is scored, in one pass without a shuffle. A document is rejected when it is more likely bad than good, or more likely toxic than not.

The features of all documents are written once to the shared work folder and read again in each round. The driver fits on at most ``LABELLED``
labelled rows (those of smallest hash) and on sums of fixed size. A text that holds more than a thousandth of all rows counts as one row (there are fewer
than a thousand such texts). Sums are whole numbers, so they do not depend on the order in which tasks end.

Nulls: a null text counts as empty; a null language, source or length is a value of its own; a null label takes no part in that
target. Where a target has fewer than two rows of either class, its score is the constant 1 (good) or 0 (toxic). Repeated rows are scored alike; a
doc_id that repeats in labels counts as many times. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.llm.common import U64, hash_words, runs_of
from civiclake.llm.suite import LLM
from civiclake.session import work_dir

LABELLED = 4_000
ROUNDS, SURE = 3, 0.95
GROUPS = 4  # of sources, by hash; each gives its own mean rows
UNIT = 1 << 16  # sums are kept in whole numbers of 1 / UNIT
WORD_BITS, FORM_BITS, PAGE_BITS = 17, 10, 9
SLICE_CHARS, TABLE_WORDS = 300_000, 150_000  # what a task holds of texts and of words at a time
SLICE_ROWS = 1_500  # and of written features
STEPS, DECAY, CHANCE = 120, 0.5, 5.0
META = "doc_id long, text string, lang string, source string, n_chars long"
DIGIT = re.compile(r"[0-9]")
# Of each code point of the first plane: white space, upper case, lower case, other.
KIND = np.array([0 if chr(i).isspace() else 1 if chr(i).isupper() else 2 if chr(i).isalpha() else 3 for i in range(0x2100)], dtype=np.int64)


def form(word: str) -> str:
    """The kind of a word: case, digits, and what stands at its end."""
    tail = "" if word[-1].isalnum() else word[-2:] if len(word) > 1 and not word[-2].isalnum() else word[-1]
    case = "l" if word.islower() else "u" if word.isupper() and len(word) > 1 else "t" if word[0].isupper() else "o"
    return case + ("|" if word.isalpha() or not DIGIT.search(word) else "d|") + tail


_words: dict[str, int] = {}


def number_words(words: set[str]) -> None:
    """Put feature numbers of new words (as itself in the high half, its form in the low one) into the task's table, which starts anew when full."""
    if len(_words) > TABLE_WORDS:
        _words.clear()
    new = [w for w in words if w not in _words]
    plain = hash_words([w.lower().strip(".,;:!?\"'()*%&$#|") for w in new]) % U64(1 << WORD_BITS)
    forms = hash_words([form(w) for w in new]) % U64(1 << FORM_BITS) + U64(1 << WORD_BITS)
    _words.update(zip(new, (plain << U64(32) | forms).tolist()))


def text_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of the text view."""
    last = (1 << WORD_BITS) + (1 << FORM_BITS)
    if not words:
        return np.array([last + 1]), np.ones(1, np.float32)
    counts = Counter(words)
    pairs = np.fromiter(map(_words.__getitem__, counts), np.int64, len(counts))
    plain = np.unique(pairs >> 32)
    forms, place = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
    share = np.bincount(place, np.fromiter(counts.values(), np.float64, len(counts))) * (4 / len(words))
    values = np.concatenate([np.ones(len(plain)), share, [4 * len(counts) / len(words), 1.0]])
    return np.concatenate([plain, forms, [last, last + 1]]), values.astype(np.float32)


def page_features(text: str, lang: str | None, source: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of the page view."""
    n = max(1, len(text))
    lines = text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.bincount(KIND[np.minimum(codes, len(KIND) - 1)], minlength=4)
    spaces, upper, lower, other = kinds[:4].tolist()
    numbers = [
        np.log1p(len(text)) / 4, np.log1p(len(lines)) / 2, np.log1p(n / len(lines)) / 3, 4 * upper / n, 4 * lower / n, 4 * other / n,
        (len(text) / max(1, spaces)) / 5, len(set(lines)) / len(lines), 1.0 if n_chars is None or n_chars != n_chars else 0.0,
        float(len(text) < 200), float(len(text) > 5000),
    ]
    values = [("l", lang), ("s", source), ("size", int(np.log2(n))), ("upper", 20 * upper // n), ("other", 20 * other // n)]
    return np.concatenate([np.arange(len(numbers)), [page_value(*v) for v in values]]), np.concatenate([numbers, np.ones(len(values))]).astype(np.float32)


@lru_cache(maxsize=10_000)
def page_value(name: str, value) -> int:
    return 16 + int(hash_words([f"{name}={value}"])[0] % U64((1 << PAGE_BITS) - 16))


TEXT_SIZE = (1 << WORD_BITS) + (1 << FORM_BITS) + 2
PAGE_SIZE = 1 << PAGE_BITS


class Rows:
    """Sparse rows of one view."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], size: int):
        self.lengths = np.array([len(i) for i, _ in rows], dtype=np.int64)
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), self.lengths)
        self.size, self.n = size, len(rows)

    def take(self, chosen: np.ndarray) -> "Rows":
        out = object.__new__(Rows)
        mask = chosen[self.row]
        out.lengths, out.index, out.value = self.lengths[chosen], self.index[mask], self.value[mask]
        out.row, out.size, out.n = np.repeat(np.arange(int(chosen.sum()), dtype=np.int32), out.lengths), self.size, int(chosen.sum())
        return out

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.index], minlength=self.n)

    def back(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * x[self.row], minlength=self.size)


class Taught:
    """Sums over the rows that the other view is sure of: of each class and group of sources."""

    def __init__(self, size: int):
        self.counts, self.present, self.total = np.zeros((2, GROUPS)), np.zeros((2, GROUPS, size)), np.zeros((2, GROUPS, size))


def fit(rows: Rows, y: np.ndarray, taught: Taught | None = None, steps: int = STEPS, decay: float = DECAY) -> np.ndarray:
    """Logistic regression by Adam over all rows and the mean rows of ``taught``, classes weighted alike.

    A present-or-absent feature counts by its log-likelihood ratio between the classes; one that
    chance explains has no weight, so the thousands of neutral words of a long text add no noise.
    """
    yes = y > 0.5
    seen = rows.value != 0
    present = [np.bincount(rows.index[seen & ~yes[rows.row]], minlength=rows.size).astype(np.float64), np.bincount(rows.index[seen & yes[rows.row]], minlength=rows.size).astype(np.float64)]
    size = [float((~yes).sum()), float(yes.sum())]
    own = [0.0, 0.0]
    for label in (0, 1) if taught else ():
        own[label] = min(1.0, size[label] / max(1.0, taught.counts[label].sum()))
        present[label] += own[label] * taught.present[label].sum(0)
        size[label] += own[label] * taught.counts[label].sum()
    (q, p), (no, yes) = present, size
    cells = np.maximum(np.stack([p, q, yes - p, no - q]), 0)
    rate = (p + q) / max(1, yes + no)
    due = np.stack([rate * yes, rate * no, (1 - rate) * yes, (1 - rate) * no])
    likelihood = 2 * (cells * np.log(np.maximum(cells, 1e-9) / np.maximum(due, 1e-9))).sum(0)
    scale = np.clip((np.sqrt(np.maximum(likelihood, 0)) - CHANCE) / CHANCE, 0, 3)
    scale[p + q > 0.98 * (yes + no + 1)] = 1.0  # numbers that nearly every row has
    used = scale[rows.index] > 0
    index, value, row, labels, share, n = [rows.index[used]], [rows.value[used]], [rows.row[used]], [y], [np.ones(len(y))], rows.n
    for label in (0, 1) if taught else ():
        for count, total in zip(taught.counts[label], taught.total[label]):
            if count > 0:
                at = np.flatnonzero(total * scale)
                index, value, row = [*index, at], [*value, total[at] / count], [*row, np.full(len(at), n)]
                labels, share, n = [*labels, [label]], [*share, [own[label] * count]], n + 1
    x = object.__new__(Rows)
    x.index, x.row, y, share = (np.concatenate(part) for part in (index, row, labels, share))
    x.value, x.size, x.n = np.concatenate(value) * scale[x.index], rows.size, n
    weight = np.where(y > 0.5, 0.5 / max(1, yes), 0.5 / max(1, no)) * share * (yes + no)
    w, m, v = np.zeros(x.size), np.zeros(x.size), np.zeros(x.size)
    for step in range(1, steps + 1):
        chance = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        g = x.back((y - chance) * weight) - decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w * scale


def dense_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on a few columns by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def chances(rows: Rows, weights: np.ndarray, platt: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(rows.times(weights) * platt[0] + platt[1], -30, 30)))


def teach(pool: DataFrame, models: dict[str, dict]) -> dict[str, list[Taught]]:
    """What each view learns from the other about each target, summed over all rows of the pool."""
    targets = list(models)
    shared = pool.sparkSession.sparkContext.broadcast([list(zip(models[t]["weights"], models[t]["platt"])) for t in targets])

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for part in (whole.iloc[start:start + SLICE_ROWS] for whole in parts for start in range(0, len(whole), SLICE_ROWS)):
            views, bucket, weight = rows_of(part), part["bucket"].to_numpy(), part["weight"].to_numpy()
            for t, own in enumerate(shared.value):
                for view, other in ((0, 1), (1, 0)):
                    score = chances(views[view], *own[view])
                    taught = views[other].take((score >= SURE) | (score <= 1 - SURE))
                    rows = np.flatnonzero((score >= SURE) | (score <= 1 - SURE))
                    if not len(rows):
                        continue
                    size, cell = taught.size, (score[rows] >= SURE) * GROUPS + bucket[rows]
                    key = cell[taught.row] * size + taught.index
                    unit = np.rint(weight[rows] * UNIT)
                    new = [
                        np.bincount(cell, unit, 2 * GROUPS),
                        np.bincount(key, unit[taught.row] * (taught.value != 0), 2 * GROUPS * size),
                        np.bincount(key, np.rint(weight[rows][taught.row] * taught.value * UNIT), 2 * GROUPS * size),
                    ]
                    old = held.setdefault((t, other), [np.zeros(len(x), np.int64) for x in new])
                    for x, y in zip(old, new):
                        x += y.astype(np.int64)
        for (t, other), (count, present, total) in held.items():
            size, slot = len(present) // (2 * GROUPS), (2 * t + other) * 2 * GROUPS
            cell = np.flatnonzero(count)
            yield pd.DataFrame({"slot": slot + cell, "feature": -1, "present": count[cell], "total": count[cell]})
            for one in cell.tolist():
                at = np.flatnonzero(present[one * size:(one + 1) * size])
                yield pd.DataFrame({"slot": slot + one, "feature": at, "present": present[one * size + at], "total": total[one * size + at]})

    by_task = pool.mapInPandas(sums, "slot int, feature int, present long, total long")
    found = by_task.groupBy("slot", "feature").agg(F.sum("present").alias("present"), F.sum("total").alias("total")).toArrow().to_pandas()  # at most 16 * GROUPS rows a feature
    out = {t: [Taught(TEXT_SIZE), Taught(PAGE_SIZE)] for t in targets}
    for slot, rows in found.groupby("slot"):
        t, other, label, bucket = np.unravel_index(int(slot), (len(targets), 2, 2, GROUPS))
        taught, feature = out[targets[t]][other], rows["feature"].to_numpy()
        whole = feature < 0
        taught.counts[label, bucket] = rows["present"].to_numpy()[whole].sum() / UNIT
        taught.present[label, bucket, feature[~whole]] = rows["present"].to_numpy()[~whole] / UNIT
        taught.total[label, bucket, feature[~whole]] = rows["total"].to_numpy()[~whole] / UNIT
    return out


def calibrate(weights: list[np.ndarray], held: list[Rows], truth: np.ndarray) -> dict:
    """The views' weights, their calibrations, and the combination."""
    platt = [dense_fit(h.times(w)[:, None], truth) for h, w in zip(held, weights)]
    calibrated = np.column_stack([h.times(w) * c[0] + c[1] for h, w, c in zip(held, weights, platt)])
    return {"weights": weights, "platt": platt, "mix": dense_fit(calibrated, truth)}


def combined(model: dict, views: list[Rows]) -> np.ndarray:
    z = np.column_stack([v.times(w) * c[0] + c[1] for v, w, c in zip(views, model["weights"], model["platt"])])
    return 1 / (1 + np.exp(-np.clip(z @ model["mix"][:-1] + model["mix"][-1], -30, 30)))


def byte_slices(texts: pa.Array, limit: int) -> Iterator[slice]:
    """Runs of rows whose texts hold ``limit`` bytes at most, one row at least."""
    return runs_of(pc.binary_length(texts).to_numpy(zero_copy_only=False), limit)


def feature_lists(part: pd.DataFrame | dict[str, list]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Of each view, the feature numbers and values of each row."""
    rows = list(zip(part["text"], part["lang"], part["source"], part["n_chars"]))
    words = [r[0].split() for r in rows]
    number_words(set().union(*words))
    return [[text_features(own) for own in words], [page_features(*r) for r in rows]]


def views_of(part: pd.DataFrame | dict[str, list]) -> list[Rows]:
    text, page = feature_lists(part)
    return [Rows(text, TEXT_SIZE), Rows(page, PAGE_SIZE)]


def rows_of(part: pd.DataFrame | dict) -> list[Rows]:
    """The views of rows of the written features."""
    return [Rows(list(zip(part["words"], part["word_values"])), TEXT_SIZE), Rows(list(zip(part["page"], part["page_values"])), PAGE_SIZE)]


def known_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


FEATURES = "words array<int>, word_values array<float>, page array<int>, page_values array<float>"


def _features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The written features, a slice of texts at a time; only a slice is held as Python strings and arrays."""
    kept = ["doc_id", "text_id", "bucket"]
    for part in parts:
        for some in byte_slices(part["text"], SLICE_CHARS):
            rows = part.slice(some.start, some.stop - some.start)
            words, pages = feature_lists({c: rows[c].to_pylist() for c in ("text", "lang", "source", "n_chars")})
            columns = [rows[c] for c in kept]
            for own in (words, pages):
                ends = pa.array(np.cumsum([0, *(len(i) for i, _ in own)]), pa.int32())
                columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in zip(zip(*own), (pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "words", "word_values", "page", "page_values"])


def features(docs: DataFrame) -> DataFrame:
    """The features of every document, written to the shared work folder."""
    schema = f"doc_id long, text_id long, bucket int, {FEATURES}"
    rows = known_columns(docs).withColumns({"text_id": F.xxhash64("text"), "bucket": F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(GROUPS)).cast("int")})
    path = work_dir(docs.sparkSession, "quality")
    rows.mapInArrow(_features, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict:
    """Models by target: quality, toxic."""
    return learn(features(docs), labels, labelled)


def learn(found: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict:
    """Models by target from the written features of all documents."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic")).filter("doc_id is not null")
    # The rows of smallest hash: Spark keeps that many per task, never all.
    chosen = labels.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id", "quality", "toxic").limit(labelled)
    rows = found.join(F.broadcast(chosen), "doc_id").dropDuplicates(["text_id", "quality", "toxic"])  # copies are no further evidence
    rows = rows.orderBy(F.xxhash64("text_id", F.lit(4)), "quality", "toxic").limit(labelled).toArrow().to_pandas()
    rows = rows.sort_values(["text_id", "quality", "toxic"], ignore_index=True)
    views = rows_of(rows)
    known, models = {}, {}
    for target in ("quality", "toxic"):
        y = rows[target].to_numpy(np.float64)
        some = ~np.isnan(y)
        y, own = y[some], [v.take(some) for v in views]
        apart = np.arange(len(y)) % 4 == 3
        if min((y[~apart] > 0.5).sum(), (y[~apart] < 0.5).sum()) >= 2:
            checked = apart if min((y[apart] > 0.5).sum(), (y[apart] < 0.5).sum()) >= 2 else ~apart
            known[target] = [v.take(~apart) for v in own], y[~apart], [v.take(checked) for v in own], y[checked]
            models[target] = calibrate([fit(v, y[~apart]) for v in known[target][0]], *known[target][2:])
    if models:
        hot = found.groupBy("text_id").agg(F.count("*").alias("copies")).filter(F.col("copies") > max(1, found.count() / 1000))
        pool = found.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").join(F.broadcast(hot), "text_id", "left")
        pool = pool.select("bucket", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight"), "words", "word_values", "page", "page_values")
        for _ in range(rounds):
            taught = teach(pool, models)
            models = {t: calibrate([fit(v, known[t][1], own) for v, own in zip(known[t][0], taught[t])], *known[t][2:]) for t in models}
    return {t: models.get(t) for t in ("quality", "toxic")}


def scores(views: list[Rows], models: dict) -> np.ndarray:
    """Columns quality and toxic."""
    n = views[0].n
    return np.column_stack([combined(m, views) if m else np.full(n, empty) for m, empty in ((models["quality"], 1.0), (models["toxic"], 0.0))])


def scorer(docs: DataFrame, models: dict):
    """A column function of (text, lang, source, n_chars): a struct of quality and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("struct<quality: double, toxic: double>")
    def score(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in parts:
            own = dict(zip(("text", "lang", "source", "n_chars"), columns))
            out = [scores(views_of({k: v[some].to_pylist() for k, v in own.items()}), shared.value) for some in byte_slices(own["text"], SLICE_CHARS)]
            flat = np.concatenate(out) if out else np.zeros((0, 2))
            yield pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["quality", "toxic"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return score(text, F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def passes(score: Column) -> Column:
    return (score["quality"] >= 0.5) & (score["toxic"] < 0.5)


def feature_scorer(found: DataFrame, models: dict) -> Column:
    """A struct of quality and toxic from the written features."""
    shared = found.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("quality double, toxic double")
    def score(words: pd.Series, word_values: pd.Series, page: pd.Series, page_values: pd.Series) -> pd.DataFrame:
        own = {"words": words, "word_values": word_values, "page": page, "page_values": page_values}
        out = [scores(rows_of({k: v.iloc[start:start + SLICE_ROWS] for k, v in own.items()}), shared.value) for start in range(0, len(words), SLICE_ROWS)]
        flat = np.concatenate(out) if out else np.zeros((0, 2))
        return pd.DataFrame({"quality": flat[:, 0], "toxic": flat[:, 1]})

    return score("words", "word_values", "page", "page_values")


@LLM.query("op4_quality")
def op4_quality(t) -> DataFrame:
    found = features(t.documents)
    rows = found.select("doc_id", feature_scorer(found, learn(found, t.labels)).alias("score"))
    return rows.select("doc_id", F.col("score.quality").alias("quality"), F.col("score.toxic").alias("toxic"), passes(F.col("score")).alias("keep"))
