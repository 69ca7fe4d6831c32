"""Approximate nearest neighbours by multiprobe p-stable hashing.

The measure is the inner product. Vectors are taken apart by norm, each range going down to half its greatest, and in a range they
are scaled by its greatest norm. Each of ``tables`` tables of a range hashes a vector to ``functions`` cells
``floor((a . x + b) / width)``. A query's k-th best score on the ``SAMPLE`` vectors of smallest hash is no more than its k-th
best on all; ranges whose norms cannot reach it are left out. In any other, with that score being the share c of the range's norm, all
neighbours lie within ``sqrt(1 - c * c)`` of the point at c on the query's direction, whatever the data. A query does
not only visit that point's bucket: for every bucket around it the chance that a vector at this
distance falls there is known (a product of normal integrals over the cells), and the query visits the buckets of all tables of
the range in the order of that chance by cost until the chance of having missed such a vector in every table is below ``1 - success``.

Vectors and visits of a bucket meet as blocks of bounded size, in one matrix product; the scores of a block's best
are then computed pair by pair in double precision, and a window keeps the k best of each query over all
blocks. Queries with fewer than k found visit all buckets of the first table of each range, so small tables are searched whole.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with a null vec_id;
vectors of different lengths never meet. Of equal vectors only the k + 1 smallest ids are indexed: no other can be
among the k nearest, ties going to the smaller id; all of them are queries if their ids are. Repeated rows count
once. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclake.llm.common import cut
from civiclake.llm.suite import LLM

K = 20
LARGEST = 1.7976931348623157e308  # of doubles
TABLES = 6
FUNCTIONS = 3
WIDTH = 1.3
SUCCESS = 0.98
SAMPLE = 4_096
VISIT = 1e-3  # cost of a visit, as a share of all vectors
LEAST = 1e-3  # of a radius: rounding moves equal vectors across an edge
BLOCK = 4_096
SEED = 20

FOUND = "query_id long, vec_id long, score double"


def usable(embeddings: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vector (array of double), once each."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(column.to_list()).reshape(len(column), dim)


class Hashes:
    """The tables' projections for vectors of one length and range of norms."""

    def __init__(self, dim: int, greatest: float, tables: int, functions: int, width: float):
        random = np.random.default_rng([SEED, dim])
        self.a = random.standard_normal((dim, tables * functions))
        self.b = random.uniform(0, width, tables * functions)
        self.greatest, self.tables, self.functions, self.width = greatest, tables, functions, width

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Projections in cells: (vector, table, function); the integer part is the cell."""
        flat = ((vectors / self.greatest) @ self.a + self.b) / self.width
        return flat.reshape(len(vectors), self.tables, self.functions)

    def buckets(self, places: np.ndarray) -> np.ndarray:
        """One number per table from its cells."""
        cells = np.floor(places).astype(np.int64) + 512
        out = np.zeros(cells.shape[:-1], np.int64)
        for j in range(self.functions):
            out = out * 1024 + np.clip(cells[..., j], 0, 1023)
        return out


def _normal(x: np.ndarray) -> np.ndarray:
    grid = np.linspace(-8, 8, 4001)
    return np.interp(x, grid, _normal.table)


_normal.table = np.array([0.5 * (1 + erf(x / sqrt(2))) for x in np.linspace(-8, 8, 4001)])


def visits(hashes: Hashes, place: np.ndarray, radius: float, success: float, reach: int = 3) -> list[np.ndarray]:
    """The buckets one query visits, per table, as numbers."""
    steps = np.arange(-reach, reach + 1)
    cell = np.floor(place)

    def boxes(centre: np.ndarray, spread: float) -> np.ndarray:
        """The chance of each bucket for vectors normal around a place: (table, bucket)."""
        low = (cell[..., None] + steps - centre[..., None]) * hashes.width / spread
        each = _normal(low + hashes.width / spread) - _normal(low)  # (table, function, step)
        out = each[:, 0]
        for j in range(1, hashes.functions):
            out = (out[:, :, None] * each[:, j][:, None, :]).reshape(hashes.tables, -1)
        return out

    joint = boxes(place, radius)
    # What a visit costs: itself, and the vectors there if all lie evenly around zero; this only sets the order.
    cost = VISIT + boxes(hashes.b.reshape(place.shape) / hashes.width, 1.0)
    order = np.argsort(-joint / cost, axis=None, kind="stable")
    table = order // joint.shape[1]
    # The chance to be missed by all tables, after each visit in that order.
    logs = np.zeros((hashes.tables, len(order)))
    gained = joint.ravel()[order]
    for t in range(hashes.tables):
        logs[t] = np.log(np.maximum(1e-12, 1 - np.cumsum(np.where(table == t, gained, 0))))
    missed = np.exp(logs.sum(0))
    stop = int(np.searchsorted(-missed, -(1 - success))) + 1
    grid = np.stack(np.meshgrid(*[steps] * hashes.functions, indexing="ij"), -1).reshape(-1, hashes.functions)
    chosen = order[:stop]
    return [hashes.buckets(cell[t] + grid[chosen[table[:stop] == t] % joint.shape[1]]) for t in range(hashes.tables)]


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Norms whose squares need not be finite."""
    most = np.abs(vectors).max(1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(1))


def _indexed(scales, tables, functions, width):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for (dim, one), rows in part.groupby([part["vector"].str.len(), "number"]):
                dim, one = int(dim), int(one)
                hashes = Hashes(dim, scales[dim, one], tables, functions, width)
                buckets = hashes.buckets(hashes.places(_matrix(rows["vector"], dim)))
                data = [x.tobytes() for x in rows["vector"]]
                for t in range(tables):
                    yield pd.DataFrame({"dim": dim, "tab": one * tables + t, "bucket": buckets[:, t], "vec_id": rows["vec_id"].to_numpy(), "data": data})

    return run


def _least(x: np.ndarray, ids: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """For each query (a unit vector), a score that its k-th best on all vectors reaches."""
    if sample is None or len(sample[0]) <= k:
        return np.full(len(x), -np.inf)
    with np.errstate(all="ignore"):
        score = np.nan_to_num(x @ sample[1].T, nan=-np.inf, posinf=LARGEST)
    score[ids[:, None] == sample[0][None, :]] = -np.inf
    return np.partition(score, -k, axis=1)[:, -k]


def _probing(shared, scales, tables, functions, width, success, k):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, rows in part.groupby(part["vector"].str.len()):
                for start in range(0, len(rows), 200):
                    some = rows.iloc[start:start + 200]
                    x, ids = _matrix(some["vector"], int(dim)), some["vec_id"].to_numpy()
                    unit = x / np.abs(x).max(1)[:, None]
                    unit /= _norms(unit)[:, None]  # only the direction of a query matters
                    least = _least(unit, ids, shared.value.get(int(dim)), k)
                    data = np.array([v.tobytes() for v in x], dtype=object)
                    for (length, one), scale in scales.items():
                        at = np.flatnonzero(least <= scale * (1 + 1e-9)) if length == dim else []
                        if not len(at):
                            continue
                        hashes = Hashes(int(dim), scale, tables, functions, width)
                        share = np.clip(least[at] / scale, 0, 1)
                        radius = np.sqrt(np.maximum(1 - share * share, LEAST**2))
                        places = hashes.places(unit[at] * (share * scale)[:, None])
                        found = [visits(hashes, place, r, success) for place, r in zip(places, radius)]
                        sizes = [[len(v) for v in tabs] for tabs in found]
                        each = [sum(v) for v in sizes]
                        yield pd.DataFrame({
                            "dim": int(dim), "tab": one * tables + np.concatenate([np.repeat(np.arange(tables), v) for v in sizes]),
                            "bucket": np.concatenate([v for tabs in found for v in tabs]),
                            "vec_id": np.repeat(ids[at], each), "data": np.repeat(data[at], each),
                        })

    return run


def _sampled(indexed: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: ids and vectors of the fixed sample."""
    rows = indexed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    return {int(dim): (some["vec_id"].to_numpy(np.int64), _matrix(some["vector"].map(np.asarray), int(dim))) for dim, some in rows.groupby(rows["vector"].str.len())}


def _blocks(rows: DataFrame, parts: int) -> DataFrame:
    """One row per bucket and part; a part is a fixed share of the ids."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("salt")
    packed = rows.groupBy("dim", "tab", "bucket", salt).agg(F.collect_list(F.struct("vec_id", "data")).alias("x"))
    return packed.select("dim", "tab", "bucket", F.col("x.vec_id").alias("ids"), F.col("x.data").alias("vectors"))


def _best(k: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, ids, vectors, q_ids, q_vectors in part[["dim", "ids", "vectors", "q_ids", "q_vectors"]].itertuples(index=False):
                ids, q_ids = np.asarray(ids, np.int64), np.asarray(q_ids, np.int64)
                x, q = (np.frombuffer(b"".join(v)).reshape(-1, dim) for v in (vectors, q_vectors))
                with np.errstate(all="ignore"):  # a product that is not a number takes no part
                    score = q @ x.T
                score[np.isnan(score)] = -np.inf
                score[q_ids[:, None] == ids[None, :]] = -np.inf
                at = min(k, len(ids)) - 1
                least = -np.partition(-score, at, axis=1)[:, at]
                # A margin above rounding keeps all ties of the last place.
                margin = np.where(np.isfinite(least), 1e-9 * np.abs(least), 0)
                row, col = np.nonzero((score >= (least - margin)[:, None]) & (score > -np.inf))
                with np.errstate(all="ignore"):
                    exact = (q[row] * x[col]).sum(1)
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                first = np.searchsorted(row, row)
                keep = np.arange(len(row)) - first < k
                yield pd.DataFrame({"query_id": q_ids[row[keep]], "vec_id": ids[col[keep]], "score": exact[keep]})

    return run


def _search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    visited = queries.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    return index.join(visited, ["dim", "tab", "bucket"]).mapInPandas(_best(k), FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a pair that several tables found counts once, its scores being equal."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= k).dropDuplicates(["query_id", "rank"])


def nearest(embeddings: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding",
            tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, success: float = SUCCESS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found of each row that ``is_query`` (a condition on vec_id) names."""
    rows = usable(embeddings, vec_id, embedding)
    size = F.array_max(F.transform("vector", F.abs))  # keeps the squares finite
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("size")) * (x / F.col("size")))
    # Components near the largest double have no finite norm; its logarithm is finite.
    rows = rows.withColumn("size", size).withColumn("share", F.sqrt(norm)).withColumn("log_norm", F.log2("size") + F.log2("share"))
    rows = rows.withColumn("norm", F.least(F.col("size") * F.col("share"), F.lit(LARGEST))).drop("size", "share")
    n, greatest = rows.agg(F.count("*"), F.max("log_norm")).first()
    # Range 0 goes down to half the greatest norm, range 1 to a quarter, and so on.
    rows = rows.withColumn("number", F.greatest(F.lit(0), F.floor(F.lit(greatest or 0.0) - F.col("log_norm"))).cast("int")).drop("log_norm")
    ranges = rows.groupBy(F.size("vector").alias("dim"), "number").agg(F.max("norm").alias("scale")).collect()  # a row per length and halving of the norm
    scales = {(r["dim"], r["number"]): r["scale"] for r in ranges}
    same = Window.partitionBy("vector").orderBy("vec_id")
    indexed = rows.withColumn("place", F.dense_rank().over(same)).filter(F.col("place") <= k + 1).dropDuplicates(["vector", "place"]).drop("place")
    asking = rows.filter(is_query).dropDuplicates(["vec_id", "vector"])
    settings = (scales, tables, functions, width)
    sample = rows.sparkSession.sparkContext.broadcast(_sampled(indexed))
    hashed = "dim int, tab int, bucket long, vec_id long, data binary"
    # A bucket holds a twentieth of all vectors at most or so; parts keep a block near BLOCK rows.
    index = cut(_blocks(indexed.mapInPandas(_indexed(*settings), hashed), ceil(max(1, n) / 20 / BLOCK)))
    probes = asking.mapInPandas(_probing(sample, *settings, success, k), hashed)
    found = cut(_top(_search(_blocks(probes, ceil(max(1, n) / 20 / BLOCK)), index, k), k))
    counts = found.groupBy("query_id").count().filter(F.col("count") >= k)
    short = asking.join(counts, asking["vec_id"] == counts["query_id"], "left_anti")
    first = index.filter(F.col("tab") % tables == 0).select("dim", "tab", "bucket").distinct()
    flat = short.select(F.size("vector").alias("dim"), "vec_id", F.col("vector"))
    every = flat.join(first, "dim").mapInPandas(_as_data, hashed)
    rest = _top(_search(_blocks(every, 1), index, k), k)
    known = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return known.select("query_id", "rank", "vec_id", "score").union(rest.select("query_id", "rank", "vec_id", "score"))


def _as_data(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part[["dim", "tab", "bucket", "vec_id"]].assign(data=[x.tobytes() for x in part["vector"]])


@LLM.query("op8_nearest")
def op8_nearest(t) -> DataFrame:
    return nearest(t.embeddings, F.col("vec_id") % 20 == 0)
