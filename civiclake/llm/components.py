"""Distributed union-find, and links inside buckets of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.llm.common import batches, cut, runs_of


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's edges: each node beside the smallest of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for part in parts:
        for a, b in zip(part["a"].tolist(), part["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pd.DataFrame({"a": nodes, "b": [root(x) for x in nodes]}, dtype="int64")


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, written out, so that a join with it meets the edges through an exchange that can be split."""
    return cut(edges.groupBy("a").agg(F.min("b").alias("m")))


EDGES = 20_000  # of a spanning forest that a task joins


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id of its connected component, for every node of edges (a, b), both long.

    Each partition first joins its own edges to trees; stars then hook on to smaller ones until nothing moves
    (alternating large and small stars). Every step groups with map-side sums, and a node with very many neighbours
    is a skewed join that adaptive execution splits. The state is cut to the shared folder each round. Edges that lie thinly
    spread are put together to ``EDGES`` a task first: those of one task are stars at once.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").mapInPandas(_forest, "a long, b long").distinct())
    tasks = max(1, -(-edges.count() // EDGES))
    if tasks == 1 or tasks < edges.rdd.getNumPartitions():
        edges = edges.coalesce(tasks).mapInPandas(_forest, "a long, b long")
        if tasks == 1:
            return _centred(edges)
        edges = cut(edges.distinct())
    while not _stars(edges):
        both = _each(edges, ("a", "b"), ("b", "a"))
        large = cut(both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        small = large.join(_least(large), "a")
        edges = cut(_each(small, ("b", "m"), ("a", "m")).filter("a <> b").distinct())
    return _centred(edges)


def _centred(stars: DataFrame) -> DataFrame:
    return _each(stars, ("a", "b"), ("b", "b")).withColumnsRenamed({"a": "id", "b": "component"}).distinct()


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (a, b), one for each of the named pairs of columns of each row, in one reading."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])))


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one centre, and no centre hangs on another node."""
    sides = edges.selectExpr("inline(array(named_struct('node', a, 'up', 1, 'down', 0), named_struct('node', b, 'up', 0, 'down', 1)))")
    return sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


BLOCK = 1_024  # ids of a key that meet in one task
PAIRS = 50_000  # pairs that are looked at together
FEW = 8  # ids of a key up to which the pairs of many keys are looked at together
TOGETHER, PREPARED = 64, 400_000  # pairs of a block whose texts are prepared in one go, and characters of these
HELD = 2_000_000  # elements of prepared texts that a task keeps for its next comparisons


def crowded(keyed: DataFrame) -> DataFrame:
    """Of distinct rows (id, key): those whose key has several ids, with their number and the key's hub, the id of least hash.

    Ids that share several keys so share a hub too.
    Counts come before the join, so a hot key is summed in each map task and its join can be split.
    """
    hubs = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id")).alias("hub")).filter("n > 1"))
    return cut(keyed.join(hubs, "key").select("key", "id", "hub", "n"))


def linked(rows: DataFrame, items_of: Callable[[DataFrame], DataFrame], prepare: Callable, similar: Callable, least: float | None = None) -> DataFrame:
    """Components of ids that share a band and are similar: id, component.

    ``rows`` are (key, id, hub, n) of keys with several ids. ``items_of(ids)`` gives (id, data, bands) for a table of ids, bands
    being an array of long in fixed places that holds the id's keys (zero for none); ``prepare`` makes of a list of texts what ``similar`` compares. If it makes sorted sets of 64-bit hashes, and ``similar`` asks for a Jaccard similarity of ``least``,
    pairs whose sets are too different for it are told by counts before they are compared.
    A pair inside one component needs no comparison, so this takes two passes:

    1. Each id is compared with the hubs of its keys, each of them once.
    2. For all keys whose ids lie in several components, all pairs across components are compared, each pair in the first
       band it shares. Ids of a key meet in blocks of ``BLOCK``, and only passing pairs leave a task.

    So no link is lost, and a large group of copies is linear: its second pass finds one component.
    """
    items = cut(items_of(rows.select("id").distinct()))
    pairs = rows.filter("id <> hub").select("id", "hub").distinct()
    members = pairs.join(items.select("id", "data"), "id")
    centres = items.select(F.col("id").alias("hub"), F.col("data").alias("hub_data"))
    edges = cut(members.join(centres, "hub").mapInPandas(_with_hub(prepare, similar), "a long, b long"))
    known = cut(components(edges))
    placed = cut(rows.drop("hub").join(known, "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = cut(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = placed.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("n", "other")
    full = dealt.join(items, "id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    more = cut(full.select("key", "lo", "hi", "own", "component", "bands", "data").mapInPandas(_across(prepare, similar, least), "a long, b long"))
    if more.isEmpty():
        return known
    moved = cut(components(more)).toDF("component", "least")
    every = known.union(moved.select(F.col("component").alias("id"), "component")).distinct()
    return cut(every.join(moved, "component", "left").select("id", F.coalesce("least", "component").alias("component")))


def _with_hub(prepare, similar):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for some in batches(part["data"].tolist(), 400_000):
                rows = part.iloc[some]
                first, which = np.unique(rows["hub"].to_numpy(), return_index=True, return_inverse=True)[1:]
                centres = prepare(rows["hub_data"].iloc[first].tolist())
                keep = np.array([similar(centres[w], own) for w, own in zip(which.tolist(), prepare(rows["data"].tolist()))], dtype=bool)
                yield pd.DataFrame({"a": rows["id"].to_numpy()[keep], "b": rows["hub"].to_numpy()[keep]}, dtype="int64")

    return run


def _changes(part: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Where a run of equal values starts, the first row included."""
    values = part[columns].to_numpy()
    return np.append(0, np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1)


def whole_runs(parts: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole runs of sorted rows: a run that a batch leaves open goes to the next frame."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        if held and (held[-1][columns].to_numpy()[-1] != part[columns].to_numpy()[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        last = int(_changes(part, columns)[-1])
        if last:
            held.append(part.iloc[:last])
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        held.append(part.iloc[last:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _across(prepare, similar, least):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "lo", "hi"]
        for frame in whole_runs(parts, names):
            starts = _changes(frame, names)
            places = frame[names].to_numpy()[starts].tolist()
            columns = [frame[x].to_numpy() for x in ("own", "component", "bands", "data")]
            sizes = np.diff(np.append(starts, len(frame)))
            found_a, found_b = _passing_few(frame[names].to_numpy(), *columns, np.repeat(np.where(sizes <= FEW, starts + sizes, 0), sizes), prepare, similar)
            for place, start, end in zip(places, starts.tolist(), (starts + sizes).tolist()):
                if end - start > FEW:
                    a, b = _passing(*place, *[x[start:end] for x in columns], prepare, similar, least)
                    found_a += a
                    found_b += b
            yield pd.DataFrame({"a": found_a, "b": found_b}, dtype="int64")

    return run


CELLS = 256  # parts of the space of hashes in which the elements of a set are counted


def _profile(texts: list[str], prepare) -> tuple[np.ndarray, np.ndarray]:
    """How many elements each text's set has in each cell, and in all."""
    out = []
    for some in batches(texts, 400_000):
        sets = prepare(texts[some])
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        cell = (np.concatenate(sets).astype(np.uint64) >> np.uint64(56)).astype(np.int64)
        out.append(np.bincount(np.repeat(np.arange(len(sets)) * CELLS, sizes) + cell, minlength=len(sets) * CELLS).reshape(-1, CELLS))
    counts = np.concatenate(out)
    return counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32), counts.sum(1)


def _possible(counts: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs can reach the similarity: two sets share in each cell no more than the smaller of their counts."""
    out = np.empty(len(i), bool)
    for start in range(0, len(i), 20_000):
        a, b = i[start:start + 20_000], j[start:start + 20_000]
        shared = np.minimum(counts[a], counts[b]).sum(1, dtype=np.int64)
        out[start:start + 20_000] = shared >= least * (sizes[a] + sizes[b] - shared) - 1e-6
    return out


def _passing_few(places, own, component, bands, data, ends, prepare, similar) -> tuple[list[int], list[int]]:
    """As ``_passing``, for all rows of a frame at once; ``ends`` tells where the run of a row ends, and is 0 for those left out."""
    row = np.arange(len(ends))
    left = np.concatenate([row[:0], *(row[row + d < ends] for d in range(1, FEW))])
    right = left + np.concatenate([row[:0], *(np.full(int((row + d < ends).sum()), d) for d in range(1, FEW))])
    todo = (component[left] != component[right]) & ((places[left, 1] == places[left, 2]) | (own[left] != own[right]))
    left, right = left[todo], right[todo]
    if not len(left):
        return [], []
    used, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    stacked = np.stack(bands[used])
    one, two = stacked[at[:len(left)]], stacked[at[len(left):]]
    same = (one == two) & (one != 0)
    mine = one[np.arange(len(left)), same.argmax(1)] == places[left, 0]  # each pair belongs to the first band it shares
    left, right, shared = left[mine], right[mine], same[mine].sum(1)
    order = np.argsort(-shared, kind="stable")
    found_a, found_b = [], []
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pairs = list(zip(left[order].tolist(), right[order].tolist()))
    lengths = np.array([len(data[p]) + len(data[q]) for p, q in pairs])
    for some in runs_of(lengths, HELD):
        open_pairs = [(p, q) for p, q in pairs[some] if top(int(component[p])) != top(int(component[q]))]
        texts = list(dict.fromkeys(data[n] for pair in open_pairs for n in pair))
        sets = dict(zip(texts, (x for part in batches(texts, 400_000) for x in prepare(texts[part]))))
        for p, q in open_pairs:
            u, v = top(int(component[p])), top(int(component[q]))
            if u != v and similar(sets[data[p]], sets[data[q]]):
                root[max(u, v)] = min(u, v)
                found_a.append(int(component[p]))
                found_b.append(int(component[q]))
    return found_a, found_b


def _passing(key, lo, hi, own, component, bands, data, prepare, similar, least) -> tuple[list[int], list[int]]:
    """Pairs of components that similar texts of a block pair connect, without those that earlier pairs connect."""
    names, component = np.unique(component, return_inverse=True)
    if len(names) == 1:
        return [], []
    bands = np.stack(bands)
    left = np.flatnonzero(own == lo)
    right = np.flatnonzero(own == hi)
    todo = component[left][:, None] != component[right][None, :]
    if lo == hi:
        todo = np.triu(todo, 1)
    row, col = np.nonzero(todo)
    found_a, found_b = [], []
    prepared: dict[int, np.ndarray] = {}
    held = 0
    root = np.arange(component.max() + 1)
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    profile = None

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    for start in range(0, len(row), PAIRS):
        i, j = left[row[start:start + PAIRS]], right[col[start:start + PAIRS]]
        same = (bands[i] == bands[j]) & (bands[i] != 0)
        mine = bands[i, same.argmax(1)] == key  # each pair belongs to the first band it shares
        i, j, shared = i[mine], j[mine], same[mine].sum(1)
        if not len(i):
            continue
        if least is not None and profile is None and len(i) > 4:
            profile = _profile(data.tolist(), prepare)
        if profile is not None:
            may = _possible(*profile, i, j, least)
            i, j, shared = i[may], j[may], shared[may]
        order = np.argsort(-shared, kind="stable")
        i, j = i[order], j[order]
        for now in runs_of(np.maximum(lengths[i] + lengths[j], PREPARED // TOGETHER), PREPARED):
            pairs = [(p, q) for p, q in zip(i[now].tolist(), j[now].tolist()) if top(component[p]) != top(component[q])]
            if held > HELD:
                prepared.clear()
                held = 0
            texts = list(dict.fromkeys(n for pair in pairs for n in pair if n not in prepared))
            for n, ready in zip(texts, prepare([data[n] for n in texts])):
                prepared[n] = ready
                held += len(ready)
            for p, q in pairs:
                u, v = top(component[p]), top(component[q])
                if u != v and similar(prepared[p], prepared[q]):
                    root[max(u, v)] = min(u, v)
                    found_a.append(int(names[component[p]]))
                    found_b.append(int(names[component[q]]))
    return found_a, found_b
