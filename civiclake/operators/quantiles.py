"""Exact quantiles without gathering a column in one place."""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 2_000  # different or equal values of an interval that are looked at one by one


def bounds_below(bounds: Column, value: Column, most: int) -> Column:
    """How many of the sorted bounds are below the value, by halving steps."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at))


class _Line:
    """What is known of one column: cut points, and per interval between them how many values, from which to which."""

    def __init__(self):
        self.edges: list[float] = []
        self.known: dict[int, tuple[int, float, float]] = {}  # interval: count, least, greatest
        self.before: dict[int, int] = {0: 0}

    def holding(self, rank: int) -> int:
        return next(i for i, (n, _, _) in self.known.items() if self.before[i] <= rank < self.before[i] + n)

    def single(self, i: int) -> bool:
        n, low, high = self.known[i]
        return low == high or (math.isnan(low) and math.isnan(high))

    def cut(self, points: list[float]) -> None:
        self.edges = sorted({*self.edges, *points})


def _cut_points(values: list[float]) -> list[float]:
    """Each value as an interval of its own: a cut at it and one just below it."""
    out = []
    for v in values:
        out += [math.inf] if math.isnan(v) else [v, math.nextafter(v, -math.inf)]
    return [p for p in out if p != -math.inf]


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], buckets: int = 512, small: int = SMALL) -> DataFrame:
    """(column, prob, quantile) with linear interpolation between neighbours.

    A distributed selection: estimated quantiles around the wanted ranks cut a column into intervals, which one aggregation counts. Only the intervals that hold
    a wanted rank are looked at again, with cut points from their own values, until they hold one value or ``small`` values. A common value is an
    interval by itself, so every round makes the interval some hundred times smaller; a round is a scan and a shuffle of a row per task and
    interval. No value leaves its task before the last step. A column without values gives no row.
    """
    spark = df.sparkSession
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)
    ]))).where(F.col("value").isNotNull())

    def estimate(places: list[float]) -> Column:
        """Cut points on both sides of wanted places (shares of an interval's values)."""
        shares = sorted({min(1.0, max(0.0, p + j / buckets)) for p in places for j in (-3, -0.5, 0.5, 3)})
        return F.percentile_approx("value", shares, buckets * 4).alias("cuts")

    summary = [F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")]

    first = cells.groupBy("column").agg(*summary, estimate(probs)).collect()  # one row per column
    lines: dict[int, _Line] = {}
    wanted: dict[int, set[int]] = {}
    opened: dict[tuple[int, int], list[float]] = {}
    for row in first:
        line = lines[row["column"]] = _Line()
        line.known = {0: (row["n"], row["low"], row["high"])}
        places = [p * (row["n"] - 1) for p in probs]
        wanted[row["column"]] = {f(x) for x in places for f in (math.floor, math.ceil)}
        if row["n"] > small and not line.single(0):
            opened[row["column"], 0] = row["cuts"]

    def within(chosen: dict[int, list[int]]) -> DataFrame:
        """The values of chosen intervals, with the interval's number."""
        rows = [(c, lines[c].edges, sorted(own)) for c, own in chosen.items()]
        edges = spark.createDataFrame(rows, "column int, edges array<double>, own array<int>")
        most = max((len(r[1]) for r in rows), default=0)
        # The edges are a few thousand numbers made here.
        placed = cells.join(F.broadcast(edges), "column").withColumn("part", bounds_below(F.col("edges"), F.col("value"), max(1, most)))
        return placed.where(F.array_contains("own", F.col("part"))).select("column", "part", "value")

    while opened:
        parts: dict[int, list[int]] = {}
        for c in {c for c, _ in opened}:
            line = lines[c]
            old = line.edges
            line.cut([p for (column, _), cuts in opened.items() if column == c for p in _cut_points(cuts)])
            # Intervals keep their counts under their new numbers; opened ones fall into parts that are counted now.
            number = {i: (bisect_left(line.edges, old[i - 1]) + 1 if i else 0) for i in line.known}
            ends = {i: (bisect_left(line.edges, old[i]) if i < len(old) else len(line.edges)) for i in line.known}
            parts[c] = [p for i in line.known if (c, i) in opened for p in range(number[i], ends[i] + 1)]
            start = {number[i]: line.before[i] for i in line.known}
            line.known = {number[i]: k for i, k in line.known.items() if (c, i) not in opened}
            line.before = start
        counted: dict[int, dict[int, tuple]] = {}
        for r in within(parts).groupBy("column", "part").agg(*summary).collect():  # a row per interval
            counted.setdefault(r["column"], {})[r["part"]] = (r["n"], r["low"], r["high"])
        for c, found in counted.items():
            line, at = lines[c], 0
            for p in sorted(parts[c]):
                at = line.before.get(p, at)
                line.before[p] = at
                if p in found:
                    line.known[p] = found[p]
                    at += found[p][0]
        todo: dict[int, list[int]] = {}
        for c in parts:
            line = lines[c]
            held = {line.holding(rank) for rank in wanted[c]}
            todo[c] = [i for i in held if line.known[i][0] > small and not line.single(i)]
        todo = {c: own for c, own in todo.items() if own}
        places = [
            (rank - lines[c].before[i]) / lines[c].known[i][0] for c, own in todo.items() for rank in wanted[c] for i in [lines[c].holding(rank)] if i in own]
        opened = {(r["column"], r["part"]): r["cuts"] for r in within(todo).groupBy("column", "part").agg(estimate(places)).collect()} if todo else {}

    # What is left: intervals of one value, and of few values, which come here with their counts.
    few = {c: sorted({i for i in map(line.holding, wanted[c]) if not line.single(i)}) for c, line in lines.items()}
    few = {c: own for c, own in few.items() if own}
    values: dict[tuple[int, int], list[tuple[float, int]]] = {}
    if few:
        for r in within(few).groupBy("column", "part", "value").agg(F.count(F.lit(1)).alias("n")).orderBy("column", "part", "value").collect():
            values.setdefault((r["column"], r["part"]), []).append((r["value"], r["n"]))

    def at_rank(c: int, rank: int) -> float:
        line = lines[c]
        i = line.holding(rank)
        if line.single(i):
            return line.known[i][1]
        at = line.before[i]
        for value, n in values[c, i]:
            at += n
            if rank < at:
                return value
        raise AssertionError("an interval holds fewer values than counted")

    out = []
    for c, line in lines.items():
        total = sum(n for n, _, _ in line.known.values())
        for p in probs:
            place = p * (total - 1)
            low, high = at_rank(c, math.floor(place)), at_rank(c, math.ceil(place))
            out.append((columns[c], float(p), low if low == high else low + (high - low) * (place - math.floor(place))))
    return spark.createDataFrame(out, "column string, prob double, quantile double")
