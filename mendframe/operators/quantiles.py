"""Exact order statistics in two scans, without gathering a column in one task.

`percentile` and `percentile_disc` merge a histogram of every distinct value in
a single task.  Here a first scan makes one mergeable sketch per column, whose rank error is known: two of its
values bracket each wanted rank.  A second scan counts the values below and between the brackets as wholes and
those inside by value, and the rank is looked up among these few.  All columns and ranks share both scans, the answer is
exact whatever the distribution, and the sketch grows with the column so that a bracket holds a
bounded number of values (up to `FINEST`).

Should a bracket miss its rank, that rank is narrowed down instead: one aggregate counts the
values per bin of an interval, the bin that holds the rank becomes the next interval, and
an interval of few rows is counted by value.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1 << 16
EXACT_UP_TO = 200_000
ACCURACY = 10_000
FINEST = 1_000_000
INSIDE = 50_000  # values that a bracket may hold on average


@dataclass
class _Search:
    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int

    @property
    def interval(self):
        return (self.column, self.low, self.high, self.inside, self.below)

    @property
    def done(self) -> bool:
        return self.low == self.high


def values_at_ranks(
    df: DataFrame,
    numbers: Mapping[str, Column],
    ranks: Mapping[str, Iterable[int]],
    bounds: Mapping[str, tuple[float, float, int]],
    accuracy: int | None = None,
) -> dict[tuple[str, int], float]:
    """The 0-based `ranks` of each column's sorted numbers.

    `bounds` gives (min, max, count) per column, as the profile already holds
    them.  Returns one value per (column, rank); only those and the brackets reach the driver.
    """
    found: dict[tuple[str, int], float] = {}
    wanted = {}
    for c, some in ranks.items():
        low, high, _ = bounds[c]
        if low == high:
            found |= {(c, k): float(low) for k in some}
        elif some := sorted(set(some)):
            wanted[c] = some
    if wanted:
        found |= _between(df, numbers, wanted, _brackets(df, numbers, wanted, bounds, accuracy))
    missed = {c: [k for k in some if (c, k) not in found] for c, some in wanted.items()}
    return found | narrowed(df, numbers, missed, bounds)


def _brackets(df, numbers, ranks, bounds, accuracy) -> dict[str, list[tuple[float, float]]]:
    """Disjoint intervals per column that hold its ranks, from the sketches of one scan."""
    accuracy = accuracy or min(max(ACCURACY, max(int(bounds[c][2]) for c in ranks) // INSIDE), FINEST)
    # a sketch is off by one part in `accuracy` at most
    slack = 2.0 / accuracy
    shares = {}
    for c, some in ranks.items():
        n = bounds[c][2]
        shares[c] = [s for k in some for s in (max(0.0, k / n - slack), min(1.0, (k + 1) / n + slack))]
    row = df.agg(*[F.percentile_approx(numbers[c], s, accuracy).alias(f"n{i}") for i, (c, s) in enumerate(shares.items())]).head()
    out = {}
    for i, (c, s) in enumerate(shares.items()):
        ends = [bounds[c][0] if p == 0.0 else bounds[c][1] if p == 1.0 else v for p, v in zip(s, row[f"n{i}"], strict=True)]
        merged: list[tuple[float, float]] = []
        for low, high in sorted(zip(map(float, ends[::2]), map(float, ends[1::2]), strict=True)):
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        out[c] = merged
    return out


def _between(df, numbers, ranks, brackets) -> dict[tuple[str, int], float]:
    """The ranks that fall inside the brackets, from one scan that counts values in and between them."""
    columns = sorted(ranks)
    names = {c: f"n{i}" for i, c in enumerate(columns)}
    base = df.select(*[numbers[c].alias(names[c]) for c in columns])
    parts = []
    for i, c in enumerate(columns):
        v = F.col(names[c])
        # even numbers stand for what lies below, between and above, odd ones for the brackets
        place = F.lit(2 * len(brackets[c]))
        for j, (low, high) in reversed(list(enumerate(brackets[c]))):
            place = F.when(v < F.lit(low), F.lit(2 * j)).when(v <= F.lit(high), F.lit(2 * j + 1)).otherwise(place)
        key = F.when(place % 2 == 1, v.cast("double"))
        parts.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("part"), place.alias("place"), key.alias("key"))))
    cells = base.select(F.explode(F.array(*parts)).alias("x")).where("x IS NOT NULL").select("x.*")
    counted = cells.groupBy("part", "place", "key").agg(F.count(F.lit(1)).alias("n"))
    # the values inside a column's brackets, and a row for each stretch around them
    along = Window.partitionBy("part").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("n").over(along)).withColumn("before", F.col("upto") - F.col("n"))
    hits = [(F.col("part") == i) & (F.col("before") <= k) & (F.col("upto") > k) for i, c in enumerate(columns) for k in ranks[c]]
    rows = ranked.where("key IS NOT NULL").where(reduce(or_, hits)).select("part", "key", "before", "upto").collect()
    return {(c, k): r["key"] for i, c in enumerate(columns) for k in ranks[c] for r in rows if r["part"] == i and r["before"] <= k < r["upto"]}


def narrowed(
    df: DataFrame,
    numbers: Mapping[str, Column],
    ranks: Mapping[str, Iterable[int]],
    bounds: Mapping[str, tuple[float, float, int]],
    exact_up_to: int = EXACT_UP_TO,
    bins: int = BINS,
) -> dict[tuple[str, int], float]:
    """`values_at_ranks` by narrowing intervals, a scan per round."""
    todo = [
        _Search(c, k, *map(float, bounds[c][:2]), 0, int(bounds[c][2]))
        for c, wanted in ranks.items()
        for k in sorted(set(wanted))
    ]
    found: dict[tuple[str, int], float] = {}
    while todo:
        for s in todo:
            if s.done:
                found[(s.column, s.rank)] = s.low
        todo = [s for s in todo if not s.done]
        if todo:
            _narrow(df, numbers, todo, exact_up_to, bins)
    return found


def _narrow(df, numbers, searches, exact_up_to, bins) -> None:
    intervals = sorted({s.interval for s in searches})
    index = {iv: i for i, iv in enumerate(intervals)}
    columns = sorted({iv[0] for iv in intervals})
    # name the numbers once so that parsing text is not repeated per interval
    names = {c: f"n{i}" for i, c in enumerate(columns)}
    base = df.select(*[numbers[c].alias(names[c]) for c in columns])

    parts = []
    for i, (c, low, high, inside, _) in enumerate(intervals):
        v = F.col(names[c])
        if inside <= exact_up_to:
            key = v
        else:
            width = high - low
            # numbers are finite, but their distance may not be
            scaled = (
                (v - F.lit(low)) / F.lit(width)
                if width != float("inf")
                else v / F.lit(max(abs(low), abs(high)))
            )
            key = F.floor(scaled * F.lit(float(bins))).cast("double")
        parts.append(
            F.when(
                (v >= F.lit(low)) & (v <= F.lit(high)),
                F.struct(F.lit(i).alias("part"), key.alias("key"), v.alias("v")),
            )
        )
    inside = reduce(or_, [F.col(names[c]).between(low, high) for c, low, high, *_ in intervals])
    counted = (
        base.where(inside).select(F.explode(F.array(*parts)).alias("x"))
        .where(F.col("x").isNotNull())
        .groupBy(F.col("x.part").alias("part"), F.col("x.key").alias("key"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.col("x.v")).alias("low"),
            F.max(F.col("x.v")).alias("high"),
        )
    )
    # per interval at most `bins` or `exact_up_to` rows reach this window
    upto = F.sum("n").over(
        Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    wanted = None
    for s in searches:
        k = s.rank - s.below
        hit = (F.col("part") == index[s.interval]) & (F.col("before") <= k) & (F.col("upto") > k)
        wanted = hit if wanted is None else wanted | hit
    rows = ranked.where(wanted).select("part", "n", "low", "high", "before", "upto").collect()
    for s in searches:
        i, k = index[s.interval], s.rank - s.below
        hit = next(r for r in rows if r["part"] == i and r["before"] <= k < r["upto"])
        s.low, s.high = hit["low"], hit["high"]
        s.below, s.inside = s.below + hit["before"], hit["n"]


def near_ranks(
    df: DataFrame, numbers: Mapping[str, Column], ranks: Mapping[str, Iterable[int]], counts: Mapping[str, int], accuracy: int = ACCURACY
) -> dict[tuple[str, int], float]:
    """Values whose ranks are within `count / accuracy` of the wanted ones: sketches of all columns from one scan."""
    wanted = {c: sorted(set(k)) for c, k in ranks.items()}
    shares = {c: [(k + 1) / counts[c] for k in ks] for c, ks in wanted.items()}
    row = df.agg(*[F.percentile_approx(numbers[c], shares[c], accuracy).alias(f"n{i}") for i, c in enumerate(wanted)]).head()
    return {(c, k): v for i, (c, ks) in enumerate(wanted.items()) for k, v in zip(ks, row[f"n{i}"], strict=True)}


def median_ranks(n: int) -> tuple[int, int]:
    return ((n - 1) // 2, n // 2)


def quartile_ranks(n: int) -> tuple[int, int, int]:
    """Positions n//4, n//2 and 3n//4 of the sorted values."""
    return (n // 4, n // 2, (3 * n) // 4)
