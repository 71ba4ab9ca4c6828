"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted `target / source size` times.  The whole part
is certain; the fraction is a copy probability.  Fractions are paired within a
source: mass (probability times size) moves at random from one document to the
other until one of the two is integral, so that the source's total never changes
and each document keeps its expectation.  The one that is still fractional meets the next.

A source is dealt to cells of about `CELL` documents.  A cell leaves one fractional
document at most; residuals of `FAN` cells meet in a cell of the next level, and so on
up a reduction tree whose root leaves one document, rounded at random.  A hot
source has more cells and more levels, never a larger group; equal rows are counted
first and dealt evenly.  Documents go through
a cell from long to short; what a size class leaves is paired with all smaller
documents at once, so that what is left at last is small.

Cases: NULL texts have size zero and take nothing, NULL is the last source, a
source without words has target zero, rows that repeat an id are documents of
their own, an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendframe.llm.common import WORD, meets, null_key, with_keys
from mendframe.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 42
CELL = 2048
FAN = 64
ROUND = 1e-9


def pivot(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after pairing in order: all integral but one at most; sum(size * p) is unchanged."""
    p = p.astype(float).copy()
    size = size.astype(float)
    held = -1
    draws = rng.random(len(p))
    for i in range(len(p)):
        if not ROUND < p[i] < 1 - ROUND:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up = min((1 - p[held]) * a, p[i] * b)  # the most that the held one can take
        down = min(p[held] * a, (1 - p[i]) * b)  # the most that it can give
        # chosen so that both expectations stay
        mass = up if draws[i] * (up + down) < down else -down
        p[held] += mass / a
        p[i] -= mass / b
        for k in (held, i):
            if not ROUND < p[k] < 1 - ROUND:
                p[k] = round(p[k])
        held = held if 0 < p[held] < 1 else i if 0 < p[i] < 1 else -1
    return p


def pivot_by_size(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """`pivot` over sizes in descending order, one power of two after the other.

    What a class leaves is paired with all smaller documents together: it becomes
    integral, and they share the mass it takes or gives, as far as theirs suffices.
    So the one that is left at last is small, and the total comes near its target.
    """
    p = p.astype(float).copy()
    size = size.astype(float)
    edges = np.flatnonzero(np.diff(np.frexp(size)[1])) + 1
    held = np.zeros(0, dtype=int)
    for start, end in zip([0, *edges], [*edges, len(p)], strict=True):
        own = np.concatenate([held, np.arange(start, end)])
        p[own] = pivot(size[own], p[own], rng)
        held = own[(p[own] > 0) & (p[own] < 1)]
        rest = slice(end, len(p))
        if len(held) and end < len(p):
            r = held[0]
            take, give = (1 - p[r]) * size[r], p[r] * size[r]
            mass, slack = (p[rest] * size[rest]).sum(), ((1 - p[rest]) * size[rest]).sum()
            if take < mass and give < slack:
                if rng.random() < p[r]:
                    p[rest] *= 1 - take / mass
                    p[r] = 1.0
                else:
                    p[rest] += (1 - p[rest]) * (give / slack)
                    p[r] = 0.0
                held = held[:0]
    return p


def source_targets(stored: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, n, source_size, target) of stored (source, size) rows, itself stored."""
    sums = stored.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    # code point order over range partitions; only their counts meet in a task
    none = F.col("source").isNull().alias("none")
    spread = sums.withColumn("none", none).repartitionByRange("none", "source").withColumn("part", F.spark_partition_id())
    spread = materialize(spread, "mix-sources")
    parts = spread.groupBy(F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row per partition
    place = F.col("_base") + F.row_number().over(Window.partitionBy("part").orderBy("none", "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    weighed = spread.join(F.broadcast(bases), F.col("part") == F.col("_part")).withColumn("weight", weight)
    weighed = materialize(weighed.select("source", "n", "source_size", "weight"), "mix-weights")
    cap = F.col("source_size") * most
    total, weight_sum = weighed.agg(F.sum("source_size"), F.sum("weight")).head()
    if not total:
        return materialize(weighed.select("source", "n", "source_size", F.lit(0.0).alias("target")), "mix-targets")
    # the level at which sources fill up: those that would overflow are full, the rest share what is left
    level = share * total / weight_sum
    while True:
        full = cap < F.lit(level) * F.col("weight")
        held, free = weighed.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).head()
        higher = (share * total - held) / free if free else level
        if higher <= level:
            break
        level = higher
    return materialize(weighed.select("source", "n", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target")), "mix-targets")


def deal(counted: DataFrame) -> DataFrame:
    """Rows (k2, key, cells, m), each standing for `m` equal ones, as single rows with a `cell`.

    Equal rows go to consecutive cells, so that a cell has its share of them; those
    that share a cell become single rows only where the cell is.
    """
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least("m", "cells") - 1)).alias("_turn")
    spread = counted.select("*", turn).withColumn("cell", F.pmod(F.pmod("k2", "cells") + F.col("_turn"), F.col("cells")))
    times = F.floor(F.col("m") / F.col("cells")) + (F.col("_turn") < F.pmod("m", "cells")).cast("long")
    spread = materialize(spread.withColumn("_times", times).drop("m", "_turn"), "mix-dealt")
    once = spread.where("_times = 1").drop("_times")
    often = spread.where("_times > 1").repartition("key", "cell").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    return once.unionByName(often.drop("_times", "_copy"))


def round_copies(stored: DataFrame, seed: int = SEED, cell: int = CELL, fan: int = FAN, **shares) -> DataFrame:
    """Stored (k1, k2, doc_id, source, size) with source_size, target and whole `copies`."""
    targets = source_targets(stored, **shares).select(F.col("source").alias("_source"), "n", "source_size", "target")
    counted = stored.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    joined = counted.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long"))
    joined = joined.withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("base")).otherwise(0.0))
    joined = joined.withColumn("key", null_key("source")).withColumn("cells", F.ceil(F.col("n") / F.lit(cell)).cast("long"))
    # ids go through pandas as text: NULL and long ids stay what they are
    id_type = stored.schema["doc_id"].dataType
    joined = joined.withColumn("doc_id", F.col("doc_id").cast("string"))
    columns = ["k1", "k2", "doc_id", "source", "size", "source_size", "target", "base", "p"]
    level = materialize(deal(joined.select(*columns, "key", "cells", "m")), "mix-level")
    kind = {f.name: f.dataType.simpleString() for f in level.schema}
    schema = ", ".join(f"{c} {kind[c]}" for c in level.columns)
    decided = []
    depth = 0
    while True:
        here = depth

        def settle(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "k1", "k2"], ascending=[False, True, True], kind="stable")
            rng = np.random.default_rng([seed, zlib.crc32(group["key"].iloc[0].encode()), int(group["cell"].iloc[0]), here])  # noqa: B023
            p = pivot_by_size(group["size"].to_numpy(), group["p"].to_numpy(), rng)
            if group["cells"].iloc[0] == 1:  # the root
                p = np.where((p > 0) & (p < 1), rng.random() < p, p)
            return group.assign(p=p.astype(float))

        loose = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(level.where(~loose))
        if not level.where(loose).head(1):
            break
        settled = materialize(level.where(loose).groupBy("key", "cell").applyInPandas(settle, schema), "mix-settled")
        decided.append(settled.where(~loose))
        up = settled.where(loose).withColumn("cells", F.ceil(F.col("cells") / F.lit(fan)).cast("long"))
        level = up.withColumn("cell", F.floor(F.col("cell") / F.lit(fan)).cast("long"))
        if not level.head(1):
            break
        level, depth = materialize(level, "mix-level"), depth + 1
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    doc_id = F.col("doc_id").cast(id_type).alias("doc_id")
    return out.select("k1", "k2", doc_id, "source", "size", "source_size", "target", (F.col("base") + F.col("p")).cast("long").alias("copies"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(k1, k2, doc_id, source, size) of every row, stored."""
    whole = F.col("whole")
    size = F.coalesce(F.regexp_count(whole.getField(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = with_keys(docs).select(
        "k1", "k2", whole.getField(id_col).alias("doc_id"), whole.getField(source_col).cast("string").alias("source"), size.alias("size")
    )
    return materialize(rows, "mix-rows")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of `docs`."""
    copies = round_copies(_sized(docs, id_col, text_col, source_col), **options)
    return copies.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken (equal rows: as often as they are together)."""
    copies = round_copies(_sized(docs, id_col, text_col, source_col), **options)
    taken = copies.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    joined = with_keys(docs).join(materialize(taken, "mix-copies"), meets("k1", "k2"))
    once = joined.groupBy("k1", "k2").agg(F.first("whole").alias("whole"), F.first("copies").alias("copies"))
    return once.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("whole.*")
