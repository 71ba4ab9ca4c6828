"""Minimax contiguous sharding with DataFrame functions only.

Rows with equal texts are one atomic group.  Groups stand in the order of their
texts' SHA-256, which is even by itself: a prefix of the digest deals them to
blocks without sampling, and neither a hot text nor a hot source gathers in a
block.  Within a block running sums come from a window, across blocks from a
window over one row per block (`16 ** BLOCK_DIGITS` rows, whatever the input).

A group may hold a third of all rows, so its rows are counted in `CELLS` cells
by a hash of the id; the window over a block sees cells, never rows.

The smallest feasible capacity is found by binary search, `FAN` capacities per
round: each is checked greedily, a shard at a time, by the last group end within
reach.  A step is one aggregate over the stored group ends, which stand in order, filtered to the
intervals in question, so Parquet's statistics leave the other pages unread; only those ends reach the driver.  The cuts are then made
within that capacity: as near to an equal share as the groups allow, but always
so that the rest still fits.

Cases: NULL text is empty (size 1), a NULL id sorts first, equal rows are
interchangeable, an empty table gives no rows, fewer groups than shards leave
shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.session import materialize

BLOCK_DIGITS = 3
CELLS = 256
FAN = 32


@dataclass
class Plan:
    """Shard k holds the groups that end in (cuts[k], cuts[k + 1]] on the line of summed sizes."""

    capacity: int
    cuts: list[int]


class _Ends:
    """The ends of the groups on the line of summed sizes, as questions to the stored table."""

    def __init__(self, groups: DataFrame, total: int, largest: int):
        self.groups, self.total, self.largest = groups, total, largest

    def last_upto(self, points: list[int]) -> list[int]:
        """For each point, the largest end (or 0) that is not beyond it."""
        out = [0 if p < self.total else self.total for p in points]
        ask = sorted({p for p in points if 0 < p < self.total})
        if not ask:
            return out
        end = F.col("group_end")
        # an end stands within the size of the largest group before every point
        near = F.lit(False)
        for p in ask:
            near = near | ((end > p - self.largest) & (end <= p))
        found = self.groups.where(near).agg(*[F.max(F.when(end <= p, end)).alias(f"e{i}") for i, p in enumerate(ask)]).head()
        at = {p: found[i] or 0 for i, p in enumerate(ask)}
        return [at.get(p, o) for p, o in zip(points, out, strict=True)]

    def first_from(self, point: int) -> int:
        """The smallest end (or 0) that is not before the point."""
        if point <= 0:
            return 0
        end = F.col("group_end")
        return self.groups.where((end >= point) & (end < point + self.largest)).agg(F.min(end)).head()[0]


def _feasible(ends: _Ends, capacities: list[int], shards: int) -> list[bool]:
    """Whether the groups fit in `shards` shards, filled greedily, for each capacity at once."""
    at = [0] * len(capacities)
    for _ in range(shards):
        at = ends.last_upto([a + c for a, c in zip(at, capacities, strict=True)])
    return [a >= ends.total for a in at]


def smallest_capacity(ends: _Ends, shards: int, fan: int = FAN) -> int:
    low = max(-(-ends.total // shards), ends.largest)  # nothing smaller can do
    high = -(-ends.total // shards) + ends.largest  # always enough
    while low < high:
        tried = sorted({low + (high - low) * i // fan for i in range(fan)})
        fits = _feasible(ends, tried, shards)
        if any(fits):
            k = fits.index(True)
            high = tried[k]
            low = tried[k - 1] + 1 if k else high
        else:
            low = tried[-1] + 1
    return high


def plan_shards(groups: DataFrame, shards: int) -> Plan:
    """Cuts over a stored table with `group_end` (a running sum) and `group_size`."""
    total, largest = groups.agg(F.max("group_end"), F.max("group_size")).head()
    if not total:
        return Plan(0, [0] * (shards + 1))
    ends = _Ends(groups, total, largest)
    capacity = smallest_capacity(ends, shards)
    # the earliest place of each cut from which the rest still fits, from the right
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(ends.first_from(earliest[-1] - capacity))
    earliest = earliest[::-1]  # earliest[k]: where cut k + 1 may stand at the left
    cuts = [0]
    for k in range(shards - 1):
        share = cuts[-1] + (total - cuts[-1]) // (shards - k)
        before, most = ends.last_upto([share, cuts[-1] + capacity])
        after = ends.first_from(share + 1) if share < total else total
        near = before if share - before <= after - share else after
        cuts.append(min(max(near, earliest[k], cuts[-1]), most))
    return Plan(capacity, [*cuts, total])


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: Column | None = None, block_digits: int = BLOCK_DIGITS, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`."""
    body = F.encode(F.coalesce(F.col("text") if text is None else text, F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).select(
        "doc_id",
        (F.octet_length("body") + 1).cast("long").alias("size"),
        F.crc32("body").alias("text_crc32"),
        F.sha2("body", 256).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("cell"),
    )
    rows = materialize(rows, "shard-rows")
    block = F.substring("digest", 1, block_digits)
    counted = rows.groupBy("digest", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("block", block)
    in_block = Window.partitionBy("block").orderBy("digest", "cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(
        counted.withColumn("bytes_before", F.coalesce(F.sum("bytes").over(in_block), F.lit(0)))
        .withColumn("rows_before", F.coalesce(F.sum("n").over(in_block), F.lit(0))),
        "shard-cells",
    )
    # one row per block: a fixed number of rows, so one task and a broadcast are safe
    blocks = placed.groupBy(F.col("block").alias("_block")).agg(F.sum("bytes").alias("_bytes"), F.sum("n").alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
    )
    placed = placed.join(F.broadcast(blocks), F.col("block") == F.col("_block")).select(
        "digest",
        "cell",
        "bytes",
        (F.col("bytes_before") + F.col("_bytes")).alias("bytes_before"),
        (F.col("rows_before") + F.col("_n")).alias("rows_before"),
    )
    # cells of a group are neighbours, so its end is the largest end among at most `cells` of them
    groups = placed.groupBy("digest").agg(
        F.max(F.col("bytes_before") + F.col("bytes")).alias("group_end"),
        F.sum("bytes").alias("group_size"),
        F.min("rows_before").alias("group_row"),
    )
    # in the order of their ends, so that a question reads the pages around its points only
    groups = materialize(groups.repartitionByRange("group_end").sortWithinPartitions("group_end"), "shard-groups")
    plan = plan_shards(groups, shards)
    number = F.lit(0)
    for cut in plan.cuts[1:-1]:
        number = number + F.when(F.col("group_end") > cut, 1).otherwise(0)
    of_group = groups.select(F.col("digest").alias("_digest"), number.cast("int").alias("shard"), "group_row")
    starts = of_group.groupBy(F.col("shard").alias("_shard")).agg(F.min("group_row").alias("shard_row"))
    bases = (
        placed.join(of_group, F.col("digest") == F.col("_digest"))
        .join(F.broadcast(starts), F.col("shard") == F.col("_shard"))  # one row per shard
        .select(F.col("digest").alias("_digest"), F.col("cell").alias("_cell"), "shard", (F.col("rows_before") - F.col("shard_row")).alias("base"))
    )
    inside = F.row_number().over(Window.partitionBy("digest", "cell").orderBy("doc_id")) - 1
    return (
        rows.withColumn("inside", inside)
        .join(bases, (F.col("digest") == F.col("_digest")) & (F.col("cell") == F.col("_cell")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("inside")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
