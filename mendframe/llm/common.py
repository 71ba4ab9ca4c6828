"""What the operators share: words, batches, stored steps, ranks without one large group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def batches_of(batches: Iterable, rows: int = 256) -> Iterator[dict[str, list]]:
    """Python values of Arrow batches, `rows` rows at a time, so that few texts are held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()


def words_of(text: str) -> list[bytes]:
    """Words by `WORD`: bytes.split() splits at exactly those six characters."""
    return text.encode().split()


def null_key(name: str) -> Column:
    """A text column as a key in which NULL is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def with_keys(docs: DataFrame) -> DataFrame:
    """The rows as `whole` structs beside `k1` and `k2`, 128 bits by all columns.

    Rows meet their verdicts by these keys, so texts need not be stored again;
    rows with equal keys are equal and interchangeable.
    """
    # xxhash64 passes over a NULL, so its place is hashed too
    columns = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return docs.select(F.struct("*").alias("whole"), F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2"))


def meets(*names: str) -> Column:
    """Equal keys of a left side and a right side whose columns start with an underscore."""
    out = F.lit(True)
    for name in names:
        out = out & (F.col(name) == F.col(f"_{name}"))
    return out


def ranked(df: DataFrame, group: str, order: Sequence[str], out: str, cells: int = 256) -> DataFrame:
    """`out`: 0-based position of each row within `group`, gapless, without a group in one task.

    Rows of a group are dealt to `cells` cells by a hash of `order`; a cell's rows
    are numbered behind those of the cells before it.  Only (group, cell) counts
    meet per group: `cells` rows at most.  Equal rows are interchangeable.  `df` is
    evaluated twice, so it should be stored.
    """
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = dealt.groupBy(F.col(group).alias("_g"), F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)) - 1
    numbered = dealt.withColumn("_in", inside)
    match = (F.col(group) == F.col("_g")) & (F.col("_cell") == F.col("_c"))
    joined = numbered.join(bases, match)
    return joined.withColumn(out, (F.col("_base") + F.col("_in")).cast("long")).drop("_g", "_c", "_cell", "_in", "_base")
