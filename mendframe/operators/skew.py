"""Joining rows to a keyed lookup when a few keys hold most of the rows.

The lookup knows how many rows carry each key (it was counted to build it), so
the hot keys are exact, and there cannot be many: at most `rows / hot_over`
keys can exceed `hot_over` rows.  Only that bounded list is broadcast, to give
each hot row a salt; the lookup repeats its hot entries once per salt and the
join stays an ordinary shuffle join with no large key left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot above this many rows, and above 1/10000 of the table, which
# bounds the broadcast list at 10 000 keys.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000


def hot_threshold(total_rows: int, hot_rows: int = HOT_ROWS) -> int:
    return max(hot_rows, total_rows // MAX_HOT_KEYS)


def join_to_counted(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    count_col: str,
    spread: Column,
    total_rows: int,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`rows` joined to `lookup` on `keys`; `lookup` has one row per key.

    `count_col` of the lookup is the number of rows with that key, `spread` an
    expression over `rows` that differs between rows of one key (the row id),
    and `total_rows` an upper bound on the number of rows.
    """
    threshold = hot_threshold(total_rows, hot_rows)
    if total_rows <= threshold:  # no key can be hot
        return rows.join(lookup, list(keys), how)
    buckets = F.ceil(F.col(count_col) / F.lit(threshold)).cast("int")
    hot = lookup.where(F.col(count_col) > threshold).select(*keys, buckets.alias("_buckets"))
    salted = (
        rows.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_buckets", F.lit(1))).cast("int"))
        .drop("_buckets")
    )
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(buckets, F.lit(1)) - 1)))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def left_join_spread(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    spread: Column,
    left_rows: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`left` left join `right` with the hot keys of `left` spread over salts.

    NULL keys match nothing and would all meet in one task, so they are spread
    as well.  The hot keys are counted first; there are at most
    `left_rows / threshold` of them, which bounds both broadcasts.
    """
    threshold = hot_threshold(left_rows, hot_rows)
    if left_rows <= threshold:
        return left.join(right, F.col(left_key) == F.col(right_key), "left")
    hot = (
        left.where(F.col(left_key).isNotNull())
        .groupBy(F.col(left_key).alias("_hot"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > threshold)
        .select("_hot", F.ceil(F.col("_n") / F.lit(threshold)).cast("int").alias("_buckets"))
    )
    buckets = F.when(F.col(left_key).isNull(), F.lit(MAX_HOT_KEYS)).otherwise(
        F.coalesce("_buckets", F.lit(1))
    )
    salted = (
        left.join(F.broadcast(hot), F.col(left_key) == F.col("_hot"), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), buckets).cast("int"))
        .drop("_hot", "_buckets")
    )
    repeated = (
        right.join(F.broadcast(hot), F.col(right_key) == F.col("_hot"), "left")
        .withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.coalesce("_buckets", F.lit(1)) - 1)))
        .drop("_hot", "_buckets")
    )
    match = (F.col(left_key) == F.col(right_key)) & (F.col("_salt") == F.col("_salt2"))
    return salted.join(repeated, match, "left").drop("_salt", "_salt2")
