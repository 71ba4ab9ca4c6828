"""Value frequencies of many columns in one shuffle.

All of these explode each row into its (column, value) cells and aggregate
immediately, so a task sends at most one row per distinct value it saw: a value
held by a third of the table costs one partial row per task, not a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.functions import cells

# Text longer than this is grouped by its SHA-256 digest instead of by itself,
# so distinct counts over documents shuffle 70 bytes per value.
DIGEST_OVER = 64


def types_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def quoted(name: str) -> Column:
    """Column reference that survives dots and blanks in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(df: DataFrame, name: str) -> Column:
    """The cell as text, NULL where it is null-like."""
    dtype = types_of(df)[name]
    col = quoted(name)
    return F.when(cells.not_null_like(col, dtype), col.cast("string"))


def compact_key(text: Column) -> Column:
    # a raw text never exceeds DIGEST_OVER, a tagged digest always does
    return F.when(
        F.length(text) > DIGEST_OVER, F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))
    ).otherwise(text)


def long_cells(df: DataFrame, columns: Sequence[str], values: dict[str, Column], *keep: Column) -> DataFrame:
    """Rows (keep..., column, value) for the given per-column expressions, NULLs dropped."""
    structs = [F.struct(F.lit(c).alias("column"), values[c].alias("value")) for c in columns]
    exploded = df.select(*keep, F.explode(F.array(*structs)).alias("cell"))
    names = [c for c in exploded.columns if c != "cell"]
    return exploded.select(
        *[quoted(n) for n in names], F.col("cell.column").alias("column"), F.col("cell.value").alias("value")
    ).where(F.col("value").isNotNull())


def value_frequencies(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(column, value, n, first_id) for every distinct non-null-like value."""
    cells_df = long_cells(
        df, columns, {c: as_text(df, c) for c in columns}, quoted(id_col).cast("long").alias("row_id")
    )
    return cells_df.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, unique_count), exact; columns without any value are absent."""
    keys = {c: compact_key(as_text(df, c)) for c in columns}
    return (
        long_cells(df, columns, keys)
        .groupBy("column", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("unique_count"))
    )


def modes(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(column, mode, n, first_id): the most frequent value, ties to the lowest id."""
    keys = {c: compact_key(as_text(df, c)) for c in columns}
    freq = (
        long_cells(df, columns, keys, quoted(id_col).cast("long").alias("row_id"))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"))
    )
    best = freq.groupBy("column").agg(
        F.max_by(F.struct("n", "first_id"), F.struct(F.col("n"), -F.col("first_id"))).alias("b")
    )
    # one row per column: the scan for the texts themselves is pruned to those ids
    winners = best.select("column", F.col("b.n").alias("n"), F.col("b.first_id").alias("first_id"))
    found = [tuple(r) for r in winners.collect()]
    winners = df.sparkSession.createDataFrame(found, winners.schema)
    rows = df.where(quoted(id_col).isin(sorted({first for *_, first in found if first is not None})))
    originals = long_cells(
        rows, columns, {c: as_text(df, c) for c in columns}, quoted(id_col).cast("long").alias("first_id")
    )
    return originals.join(F.broadcast(winners), ["column", "first_id"]).select(
        "column", F.col("value").alias("mode"), "n", "first_id"
    )
