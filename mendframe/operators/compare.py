"""Before/after comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions import cells
from mendframe.operators.frequency import quoted, types_of


def changes(before: DataFrame, after: DataFrame, id_col: str = "id", beside: Sequence[str] = ()) -> DataFrame:
    """(row_id, column, change, before, after).

    `changed` has one row per differing cell, and one per filled cell of a column
    that `before` lacks; `dropped` has one per filled cell of a column that `after`
    lacks; a row on one side only gives one
    `removed` or `added` row without a column.  The versions join once on the
    id in wide form, and only differing cells are unfolded.  Columns of `before` named
    `beside` are not compared but stand beside each change of their row, so that
    what is known of a row needs no further join.
    """
    known = before.select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(beside)], "*").drop(*beside)
    before = before.drop(*beside)
    b_types, a_types = types_of(before), types_of(after)
    shared = [c for c in after.columns if c in b_types and c != id_col]
    gained = [c for c in after.columns if c not in b_types and c != id_col]
    lost = [c for c in before.columns if c not in a_types and c != id_col]
    left = known.select(
        quoted(id_col).cast("long").alias("row_id"),
        F.lit(True).alias("_in_before"),
        *[quoted(c).alias(f"_b{i}") for i, c in enumerate(shared)],
        *[quoted(c).alias(f"_l{i}") for i, c in enumerate(lost)],
        *[f"_k{i}" for i in range(len(beside))],
    )
    right = after.select(
        quoted(id_col).cast("long").alias("row_id"),
        F.lit(True).alias("_in_after"),
        *[quoted(c).alias(f"_a{i}") for i, c in enumerate(shared)],
        *[quoted(c).alias(f"_g{i}") for i, c in enumerate(gained)],
    )
    joined = left.join(right, "row_id", "full")
    both = F.col("_in_before") & F.col("_in_after")

    def entry(column, change, b, a):
        return F.struct(
            column.cast("string").alias("column"),
            F.lit(change).alias("change"),
            b.cast("string").alias("before"),
            a.cast("string").alias("after"),
        )

    nothing = F.lit(None)
    found = [
        F.when(F.col("_in_after").isNull(), entry(nothing, "removed", nothing, nothing)),
        F.when(F.col("_in_before").isNull(), entry(nothing, "added", nothing, nothing)),
    ]
    for i, c in enumerate(shared):
        b, a = F.col(f"_b{i}"), F.col(f"_a{i}")
        # equal values need no parsing, and most cells are equal
        differs = ~F.coalesce(b.eqNullSafe(a), F.lit(False)) if b_types[c] == a_types[c] else F.lit(True)
        differs = F.coalesce(both, F.lit(False)) & differs & ~cells.values_match(b, b_types[c], a, a_types[c])
        found.append(F.when(differs, entry(F.lit(c), "changed", b, a)))
    shown = F.coalesce(both, F.lit(False))
    for i, c in enumerate(gained):
        new = F.col(f"_g{i}")
        found.append(F.when(shown & cells.not_null_like(new, a_types[c]), entry(F.lit(c), "changed", nothing, new)))
    for i, c in enumerate(lost):
        old = F.col(f"_l{i}")
        found.append(F.when(shown & cells.not_null_like(old, b_types[c]), entry(F.lit(c), "dropped", old, nothing)))
    return (
        joined.select("row_id", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(beside)], F.explode(F.array(*found)).alias("x"))
        .where(F.col("x").isNotNull())
        .select("row_id", "x.*", *map(quoted, beside))
    )


def cell_diff(before: DataFrame, after: DataFrame, id_col: str = "id") -> DataFrame:
    """(row_id, column, before, after) of every cell whose value changed."""
    return changes(before, after, id_col).where(F.col("change").isin("changed", "dropped")).drop("change")
