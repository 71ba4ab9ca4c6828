"""Splitting a low-cardinality column off into a lookup table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendframe.functions import cells
from mendframe.operators.frequency import quoted, types_of
from mendframe.operators.profile import TableProfile

# Distinct counts that make a good, or an acceptable, dimension.
GOOD_SIZES = range(3, 16)
FALLBACK_SIZES = range(2, 21)
ORPHAN_OFFSET = 999


@dataclass(frozen=True)
class Dimension:
    column: str
    ref_column: str
    lookup_name: str
    lookup: DataFrame
    facts: DataFrame


def pick_column(profile: TableProfile) -> str | None:
    """The text or whole-number column with the fewest of 3 to 15 distinct values.

    Falls back to the first column with 2 to 20.  Needs distinct counts.
    """
    good = [
        p for p in profile.checked()
        if p.dtype in ("str", "unknown", "int") and p.unique_count in GOOD_SIZES
    ]
    if good:
        return min(good, key=lambda p: p.unique_count).column
    return next((p.column for p in profile.checked() if p.unique_count in FALLBACK_SIZES), None)


def extract(df: DataFrame, profile: TableProfile, column: str | None = None) -> Dimension | None:
    """Lookup (id, label) of a column, and the table with a `{column}_ref` key.

    Values that differ only in case or padding share an entry, labelled and
    numbered by first appearance.  The column has at most 20 distinct values,
    which bounds the lookup and its broadcast.
    """
    column = column or pick_column(profile)
    if column is None:
        return None
    if profile[column].unique_count not in FALLBACK_SIZES:
        raise ValueError(f"Column '{column}' needs 2 to 20 distinct values to become a lookup.")
    t = types_of(df)[column]
    col = quoted(column)
    folded = cells.fold_key(col, t)
    forms = (
        df.where(col.isNotNull())
        .groupBy(folded.alias("_key"), col.cast("string").alias("_label"))
        .agg(F.min(quoted(profile.id_col).cast("long")).alias("_first"))
    )
    entries = forms.groupBy("_key").agg(
        F.min_by("_label", "_first").alias("label"), F.min("_first").alias("_first")
    )
    # a window over the entries of the lookup, not over the table
    numbered = entries.withColumn(
        "id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first")).cast("long")
    )
    lookup = numbered.select("id", "label")
    ref = f"{column}_ref"
    facts = df.withColumn("_key", folded).join(
        F.broadcast(numbered.select("_key", F.col("id").alias(ref))), "_key", "left"
    )
    return Dimension(column, ref, f"{column}_context", lookup, facts.drop("_key"))
