"""Profiles and open issues kept up to date from the diff of two versions of a table.

The diff (`cell_changes`) is stored once.  From it follow the new profile and the issues that are still
open; neither reads a version of the table again.  Counts and moments can be inverted: what
the old cells added is taken off, what the new ones add is put on (means and squared deviations
combine as those of disjoint groups do, without large sums).  A minimum or maximum cannot: a
column is read again when its smallest or largest value went and no new value reaches as far.
Distinct counts are kept by a table of value counts, which the diff updates alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.functions import cells
from mendframe.operators import detect, frequency, profile as prof
from mendframe.operators.frequency import quoted, types_of
from mendframe.operators.profile import ColumnProfile, TableProfile

_TEXT = T.StringType()


def cell_changes(before: DataFrame, after: DataFrame, id_col: str = "id") -> DataFrame:
    """(row_id, column, change, before, after): every cell that is not exactly the same.

    `changed` rows name a column that both versions have; a row on one side only gives a `removed` or
    `added` row for each filled cell and one without a column, which stands for the row.  A
    column on one side only counts as empty on the other.  Values are text that gives the
    same numbers again.
    """
    b_types, a_types = types_of(before), types_of(after)
    columns = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c != id_col]

    def side(df, types, prefix):
        values = []
        for i, c in enumerate(columns):
            if c not in types:
                values.append(F.lit(None).cast("string").alias(f"{prefix}{i}"))
            else:
                # a float's own text is another double
                col = quoted(c).cast("double") if isinstance(types[c], T.FloatType) else quoted(c)
                values.append(F.when(cells.not_null_like(quoted(c), types[c]), col.cast("string")).alias(f"{prefix}{i}"))
        return df.select(quoted(id_col).cast("long").alias("row_id"), F.lit(True).alias(f"_in{prefix}"), *values)

    joined = side(before, b_types, "_b").join(side(after, a_types, "_a"), "row_id", "full")
    gone, new = F.col("_in_a").isNull(), F.col("_in_b").isNull()
    change = F.when(gone, F.lit("removed")).when(new, F.lit("added")).otherwise(F.lit("changed"))

    def entry(name: Column, b: Column, a: Column) -> Column:
        return F.struct(name.cast("string").alias("column"), b.cast("string").alias("before"), a.cast("string").alias("after"))

    nothing = F.lit(None)
    found = [F.when(gone | new, entry(nothing, nothing, nothing))]
    for i, c in enumerate(columns):
        b, a = F.col(f"_b{i}"), F.col(f"_a{i}")
        found.append(F.when(~b.eqNullSafe(a), entry(F.lit(c), b, a)))
    exploded = joined.select("row_id", change.alias("change"), F.explode(F.array(*found)).alias("x"))
    return exploded.where(F.col("x").isNotNull()).select("row_id", "x.column", "change", "x.before", "x.after")


def _side(name: str) -> list[Column]:
    text = F.col(name)
    x = cells.to_number(text, _TEXT)
    return [
        F.count(text).alias(f"{name}_present"),
        F.count(x).alias(f"{name}_castable"),
        F.count(F.when(cells.is_whole(x), 1)).alias(f"{name}_whole"),
        F.count(F.when(x >= 0, 1)).alias(f"{name}_non_negative"),
        F.avg(x).alias(f"{name}_mean"),
        F.var_pop(x).alias(f"{name}_var"),
        F.min(x).alias(f"{name}_min"),
        F.max(x).alias(f"{name}_max"),
    ]


def change_sums(diff: DataFrame) -> DataFrame:
    """One row per changed column, and one without a column that counts rows removed and added."""
    rows = [F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("removed", "added")]
    return diff.groupBy("column").agg(*rows, *_side("before"), *_side("after"))


def _without(n: int, mean: float, dev: float, k: int, k_mean: float | None, k_dev: float) -> tuple[int, float, float]:
    """Count, mean and summed squared deviations without a group of k values."""
    if not k:
        return n, mean, dev
    left = n - k
    if left <= 0:
        return 0, 0.0, 0.0
    rest = mean + (mean - k_mean) * k / left
    return left, rest, max(0.0, dev - k_dev - (k_mean - rest) ** 2 * k * left / n)


def _with(n: int, mean: float, dev: float, k: int, k_mean: float | None, k_dev: float) -> tuple[int, float, float]:
    """The same with a further group."""
    if not k:
        return n, mean, dev
    both = n + k
    return both, mean + (k_mean - mean) * k / both, dev + k_dev + (k_mean - mean) ** 2 * n * k / both


def _extreme(old: float | None, gone: float | None, new: float | None, pick) -> tuple[float | None, bool]:
    """The least (or largest) value after a change, and whether the column has to be read for it."""
    if old is None:
        return new, False
    best = old if new is None else pick(old, new)
    # what went reached as far as the old extreme, and nothing new does
    lost = gone is not None and pick(gone, old) == gone and best != new
    return best, lost


def _updated(p: ColumnProfile, dtype: T.DataType, rows: int, s) -> tuple[ColumnProfile, bool]:
    n, mean, dev = p.castable, p.mean or 0.0, (p.std or 0.0) ** 2 * p.castable
    n, mean, dev = _without(n, mean, dev, s["before_castable"], s["before_mean"], (s["before_var"] or 0.0) * s["before_castable"])
    n, mean, dev = _with(n, mean, dev, s["after_castable"], s["after_mean"], (s["after_var"] or 0.0) * s["after_castable"])
    low, low_lost = _extreme(p.min, s["before_min"], s["after_min"], min)
    high, high_lost = _extreme(p.max, s["before_max"], s["after_max"], max)
    present = p.present - s["before_present"] + s["after_present"]
    whole = p.whole - s["before_whole"] + s["after_whole"]
    out = replace(
        p,
        dtype=prof.logical_type(dtype, present, n, whole),
        row_count=rows,
        null_count=rows - present,
        castable=n,
        whole=whole,
        non_negative=p.non_negative - s["before_non_negative"] + s["after_non_negative"],
        # slots may have emptied; nothing is a safe lower bound
        hash_bits=None if p.hash_bits is None else 0,
        unique_count=None,
        mean=mean if n else None,
        std=(dev / n) ** 0.5 if n else None,
        min=low if n else None,
        max=high if n else None,
        median=None,
        mode=None,
        sample_values=None,
    )
    return out, bool(n) and (low_lost or high_lost)


def updated_profile(profile: TableProfile, diff: DataFrame, after: DataFrame, value_counts: DataFrame | None = None) -> TableProfile:
    """The profile of `after`, from that of the version before it and the stored diff.

    Of `after` itself only the types are used, and the columns whose extreme went are read.
    `value_counts` (already updated) gives distinct counts.  Medians, modes and samples are not kept.
    """
    sums = {r["column"]: r for r in change_sums(diff).collect()}  # one row per column
    moved = sums.pop(None, None)
    rows = profile.row_count + (moved["added"] - moved["removed"] if moved else 0)
    types, columns, again = types_of(after), {}, []
    nothing = {f"{side}_{k}": 0 for side in ("before", "after") for k in ("present", "castable", "whole", "non_negative")}
    nothing |= {f"{side}_{k}": None for side in ("before", "after") for k in ("mean", "var", "min", "max")}
    id_sums = nothing
    if moved:
        id_sums = _id_sums(diff)
    for c, t in types.items():
        p = profile.columns.get(c) or ColumnProfile(profile.table, c, "unknown", profile.row_count, profile.row_count, 0, 0, whole=0)
        columns[c], lost = _updated(p, t, rows, id_sums if c == profile.id_col else sums.get(c, nothing))
        if lost:
            again.append(c)
    out = TableProfile(profile.table, profile.id_col, rows, columns)
    if again:
        ends = after.agg(*[f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(prof.number_columns(after, again).values()) for f in (F.min, F.max)]).head()
        for i, c in enumerate(again):
            out = out.updated(c, min=ends[f"min{i}"], max=ends[f"max{i}"])
    if value_counts is not None:
        for r in value_counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect():
            if r["column"] in out.columns:
                out = out.updated(r["column"], unique_count=r["n"])
    return out


def _id_sums(diff: DataFrame):
    """Ids of whole rows as cells of the id column."""
    row = F.col("row_id").cast("string")
    rows = diff.where("column IS NULL")
    as_cells = rows.select(F.when(F.col("change") == "removed", row).alias("before"), F.when(F.col("change") == "added", row).alias("after"))
    return as_cells.agg(*_side("before"), *_side("after")).head()


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of the values of the given columns, long texts by their digest."""
    keys = {c: frequency.compact_key(frequency.as_text(df, c)) for c in columns}
    return frequency.long_cells(df, columns, keys).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def updated_value_counts(counts: DataFrame, diff: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`value_counts` after a change: reads the counts and the diff."""
    cells_ = diff.where(F.col("column").isin(list(columns)))
    move = F.array(F.struct(F.col("before").alias("value"), F.lit(-1).cast("long").alias("n")), F.struct(F.col("after").alias("value"), F.lit(1).cast("long").alias("n")))
    moved = cells_.select("column", F.explode(move).alias("m")).where("m.value IS NOT NULL")
    moved = moved.select("column", frequency.compact_key(F.col("m.value")).alias("value"), "m.n")
    summed = counts.unionByName(moved).groupBy("column", "value").agg(F.sum("n").alias("n"))
    return summed.where("n > 0")


def open_issues(issues: DataFrame, data: DataFrame, profile: TableProfile) -> DataFrame:
    """The issues with `remaining` as of the version they were found in: where keeping them begins."""
    return detect.issues_remaining(issues, data, profile)


def updated_issues(issues: DataFrame, diff: DataFrame, profile: TableProfile) -> DataFrame:
    """Issues with `remaining` after a change: only those are judged anew whose row or cell the diff names."""
    name = F.coalesce("column", F.lit(""))
    per_row = diff.groupBy(F.col("row_id").alias("_row")).agg(
        F.max(F.when(F.col("change") != "changed", F.col("change"))).alias("_moved"),
        # a column comes once per row
        F.map_from_entries(F.collect_list(F.when(F.col("column").isNotNull(), F.struct(name.alias("k"), F.col("after").alias("v"))))).alias("_cells"),
    )
    state = issues.join(per_row, F.col("row_id") == F.col("_row"), "left")
    touched = F.coalesce(F.map_contains_key("_cells", F.coalesce("column", F.lit(""))), F.lit(False))
    gone = F.coalesce(F.col("_moved") == "removed", F.lit(False))
    now = F.try_element_at("_cells", F.col("column"))
    still = detect.still_open(~gone, now.isNull(), cells.to_number(now, _TEXT), profile)
    kind = F.col("issue_type")
    # whether a row stands does not depend on its cells
    by_row = F.when(gone, F.lit(False)).otherwise(F.col("remaining"))
    judged = F.when(gone | (kind.isin(*detect.ROW_CHECKS) & ~gone), by_row).when(touched, F.coalesce(still, F.lit(False))).otherwise(F.col("remaining"))
    return state.select(*[quoted(c) for c in issues.columns if c != "remaining"], judged.alias("remaining"))
