"""Repairs: every function takes a table and returns a new one.

Rules that depend on the cell alone (fill, absolute value, tidy text, dominant
spelling) are rewritten in place in one narrow pass.  Lists of fixes for single
cells are grouped per row and joined once on the row id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions import cells
from mendframe.operators import detect, profile as prof
from mendframe.operators.detect import Rules
from mendframe.operators.frequency import quoted, types_of
from mendframe.operators.profile import TableProfile

# Fixed values of the imputation policy.
MOSTLY_NULL = 0.70
UNKNOWN_TEXT = "Unknown"

FIX_SCHEMA = "row_id long, column string, value string, step long"


@dataclass(frozen=True)
class FixReport:
    """Outcome of a batch of cell fixes, as tables; `rejected` holds values that do not fit their column."""

    table: DataFrame
    unknown_rows: DataFrame
    unknown_columns: DataFrame
    rejected: DataFrame


def fixes_per_row(fixes: DataFrame) -> DataFrame:
    """(row_id, fixes map<column, value>): the last fix of each cell wins.

    A row gets at most one entry per column, so the map is bounded by the
    width of the table however many fixes were sent for one cell.
    """
    step = F.col("step") if "step" in fixes.columns else F.lit(0)
    last = fixes.groupBy("row_id", "column").agg(F.max_by(F.struct("value"), step).alias("fix"))
    return last.groupBy("row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.col("fix.value")))).alias("fixes")
    )


def apply_fixes(df: DataFrame, fixes: DataFrame, id_col: str = "id") -> DataFrame:
    """`df` with the cells named in `fixes(row_id, column, value[, step])` replaced.

    A NULL value empties the cell.  Values take the type of their column, and an
    integral column becomes double when a fix is not whole.  Fixes for unknown rows
    or columns and values that do not fit have no effect (see `fix_report`).
    """
    types = types_of(df)
    known = [c for c in df.columns if c != id_col]
    targets = _targets(df, fixes, known)
    per_row = fixes_per_row(fixes.where(F.col("column").isin(known)))
    joined = df.join(per_row, quoted(id_col).cast("long") == per_row["row_id"], "left")
    out = []
    for c in df.columns:
        if c == id_col:
            out.append(quoted(c))
            continue
        fixed = F.map_contains_key("fixes", c)
        given = F.try_element_at("fixes", F.lit(c))
        value = cells.as_column_type(given, targets[c])
        old = quoted(c) if targets[c] == types[c] else quoted(c).cast(targets[c])
        out.append(F.when(fixed & (value.isNotNull() | given.isNull()), value).otherwise(old).alias(c))
    return joined.select(*out)


def _targets(df: DataFrame, fixes: DataFrame, known: Sequence[str]) -> dict:
    """The column types after the fixes; at most one row per column reaches the driver."""
    types = types_of(df)
    whole = [c for c in known if cells.is_integral(types[c])]
    if not whole:
        return types
    number = F.col("value").try_cast("double")
    split = fixes.where(F.col("column").isin(whole) & ~cells.is_whole(number) & (F.abs(number) < float("inf")))
    return cells.widened(types, {r["column"]: 0.5 for r in split.select("column").distinct().collect()})


def fix_report(df: DataFrame, fixes: DataFrame, id_col: str = "id") -> FixReport:
    """`apply_fixes` together with the fixes that named no row or no column, or did not fit."""
    ids = df.select(quoted(id_col).cast("long").alias("row_id"))
    known = [c for c in df.columns if c != id_col]
    targets = _targets(df, fixes, known)
    # one branch per type, however many columns there are
    by_type: dict = {}
    for c in known:
        by_type.setdefault(targets[c], []).append(c)
    misfit = F.lit(False)
    for t, names in by_type.items():
        misfit = F.when(F.col("column").isin(names), cells.as_column_type(F.col("value"), t).isNull()).otherwise(misfit)
    return FixReport(
        apply_fixes(df, fixes, id_col),
        fixes.join(ids, "row_id", "left_anti"),
        fixes.where(~F.col("column").isin(known)),
        fixes.where(F.col("value").isNotNull() & misfit),
    )


def delete_rows(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """`df` without the rows whose id is in `ids(row_id)`."""
    gone = ids.select(F.col("row_id").alias("_gone"))
    return df.join(gone, quoted(id_col).cast("long") == F.col("_gone"), "left_anti")


def _bulk_fix(df: DataFrame, p: prof.ColumnProfile, value) -> dict[str, Column]:
    """The conditions and results of a bulk fix on one column, in order of effect."""
    t = types_of(df)[p.column]
    target = cells.widened({p.column: t}, {p.column: value})[p.column]
    col = quoted(p.column)
    number = cells.to_number(col, t)
    null_like = cells.is_null_like(col, t)
    fill = cells.as_column_type(F.lit(value), target)
    bad_type = ~null_like & number.isNull() if p.is_numeric else F.lit(False)
    negative = F.coalesce(number < 0, F.lit(False)) if p.must_be_positive else F.lit(False)
    fixed = (
        F.when(null_like | bad_type, fill)
        .when(negative, cells.as_column_type(F.abs(number), target))
        .otherwise(col if target == t else col.cast(target))
    )
    return {"null": null_like, "type": bad_type, "negative": negative, "fixed": fixed}


def fix_column(df: DataFrame, profile: TableProfile, column: str, value) -> DataFrame:
    """Fill nulls and blanks; in numeric columns also wrong types and negatives."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found in table '{profile.table}'.")
    fixed = _bulk_fix(df, profile[column], value)["fixed"]
    return df.select(*[fixed.alias(c) if c == column else quoted(c) for c in df.columns])


def fix_column_counts(df: DataFrame, profile: TableProfile, column: str, value) -> DataFrame:
    """One row: nulls_fixed, type_errors_fixed, negatives_fixed, total_fixed."""
    rule = _bulk_fix(df, profile[column], value)
    counts = df.agg(
        F.count(F.when(rule["null"], 1)).alias("nulls_fixed"),
        F.count(F.when(rule["type"], 1)).alias("type_errors_fixed"),
        F.count(F.when(rule["negative"], 1)).alias("negatives_fixed"),
    )
    return counts.withColumn(
        "total_fixed", F.col("nulls_fixed") + F.col("type_errors_fixed") + F.col("negatives_fixed")
    )


def imputation_values(df: DataFrame, profile: TableProfile) -> dict[str, object]:
    """Fill value of each column that has nulls.

    Numeric: median, else mean, else 0.  Text: "Unknown" when at least 70 % of
    the column is empty, else the mode.
    """
    holes = [p for p in profile.checked() if p.null_count]
    numeric = [p.column for p in holes if p.is_numeric and p.median is None]
    if numeric:
        profile = prof.with_medians(df, profile, numeric)
    texts = [p.column for p in holes if not p.is_numeric and p.null_rate < MOSTLY_NULL and p.mode is None]
    profile = prof.with_modes(df, profile, texts)
    out = {}
    for p in holes:
        p = profile[p.column]
        if p.is_numeric:
            out[p.column] = round(p.median or p.mean or 0, 4)
        elif p.null_rate >= MOSTLY_NULL:
            out[p.column] = UNKNOWN_TEXT
        else:
            out[p.column] = p.mode or UNKNOWN_TEXT
    return out


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    types = types_of(df)
    targets = cells.widened(types, values)
    out = []
    for c in df.columns:
        col = quoted(c)
        if c in values:
            fill = cells.as_column_type(F.lit(values[c]), targets[c])
            old = col if targets[c] == types[c] else col.cast(targets[c])
            col = F.when(cells.is_null_like(col, types[c]), fill).otherwise(old)
        out.append(col.alias(c))
    return df.select(*out)


def auto_impute(df: DataFrame, profile: TableProfile) -> DataFrame:
    """All columns with nulls filled by the policy, in one pass."""
    return fill_nulls(df, imputation_values(df, profile))


def corrections(issues: DataFrame) -> DataFrame:
    """Issues as fixes: their correct value, and 0 where any value will do.

    The later rule wins when two findings hit one cell.
    """
    order = F.lit(0).cast("long")
    for i, kind in enumerate(detect.DETECTION_ORDER):
        order = F.when(F.col("issue_type") == kind, F.lit(i).cast("long")).otherwise(order)
    value = F.when(F.col("action") == "any", F.lit("0")).otherwise(
        F.coalesce("correct", F.col("correct_num").cast("string"))
    )
    return issues.where(F.col("action") != "delete").select("row_id", "column", value.alias("value"), order.alias("step"))


def rows_to_delete(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("action") == "delete").select("row_id").distinct()


def apply_corrections(df: DataFrame, issues: DataFrame, id_col: str = "id") -> DataFrame:
    """Every correction of an issue table applied: cells set, rows deleted."""
    kept = delete_rows(df, rows_to_delete(issues), id_col)
    return apply_fixes(kept, corrections(issues), id_col)


def repair_in_place(df: DataFrame, rules: Rules, checks: Sequence[str] = detect.MEDIUM) -> DataFrame:
    """The corrections of the cell rules without an issue table: no join, no shuffle."""
    types = types_of(df)
    parsed = detect.Parsed(df)
    found: dict[str, list[detect.Finding]] = {}
    for f in detect.cell_findings(parsed, rules, checks):
        found.setdefault(f.column, []).append(f)
    # only medians fill cells with numbers that may not be whole
    targets = cells.widened(types, {c: rules.medians[c] for c in found if c in rules.medians})
    out = []
    for c in df.columns:
        col = quoted(c) if targets[c] == types[c] else quoted(c).cast(targets[c])
        for f in found.get(c, []):
            # findings are in detection order, the later rule wins
            col = F.when(f.applies, cells.as_column_type(f.replacement(), targets[c])).otherwise(col)
        out.append(col.alias(c))
    return parsed.frame().select(*out)
