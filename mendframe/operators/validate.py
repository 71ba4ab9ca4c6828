"""The six before/after checks of a repair.

The table after the repair is aggregated once for the first four checks; the
baseline comes from the profile and from the issue table and is never changed
by a repair.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions import cells
from mendframe.operators import detect
from mendframe.operators.frequency import quoted, types_of
from mendframe.operators.profile import TableProfile

# Fixed values of the checks.
CONFIDENT = 0.50
DRIFT_FAIL = 20.0
DRIFT_WARN = 5.0
OUTLIER_Z = 5.0


def column_state(after: DataFrame, profile: TableProfile) -> DataFrame:
    """(column, nulls, bad_type, negatives, mean) of the repaired table: one aggregate."""
    types = types_of(after)
    names = [c for c in after.columns if c in profile.columns]
    prepared, aggs, rows = [], [], []
    for i, c in enumerate(names):
        col, t = quoted(c), types[c]
        prepared += [
            F.when(cells.is_null_like(col, t), F.lit(1)).alias(f"n{i}"),
            cells.to_number(col, t).alias(f"x{i}"),
        ]
        x = F.col(f"x{i}")
        aggs += [
            F.count(f"n{i}").alias(f"n{i}"),
            F.count(F.when(F.col(f"n{i}").isNull() & x.isNull(), 1)).alias(f"b{i}"),
            F.count(F.when(x < 0, 1)).alias(f"g{i}"),
            F.avg(x).alias(f"m{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("nulls"),
                F.col(f"b{i}").alias("bad_type"),
                F.col(f"g{i}").alias("negatives"),
                F.col(f"m{i}").alias("mean"),
            )
        )
    return after.select(*prepared).agg(*aggs).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def baseline(issues: DataFrame) -> DataFrame:
    """Issue counts per column: nulls (with their top confidence), types, ranges, duplicates."""
    kind = F.col("issue_type")
    return issues.groupBy("column").agg(
        F.max(F.when(kind == "null", F.col("confidence"))).alias("null_confidence"),
        F.count(F.when(kind == "type_error", 1)).alias("type_issues"),
        F.count(F.when(kind == "constraint", 1)).alias("range_issues"),
        F.count(F.when(kind == "duplicate", 1)).alias("duplicate_issues"),
    )


def _profile_rows(profile: TableProfile, spark) -> DataFrame:
    rows = [
        (c, p.null_count, float(p.mean) if p.is_numeric and p.mean else None)
        for c, p in profile.columns.items()
    ]
    return spark.createDataFrame(rows, "column string, nulls_before long, base_mean double")


def _as_map(wanted: Column, value: Column) -> Column:
    pairs = F.collect_list(F.when(wanted, F.struct(F.col("column"), value.cast("double"))))
    return F.map_from_entries(pairs)


def _rows_map(value: str) -> Column:
    return F.create_map(F.lit("rows"), F.col(value).cast("double"))


def _column_checks(
    after: DataFrame, issues: DataFrame, profile: TableProfile, touched: Iterable[str]
) -> DataFrame:
    """One row with the results of the four checks that look at whole columns.

    The repaired table is read by one aggregate; from there on the frames have
    one row per column.
    """
    # a column that is gone is all empty
    state = column_state(after, profile)
    per_column = _profile_rows(profile, after.sparkSession).join(state, "column", "left").join(
        baseline(issues), "column", "left"
    )
    per_column = per_column.withColumn("nulls", F.coalesce("nulls", F.lit(profile.row_count)))
    touched = sorted(touched)
    drift = F.abs(F.col("mean") - F.col("base_mean")) / F.abs("base_mean") * 100.0
    per_column = per_column.withColumn("drift", drift)

    def counted(wanted: Column, stat: str, before: Column, prefix: str) -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(wanted, F.col(stat))), F.lit(0)).alias(f"{prefix}_left"),
            _as_map(wanted, before).alias(f"{prefix}_before"),
            _as_map(wanted, F.col(stat)).alias(f"{prefix}_after"),
        ]

    untouched = ~F.col("column").isin(touched) if touched else F.lit(True)
    warning = F.when(
        (F.col("drift") > DRIFT_WARN) & untouched,
        F.concat(
            F.col("column"), F.lit(" drifted "), F.round("drift", 1).cast("string"),
            F.lit("% but was not modified"),
        ),
    )
    return per_column.agg(
        *counted(F.col("null_confidence") > CONFIDENT, "nulls", F.col("nulls_before"), "null"),
        *counted(F.col("type_issues") > 0, "bad_type", F.col("type_issues"), "type"),
        *counted(F.col("range_issues") > 0, "negatives", F.col("range_issues"), "range"),
        F.count(F.when(F.col("drift") >= DRIFT_FAIL, 1)).alias("drift_left"),
        _as_map(F.col("base_mean").isNotNull(), F.col("base_mean")).alias("drift_before"),
        _as_map(F.col("drift").isNotNull(), F.col("mean")).alias("drift_after"),
        F.array_sort(F.collect_list(warning)).alias("warnings"),
        F.coalesce(F.sum("duplicate_issues"), F.lit(0)).alias("duplicates_before"),
    )


def duplicate_rows(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """One row: how many rows repeat a natural key."""
    per_key = detect.keyed_rows(df, id_col, key).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def outliers_left(issues: DataFrame, after: DataFrame, profile: TableProfile) -> DataFrame:
    """Outlier issues with `still`: the value is more than 5 std from the loaded mean."""
    state = detect.with_cell(issues.where(F.col("issue_type") == "outlier"), after, profile)
    std, mean = detect.state_stat(profile, "std"), detect.state_stat(profile, "mean")
    still = F.col("present") & (std > 0) & (F.abs(F.col("cell_num") - mean) / std > OUTLIER_Z)
    return state.select(*issues.columns, F.coalesce(still, F.lit(False)).alias("still"))


def validate(
    after: DataFrame,
    issues: DataFrame,
    profile: TableProfile,
    natural_key: str | None = None,
    touched: Iterable[str] = (),
) -> DataFrame:
    """Six rows (name, passed, before, after, detail, warnings).

    `profile` and `issues` describe the table before the repair.
    """
    parts = [
        _column_checks(after, issues, profile, touched),
        outliers_left(issues, after, profile).agg(
            F.count(F.lit(1)).alias("outliers_before"), F.count(F.when(F.col("still"), 1)).alias("outliers_after")
        ),
    ]
    if natural_key is not None and natural_key in after.columns:
        left = duplicate_rows(after, natural_key, profile.id_col)
        parts.append(left.withColumnRenamed("duplicates", "duplicates_after"))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    row = stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
    if "duplicates_after" not in row.columns:
        row = row.withColumn("duplicates_after", F.lit(0))

    def check(name, passed, before, after_, detail, warnings=None):
        return F.struct(
            F.lit(name).alias("name"),
            passed.alias("passed"),
            before.alias("before"),
            after_.alias("after"),
            detail.alias("detail"),
            (F.array().cast("array<string>") if warnings is None else warnings).alias("warnings"),
        )

    def column_check(name, prefix, what, warnings=None):
        left = F.col(f"{prefix}_left")
        detail = F.when(left == 0, F.lit(f"no {what}")).otherwise(F.concat(left.cast("string"), F.lit(f" {what}")))
        return check(name, left == 0, F.col(f"{prefix}_before"), F.col(f"{prefix}_after"), detail, warnings)

    before, now = F.col("duplicates_before"), F.col("duplicates_after")
    still = F.col("outliers_after")
    rows = [
        column_check("null_check", "null", "null(s) remain"),
        column_check("type_check", "type", "type error(s) remain"),
        column_check("range_check", "range", "negative(s) remain"),
        column_check("distribution_check", "drift", "column(s) drifted 20% or more", F.col("warnings")),
        check(
            "duplicate_check",
            (before == 0) | (now < before) | (now == 0),
            _rows_map("duplicates_before"),
            _rows_map("duplicates_after"),
            F.concat(now.cast("string"), F.lit(" of "), before.cast("string"), F.lit(" duplicates left")),
        ),
        check(
            "outlier_check",
            still == 0,
            _rows_map("outliers_before"),
            _rows_map("outliers_after"),
            F.concat(still.cast("string"), F.lit(" outlier(s) remain")),
        ),
    ]
    return row.select(F.explode(F.array(*rows)).alias("check")).select("check.*")


def overall(checks: DataFrame) -> DataFrame:
    """One row: checks_passed, total_checks, overall (PASS, FAIL or PARTIAL)."""
    passed = F.count(F.when(F.col("passed"), 1))
    total = F.count(F.lit(1))
    return checks.agg(
        passed.alias("checks_passed"),
        total.alias("total_checks"),
        F.when(passed == total, F.lit("PASS"))
        .when(passed == 0, F.lit("FAIL"))
        .otherwise(F.lit("PARTIAL"))
        .alias("overall"),
    )
