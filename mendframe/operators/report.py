"""Quality reports: grade, column health, column roles, cleaning summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.operators.frequency import quoted
from mendframe.operators.profile import TableProfile

# Grade limits in percent, rows shown, and name hints.
GRADES = ((90, "Excellent"), (70, "Good"), (50, "Fair"))
SHOWN_ISSUES = 15
PREVIEW_ROWS = 10
TARGET_HINTS = ("survived", "target")
MAX_DIMENSION_VALUES = 20


def grade(percent: Column) -> Column:
    out = F.lit("Poor")
    for limit, name in reversed(GRADES):
        out = F.when(percent >= limit, F.lit(name)).otherwise(out)
    return out


def quality_report(issues: DataFrame, profile: TableProfile) -> DataFrame:
    """One row: table, rows, columns, issues, quality (percent) and grade."""
    n_columns = len(profile.checked())
    size = max(profile.row_count * n_columns, 1)
    counted = issues.agg(F.count(F.lit(1)).alias("issues"))
    percent = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("issues") / F.lit(size))) * 100.0
    return counted.select(
        F.lit(profile.table).alias("table"),
        F.lit(profile.row_count).cast("long").alias("rows"),
        F.lit(n_columns).alias("columns"),
        "issues",
        F.round(percent, 4).alias("quality"),
        grade(percent).alias("grade"),
    )


def issue_breakdown(issues: DataFrame) -> DataFrame:
    """(issue_type, n), most frequent first."""
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue_type")


def issue_sample(issues: DataFrame, n: int = SHOWN_ISSUES) -> DataFrame:
    """The first issues, by rule and row."""
    return issues.orderBy("issue_type", "row_id", "column").limit(n)


def preview(df: DataFrame, id_col: str = "id", n: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(quoted(id_col)).limit(n)


def column_health(issues: DataFrame, profile: TableProfile) -> DataFrame:
    """(column, dtype, null_rate, issues, health) per column."""
    base = issues.sparkSession.createDataFrame(
        [(p.column, p.dtype, p.null_rate) for p in profile.checked()],
        "column string, dtype string, null_rate double",
    )
    counts = issues.groupBy("column").agg(F.count(F.lit(1)).alias("issues"))
    joined = base.join(counts, "column", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    rate, n = F.col("null_rate"), F.col("issues")
    health = (
        F.when((rate < 0.05) & (n == 0), F.lit("Good"))
        .when((rate < 0.30) & (n <= 2), F.lit("Fair"))
        .otherwise(F.lit("Poor"))
    )
    return joined.select("column", "dtype", F.round("null_rate", 4).alias("null_rate"), "issues", health.alias("health"))


def column_roles(profile: TableProfile) -> list[tuple[str, str]]:
    """(column, role): target, metric, dimension, or other.

    A target is named like one or has two values; metrics are the other numeric
    columns; dimensions have few distinct values.  Needs distinct counts.
    """
    roles, target_seen = [], False
    for p in profile.checked():
        named = any(h in p.column.lower() for h in TARGET_HINTS)
        if not target_seen and (named or p.unique_count == 2):
            role, target_seen = "target", True
        elif p.is_numeric:
            role = "metric"
        elif p.unique_count is not None and 0 < p.unique_count <= MAX_DIMENSION_VALUES:
            role = "dimension"
        else:
            role = "other"
        roles.append((p.column, role))
    return roles


def cleaning_summary(remaining: DataFrame) -> DataFrame:
    """One row: issues, resolved, percent, from the output of `issues_remaining`."""
    total = F.count(F.lit(1))
    resolved = F.count(F.when(~F.col("remaining"), 1))
    return remaining.agg(
        total.alias("issues"),
        resolved.alias("resolved"),
        F.round(100.0 * resolved / F.greatest(total, F.lit(1))).cast("int").alias("percent"),
    )
