"""Read-only SQL, joins with diagnostics, and the summary queries."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.functions import cells
from mendframe.operators import skew
from mendframe.operators.frequency import quoted, types_of

_QUOTED_IDS = "spark.sql.ansi.doubleQuotedIdentifiers"

# What a statement that only reads is parsed into; any other node is refused.
READING = frozenset(
    "Aggregate Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit "
    "LocalRelation Offset OneRowRelation Pivot Project Range Sample Sort SubqueryAlias Union Unpivot Window WithWindowDefinition".split()
)
# Functions that leave SQL and call into the virtual machine.
CALLS_OUT = frozenset(("java_method", "reflect", "try_reflect"))


class QueryError(ValueError):
    """The query text is refused."""


@contextmanager
def _quoted_identifiers(spark: SparkSession):
    """Double quotes mark identifiers while a text is parsed."""
    before = spark.conf.get(_QUOTED_IDS, None)
    spark.conf.set(_QUOTED_IDS, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_QUOTED_IDS)
        else:
            spark.conf.set(_QUOTED_IDS, before)


def _nodes(tree) -> Iterator[dict]:
    """Every node of a parsed statement, subqueries included."""
    if isinstance(tree, dict):
        yield tree
        tree = list(tree.values())
    if isinstance(tree, list):
        for part in tree:
            yield from _nodes(part)


def check_query(spark: SparkSession, sql: str) -> None:
    """Refuse whatever Spark's own parser does not read as a plain SELECT over registered tables."""
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql or "")
    except Exception as exc:
        raise QueryError(f"not a statement: {str(exc).splitlines()[0]}") from exc
    tables = {t.lower() for t in table_names(spark)}
    for node in _nodes(json.loads(parsed.toJSON())):
        package, _, kind = node.get("class", "").rpartition(".")
        if (package.endswith("plans.logical") and kind not in READING) or ".execution" in package or kind == "UnresolvedWith":
            raise QueryError(f"a reading query cannot hold {kind}")
        if kind == "UnresolvedRelation" and node["multipartIdentifier"].strip("[]").lower() not in tables:
            raise QueryError(f"no registered table {node['multipartIdentifier']}; there are {sorted(tables)}")
        if kind == "UnresolvedFunction" and node["nameParts"].strip("[]").lower().rpartition(", ")[2] in CALLS_OUT:
            raise QueryError(f"{node['nameParts']} calls out of SQL")


def query(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """All rows of a SELECT over the registered tables, or `limit` of them for display."""
    with _quoted_identifiers(spark):
        check_query(spark, sql)
        try:
            df = spark.sql(sql)
        except Exception as exc:
            raise QueryError(f"SQL error: {str(exc).splitlines()[0]}") from exc
    return df if limit is None else df.limit(limit)


def table_names(spark: SparkSession) -> list[str]:
    # names only: listing tables through the catalog resolves every one of them
    return sorted(r["viewName"] for r in spark.sql("SHOW VIEWS").collect() if r["isTemporary"])


def rows(spark: SparkSession, table: str) -> DataFrame:
    if table not in table_names(spark):
        raise QueryError(f"Table '{table}' not found. Available tables: {table_names(spark)}")
    return spark.table(table)


def columns(spark: SparkSession, table: str) -> list[str]:
    return rows(spark, table).columns


def select_tables(spark: SparkSession, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """(known, unknown) of the wanted table names."""
    available = table_names(spark)
    return [t for t in wanted if t in available], [t for t in wanted if t not in available]


# -- joins -------------------------------------------------------------------


@dataclass(frozen=True)
class JoinResult:
    """The joined rows and one row of diagnostics, both lazy."""

    rows: DataFrame
    diagnostics: DataFrame
    key: str
    other_key: str


def other_key(key: str, names: Sequence[str]) -> str | None:
    """Column of the second table that a key of the first refers to."""
    if key in names:
        return key
    if "id" in names:
        return "id"
    if key.endswith("_ref") and f"{key[:-4]}_id" in names:
        return f"{key[:-4]}_id"
    return names[0] if names else None


def shared_key(left: Sequence[str], right: Sequence[str]) -> str | None:
    """First shared column that is no id, else the first column of the left table."""
    visible = [c for c in left if c != "id"]
    shared = [c for c in visible if c in right]
    return shared[0] if shared else (visible[0] if visible else None)


def _keys(t1: DataFrame, key: str, t2: DataFrame, key2: str) -> tuple[Column, Column]:
    a, b = types_of(t1)[key], types_of(t2)[key2]
    if cells.is_integral(a) and cells.is_integral(b):
        common = "long"
    elif cells.is_numeric(a) and cells.is_numeric(b):
        common = "double"
    elif a == b:
        return quoted(key), quoted(key2)
    else:
        common = "string"
    return quoted(key).cast(common), quoted(key2).cast(common)


def join_tables(
    t1: DataFrame, t2: DataFrame, key: str, t1_rows: int | None = None, hot_rows: int = skew.HOT_ROWS
) -> JoinResult:
    """`t1` left join `t2`; repeated names of `t2` get the prefix `t2_`.

    Diagnostics: rows of both sides, joined rows, match_rate (share of t1 rows
    with a partner), key_unique (t2 has one row per key) and valid (not empty
    and not every row paired with every row).  They come from per-key counts,
    so the joined rows are not needed to compute them.  NULL keys and keys
    that hold a large part of `t1` are spread over several tasks; `t1_rows` spares counting the rows for that.
    """
    if key not in t1.columns:
        raise QueryError(f"the first table has no column '{key}' to join by")
    key2 = other_key(key, t2.columns)
    if key2 is None:
        raise QueryError(f"the second table has no column that '{key}' could refer to")
    k1, k2 = _keys(t1, key, t2, key2)
    right = t2.select(
        *[quoted(c).alias(f"t2_{c}" if c in t1.columns else c) for c in t2.columns], k2.alias("_key2")
    )
    left = t1.withColumn("_key1", k1)
    spread = F.struct(*[quoted(c) for c in t1.columns])
    joined = skew.left_join_spread(left, right, "_key1", "_key2", spread, t1.count() if t1_rows is None else t1_rows, hot_rows)
    return JoinResult(joined.drop("_key1", "_key2"), _diagnostics(t1, k1, t2, k2), key, key2)


def _diagnostics(t1: DataFrame, k1: Column, t2: DataFrame, k2: Column) -> DataFrame:
    # NULL keys stay in the left counts: those rows are kept, unmatched
    left = t1.groupBy(k1.alias("key")).agg(F.count(F.lit(1)).alias("n1"))
    right = t2.groupBy(k2.alias("key")).agg(F.count(F.lit(1)).alias("n2"))
    per_key = left.join(right, "key", "full")
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    counts = per_key.agg(
        F.coalesce(F.sum(n1), F.lit(0)).alias("rows_left"),
        F.coalesce(F.sum(n2), F.lit(0)).alias("rows_right"),
        F.coalesce(F.sum(n1 * F.greatest(n2, F.lit(1))), F.lit(0)).alias("rows_joined"),
        F.coalesce(F.sum(F.when(n2 > 0, n1).otherwise(0)), F.lit(0)).alias("matched"),
        F.coalesce(F.max(F.when(F.col("key").isNotNull(), n2)), F.lit(0)).alias("most"),
    )
    a, b, joined = F.col("rows_left"), F.col("rows_right"), F.col("rows_joined")
    cartesian = (a > 1) & (b > 1) & (joined >= a * b)
    return counts.select(
        "rows_left",
        "rows_right",
        "rows_joined",
        F.round(F.col("matched") / F.greatest(a, F.lit(1)), 4).alias("match_rate"),
        (F.col("most") <= 1).alias("key_unique"),
        ((joined > 0) & ~cartesian).alias("valid"),
    )


# -- summaries ---------------------------------------------------------------


def group_summary(df: DataFrame, category: str, number: str, limit: int | None = None) -> DataFrame:
    """Count, average, minimum and maximum of a number per category, largest first."""
    x = quoted(number).cast("double")
    out = df.groupBy(quoted(category).alias(category)).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg(x), 2).alias(f"avg_{number.lower()}"),
        F.round(F.min(x), 2).alias(f"min_{number.lower()}"),
        F.round(F.max(x), 2).alias(f"max_{number.lower()}"),
    )
    out = out.orderBy(F.desc("count"), F.asc(category))
    return out if limit is None else out.limit(limit)


def category_counts(df: DataFrame, category: str, limit: int | None = None) -> DataFrame:
    out = df.groupBy(quoted(category).alias(category)).agg(F.count(F.lit(1)).alias("count"))
    out = out.orderBy(F.desc("count"), F.asc(category))
    return out if limit is None else out.limit(limit)


def top_rows(df: DataFrame, number: str, n: int = 10, largest: bool = True, id_col: str = "id") -> DataFrame:
    """The `n` rows with the largest (or smallest) number, ties to the lowest id."""
    order = F.desc(number) if largest else F.asc_nulls_last(number)
    return df.orderBy(order, quoted(id_col)).limit(n)
