"""Column profiles: one aggregate over the table, one small row per column.

`profile_table` runs a single scan for counts, types and moments (one per
`COLUMNS_AT_ONCE` columns of a wide table).  Distinct
counts, medians and modes are separate passes that are only run for the columns
and statistics asked for, because each of them shuffles values.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.functions import cells
from mendframe.operators import frequency, quantiles
from mendframe.operators.frequency import quoted, types_of

NUMERIC = ("int", "float")
TEXTUAL = ("str", "unknown")

# Words that mark a column as a natural key, and the share of
# distinct values it needs.
KEY_HINTS = ("name", "email", "code", "ref", "id_", "key", "title")
KEY_UNIQUENESS = 0.70
COLUMNS_AT_ONCE = 48

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("null_count", T.LongType()),
        T.StructField("null_rate", T.DoubleType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("all_unique", T.BooleanType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("mode", T.StringType()),
        T.StructField("must_be_positive", T.BooleanType()),
        T.StructField("sample_values", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class ColumnProfile:
    """Statistics of one column; `None` marks what was not asked for.

    `hash_bits` (text only) counts how many of 64 hash slots the values fill: a
    lower bound of the distinct count that costs one long per column.
    """

    table: str
    column: str
    dtype: str
    row_count: int
    null_count: int
    castable: int
    non_negative: int
    hash_bits: int | None = None
    unique_count: int | None = None
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    median: float | None = None
    mode: str | None = None
    sample_values: list[str] | None = None
    whole: int = 0

    @property
    def present(self) -> int:
        return self.row_count - self.null_count

    @property
    def null_rate(self) -> float:
        return self.null_count / self.row_count if self.row_count else 0.0

    @property
    def is_numeric(self) -> bool:
        return self.dtype in NUMERIC

    @property
    def castable_share(self) -> float:
        return self.castable / self.present if self.present else 0.0

    @property
    def must_be_positive(self) -> bool:
        return self.is_numeric and self.min is not None and self.min >= 0 and self.max > 0

    @property
    def all_unique(self) -> bool | None:
        if self.unique_count is None:
            return None
        return self.row_count > 0 and self.null_count == 0 and self.unique_count == self.row_count


@dataclass(frozen=True)
class TableProfile:
    table: str
    id_col: str
    row_count: int
    columns: dict[str, ColumnProfile] = field(default_factory=dict)

    def __getitem__(self, column: str) -> ColumnProfile:
        return self.columns[column]

    def checked(self) -> list[ColumnProfile]:
        """Every column but the row id."""
        return [p for c, p in self.columns.items() if c != self.id_col]

    def updated(self, column: str, **changes) -> TableProfile:
        columns = dict(self.columns)
        columns[column] = replace(columns[column], **changes)
        return replace(self, columns=columns)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The profile as a table, moments only for numeric columns."""
        rows = []
        for p in self.columns.values():
            num = p.is_numeric
            rows.append(
                (
                    p.table, p.column, p.dtype, p.row_count, p.null_count, round(p.null_rate, 4),
                    p.unique_count, p.all_unique,
                    p.mean if num else None, p.std if num else None,
                    p.min if num else None, p.max if num else None,
                    p.median if num else None, p.mode, p.must_be_positive, p.sample_values,
                )
            )
        return spark.createDataFrame(rows, PROFILE_SCHEMA)


def logical_type(spark_type: T.DataType, present: int, castable: int, whole: int) -> str:
    if present == 0:
        return "unknown"
    if isinstance(spark_type, T.BooleanType):
        return "bool"
    if not (cells.is_numeric(spark_type) or cells.is_text(spark_type)):
        return "unknown"
    if castable == present:
        return "int" if whole == present else "float"
    return "str"


def number_columns(df: DataFrame, columns: Iterable[str]):
    types = types_of(df)
    return {c: cells.to_number(quoted(c), types[c]) for c in columns}


def _counts_and_moments(df: DataFrame, types: dict[str, T.DataType]) -> dict[str, object]:
    """The aggregates of every column, `COLUMNS_AT_ONCE` columns a pass.

    A pass reads its own columns only, so the passes of a wide table read together
    what one would, and each stays small enough to be compiled.
    """
    numbered = list(enumerate(types.items()))
    parts = [numbered[at : at + COLUMNS_AT_ONCE] for at in range(0, len(numbered), COLUMNS_AT_ONCE)] or [[]]
    out: dict[str, object] = {}
    with ThreadPoolExecutor(2) as pool:
        run = inheritable_thread_target(df.sparkSession)(_moments_of)
        for row in pool.map(lambda part: run(df, part), parts):
            out |= row
    return out


def _moments_of(df: DataFrame, part: list[tuple[int, tuple[str, T.DataType]]]) -> dict[str, object]:
    prepared, aggs = [], [F.count(F.lit(1)).alias("rows")]
    for i, (c, t) in part:
        col = quoted(c)
        present = f"p{i}"
        if isinstance(t, T.BooleanType) or not (cells.is_numeric(t) or cells.is_text(t)):
            prepared.append(F.when(cells.not_null_like(col, t), F.lit(1)).alias(present))
            aggs.append(F.count(present).alias(present))
            continue
        # a separate projection, so each cell is parsed once for all aggregates
        prepared.append(F.when(cells.not_null_like(col, t), col).alias(present))
        prepared.append(cells.to_number(col, t).alias(f"x{i}"))
        x = F.col(f"x{i}")
        aggs += [
            F.count(present).alias(present),
            F.count(x).alias(f"c{i}"),
            F.count(F.when(cells.is_whole(x), 1)).alias(f"w{i}"),
            F.count(F.when(x >= 0, 1)).alias(f"g{i}"),
            F.avg(x).alias(f"m{i}"),
            F.stddev_pop(x).alias(f"s{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
        ]
        if cells.is_text(t):
            slot = F.pmod(F.xxhash64(present), F.lit(64)).cast("int")
            bit = F.when(F.col(present).isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), slot))
            aggs.append(F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).alias(f"u{i}"))
    return df.select(*prepared).agg(*aggs).collect()[0].asDict()


def profile_table(
    df: DataFrame,
    table: str,
    id_col: str = "id",
    unique: Sequence[str] | str | None = "all",
    medians: Sequence[str] | str | None = None,
    modes: Sequence[str] | str | None = None,
    samples: bool = False,
) -> TableProfile:
    """Profile every column of `df`.

    `unique`, `medians` and `modes` take "all", a list of columns, or None;
    `unique="approx"` and `medians="approx"` use sketches for all columns.
    """
    types = types_of(df)
    names = list(types)
    r = _counts_and_moments(df, types)

    rows = r["rows"]
    columns = {}
    for i, c in enumerate(names):
        present = r[f"p{i}"]
        castable = r.get(f"c{i}", 0)
        columns[c] = ColumnProfile(
            table=table,
            column=c,
            dtype=logical_type(types[c], present, castable, r.get(f"w{i}", 0)),
            row_count=rows,
            null_count=rows - present,
            castable=castable,
            non_negative=r.get(f"g{i}", 0),
            whole=r.get(f"w{i}", 0),
            hash_bits=r.get(f"u{i}"),
            mean=r.get(f"m{i}"),
            std=r.get(f"s{i}"),
            min=r.get(f"lo{i}"),
            max=r.get(f"hi{i}"),
        )
    profile = TableProfile(table, id_col, rows, columns)
    if unique == "approx":
        for c, n in approx_unique_counts(df, names).items():
            profile = profile.updated(c, unique_count=n)
    elif unique:
        profile = with_unique_counts(df, profile, names if unique == "all" else unique)
    if medians:
        wanted = [c for c in names if columns[c].is_numeric] if isinstance(medians, str) else medians
        profile = with_medians(df, profile, wanted, approx=medians == "approx")
    if modes:
        profile = with_modes(df, profile, [c for c in names if c != id_col] if modes == "all" else modes)
    if samples:
        profile = with_samples(df, profile)
    return profile


def profile_column(df: DataFrame, table: str, column: str, id_col: str = "id") -> ColumnProfile:
    """Every statistic of one column; the others are not read."""
    pair = df.select(*[quoted(c) for c in dict.fromkeys((id_col, column))])
    profile = profile_table(pair, table, id_col, unique=[column], modes=[column], samples=True)
    return (with_medians(pair, profile, [column]) if profile[column].is_numeric else profile)[column]


def with_unique_counts(df: DataFrame, profile: TableProfile, columns: Sequence[str]) -> TableProfile:
    """Exact distinct counts of the given columns."""
    if not columns:
        return profile
    counts = {r["column"]: r["unique_count"] for r in frequency.distinct_counts(df, columns).collect()}
    for c in columns:
        profile = profile.updated(c, unique_count=counts.get(c, 0))
    return profile


def approx_unique_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Sketched distinct counts (5 % relative error) from one scan without a shuffle of values."""
    counts = [F.approx_count_distinct(frequency.as_text(df, c)).alias(f"u{i}") for i, c in enumerate(columns)]
    row = df.agg(*counts).collect()[0]
    return {c: row[f"u{i}"] for i, c in enumerate(columns)}


def order_statistics(df: DataFrame, profile: TableProfile, ranks: dict[str, list[int]], approx: bool = False):
    """Values at 0-based ranks of each column's castable values, exact or within 1/10 000 of the rows."""
    ranks = {c: k for c, k in ranks.items() if profile[c].castable and k}
    if not ranks:
        return {}
    if approx:
        return quantiles.near_ranks(df, number_columns(df, ranks), ranks, {c: profile[c].castable for c in ranks})
    bounds = {c: (profile[c].min, profile[c].max, profile[c].castable) for c in ranks}
    return quantiles.values_at_ranks(df, number_columns(df, ranks), ranks, bounds)


def with_medians(df: DataFrame, profile: TableProfile, columns: Sequence[str], approx: bool = False) -> TableProfile:
    """Median of the castable values, the mean of the two middles when even."""
    ranks = {c: list(quantiles.median_ranks(profile[c].castable)) for c in columns if profile[c].castable}
    found = order_statistics(df, profile, ranks, approx)
    for c, (a, b) in ranks.items():
        profile = profile.updated(c, median=middle(found[(c, a)], found[(c, b)]))
    return profile


def middle(a: float, b: float) -> float:
    return a if a == b else (a + b) / 2.0


def with_modes(df: DataFrame, profile: TableProfile, columns: Sequence[str]) -> TableProfile:
    if not columns:
        return profile
    for r in frequency.modes(df, columns, profile.id_col).collect():
        profile = profile.updated(r["column"], mode=r["mode"])
    return profile


def z_scores(df: DataFrame, profile: TableProfile) -> DataFrame:
    """(table, row_id, column, z) for every numeric cell; 0 where std is 0.

    The moments are literals, so this is a narrow pass over the table.
    """
    numeric = [c for c, p in profile.columns.items() if p.is_numeric]
    if not numeric:
        return df.select(quoted(profile.id_col).cast("long").alias("row_id")).limit(0).selectExpr(
            "'' AS table", "row_id", "'' AS column", "0D AS z"
        )
    values = {}
    for c, x in number_columns(df, numeric).items():
        p = profile[c]
        values[c] = (x - F.lit(p.mean)) / F.lit(p.std) if p.std else F.when(x.isNotNull(), F.lit(0.0))
    long = frequency.long_cells(df, numeric, values, quoted(profile.id_col).cast("long").alias("row_id"))
    return long.select(
        F.lit(profile.table).alias("table"), "row_id", "column", F.round("value", 4).alias("z")
    )


SAMPLE_SIZE = 5
_HEAD_ROWS = 1000


def sample_values(df: DataFrame, profile: TableProfile, head_rows: int = _HEAD_ROWS) -> DataFrame:
    """(column, position, row_id, value): the first five non-null values by id.

    The first `head_rows` rows settle almost every column.  All columns that are
    emptier than that share one more scan, in which each task keeps five cells a column.
    """
    id_col, names = profile.id_col, list(profile.columns)
    key = quoted(id_col).cast("long").alias("row_id")
    head = df.orderBy(quoted(id_col)).limit(head_rows)
    text = {c: as_sample(df, c) for c in names}
    head_cells = frequency.long_cells(head, names, text, key)
    filled = {
        r["column"]: r["n"] for r in head_cells.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    sparse = [
        c for c in names if filled.get(c, 0) < min(SAMPLE_SIZE, profile[c].present)
    ]
    out = head_cells.where(~F.col("column").isin(sparse)) if sparse else head_cells
    if sparse:
        out = out.unionByName(frequency.long_cells(df, sparse, text, key))
    position = F.row_number().over(Window.partitionBy("column").orderBy("row_id"))
    return out.withColumn("position", position).where(F.col("position") <= SAMPLE_SIZE)


def as_sample(df: DataFrame, column: str):
    return frequency.as_text(df, column)


def with_samples(df: DataFrame, profile: TableProfile) -> TableProfile:
    found: dict[str, list] = {}
    for r in sample_values(df, profile).orderBy("column", "position").collect():
        found.setdefault(r["column"], []).append(r["value"])
    for c in profile.columns:
        profile = profile.updated(c, sample_values=found.get(c, []))
    return profile


def primary_key(df: DataFrame) -> str | None:
    """First column named `id` or `*_id` whose values are all distinct, else the first."""
    candidates = [c for c in df.columns if c.lower() == "id" or c.lower().endswith("_id")]
    if candidates:
        p = profile_table(df.select(*[quoted(c) for c in candidates]), "", candidates[0], unique="all")
        for c in candidates:
            # a single NULL is one more distinct value, a second one is a repeat
            if p[c].unique_count + min(p[c].null_count, 1) == p.row_count and p[c].null_count <= 1:
                return c
    return df.columns[0] if df.columns else None


def natural_key(df: DataFrame, profile: TableProfile) -> tuple[str | None, TableProfile]:
    """First non-float column with a key-like name and at least 70 % distinct values.

    Distinct counts are only run on columns with such a name.
    """
    hinted = [
        p.column
        for p in profile.checked()
        if p.dtype != "float"
        and any(h in p.column.lower() for h in KEY_HINTS)
        and p.row_count
        and p.present / p.row_count >= KEY_UNIQUENESS
    ]
    missing = [c for c in hinted if profile[c].unique_count is None]
    profile = with_unique_counts(df, profile, missing)
    for c in hinted:
        if profile[c].unique_count / profile.row_count >= KEY_UNIQUENESS:
            return c, profile
    return None, profile


def table_summary(profiles: Iterable[TableProfile], spark: SparkSession) -> DataFrame:
    """(table, row_count, column, position, dtype), one row per column of each table."""
    rows = [
        (p.table, p.row_count, c, i, col.dtype)
        for p in profiles
        for i, (c, col) in enumerate(p.columns.items())
    ]
    return spark.createDataFrame(
        rows, "table string, row_count long, column string, position int, dtype string"
    )


def null_cells(profile: TableProfile) -> int:
    """Null-like cells over the whole table, the row id left out."""
    return sum(p.null_count for p in profile.checked())
