"""Issue detection: eight rules, one issue table.

Six of the rules depend only on the cell and on the profile, so they share one
narrow pass in which every row unfolds into its findings.  Duplicates and orphans compare rows and are the only rules
that shuffle, on pre-aggregated keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.functions import cells
from mendframe.operators import frequency, profile as prof, quantiles, skew
from mendframe.operators.frequency import quoted, types_of
from mendframe.operators.profile import NUMERIC, TEXTUAL, TableProfile

# The checks of each level, and the thresholds of the rules.
EASY = ("null", "type_error", "whitespace", "inconsistent_category")
MEDIUM = EASY + ("constraint", "outlier")
HARD = MEDIUM + ("duplicate", "fk_violation")
LEVELS = {"easy": EASY, "medium": MEDIUM, "hard": HARD}
ROW_CHECKS = ("duplicate", "fk_violation")
# order in which findings on one cell are reported; the last one wins a lookup
DETECTION_ORDER = (
    "null", "type_error", "constraint", "outlier",
    "duplicate", "fk_violation", "whitespace", "inconsistent_category",
)

MOSTLY_NUMERIC = 0.80
MOSTLY_POSITIVE = 0.75
FENCE = 3.0
MIN_OUTLIER_VALUES = 4
MAX_CATEGORIES = 20

ISSUE_COLUMNS = (
    "issue_id", "issue_type", "table", "row_id", "column",
    "correct", "correct_num", "action", "confidence",
)
ISSUE_SCHEMA = (
    "issue_id string, issue_type string, table string, row_id long, column string, "
    "correct string, correct_num double, action string, confidence double"
)


@dataclass(frozen=True)
class Fence:
    low: float
    high: float
    middle: float
    iqr: float


@dataclass(frozen=True)
class Rules:
    """Everything the narrow pass needs, a few values per column."""

    profile: TableProfile
    medians: dict[str, float] = field(default_factory=dict)
    fences: dict[str, Fence] = field(default_factory=dict)
    # column -> {folded key or surface form -> dominant form}
    dominant: dict[str, dict[str, str]] = field(default_factory=dict)
    positive: frozenset[str] = frozenset()
    natural_key: str | None = None
    # the checks these rules were learnt for; None: made by hand, for any check
    checks: frozenset[str] | None = None


def type_error_columns(profile: TableProfile) -> list[str]:
    out = []
    for p in profile.checked():
        mostly = p.dtype in TEXTUAL and p.castable_share >= MOSTLY_NUMERIC
        if p.dtype in NUMERIC or mostly:
            out.append(p.column)
    return out


def positive_columns(profile: TableProfile, forced: Iterable[str] = ()) -> frozenset[str]:
    """Columns in which a negative number is an error.

    A numeric column that holds negatives is taken at its word; a text column
    needs 75 % of its numbers to be non-negative.
    """
    out = set(forced)
    for p in profile.checked():
        if p.must_be_positive:
            out.add(p.column)
        elif p.dtype in TEXTUAL and p.castable and p.non_negative / p.castable >= MOSTLY_POSITIVE:
            out.add(p.column)
    return frozenset(out)


def learn(
    df: DataFrame,
    table: str,
    id_col: str = "id",
    checks: Sequence[str] = HARD,
    profile: TableProfile | None = None,
    force_positive: Iterable[str] = (),
    approx: bool = False,
) -> Rules:
    """Profile `df` and derive the per-column rules of the wanted checks.

    `approx` takes medians and quartiles from sketches of one scan.
    """
    profile = profile or prof.profile_table(df, table, id_col, unique=None)

    want_median = set()
    if "null" in checks:
        want_median |= {p.column for p in profile.checked() if p.is_numeric and p.null_count}
    if "type_error" in checks:
        want_median |= {c for c in type_error_columns(profile) if profile[c].castable < profile[c].present}
    want_fence = set()
    if "outlier" in checks:
        want_fence = {
            p.column for p in profile.checked() if p.is_numeric and p.castable >= MIN_OUTLIER_VALUES
        }

    ranks: dict[str, list[int]] = {}
    for c in want_median | want_fence:
        n = profile[c].castable
        ranks[c] = [
            *(quantiles.median_ranks(n) if c in want_median else ()),
            *(quantiles.quartile_ranks(n) if c in want_fence else ()),
        ]
    # three independent passes: their jobs overlap, and each result is small
    with ThreadPoolExecutor(3) as pool:

        def start(fn, *args, **kw):
            return pool.submit(inheritable_thread_target(df.sparkSession)(fn), *args, **kw)

        statistics = start(prof.order_statistics, df, profile, ranks, approx)
        variants = start(lambda: category_variants(df, profile).collect()) if "inconsistent_category" in checks else None
        natural = start(prof.natural_key, df, profile) if "duplicate" in checks else None
        at = statistics.result()
        variant_rows = variants.result() if variants else []
        key, profile = natural.result() if natural else (None, profile)

    medians, fences = {}, {}
    for c in sorted(want_median):
        if profile[c].castable:
            a, b = quantiles.median_ranks(profile[c].castable)
            medians[c] = prof.middle(at[(c, a)], at[(c, b)])
    for c in sorted(want_fence):
        q1, q2, q3 = (at[(c, k)] for k in quantiles.quartile_ranks(profile[c].castable))
        iqr = q3 - q1
        if iqr != 0:
            fences[c] = Fence(q1 - FENCE * iqr, q3 + FENCE * iqr, q2, iqr)

    dominant: dict[str, dict[str, str]] = {}
    for r in variant_rows:
        dominant.setdefault(r["column"], {})[r["form"]] = r["dominant"]
    return Rules(profile, medians, fences, dominant, positive_columns(profile, force_positive), key, frozenset(checks))


def category_columns(df: DataFrame, profile: TableProfile) -> list[str]:
    types = types_of(df)
    return [
        p.column
        for p in profile.checked()
        if p.dtype in TEXTUAL
        and cells.is_text(types[p.column])
        and p.present
        # 20 distinct values fill at most 20 hash slots, so this loses no column
        and p.hash_bits <= MAX_CATEGORIES
    ]


def category_variants(df: DataFrame, profile: TableProfile) -> DataFrame:
    """(column, form, dominant) for every non-dominant spelling of a category.

    Only text columns with at most 20 distinct values take part, so the result
    has fewer than 20 rows per column.
    """
    columns = category_columns(df, profile)
    if not columns:
        return df.select(
            F.lit("").alias("column"), F.lit("").alias("form"), F.lit("").alias("dominant")
        ).limit(0)
    freq = frequency.value_frequencies(df, columns, profile.id_col)
    size = F.count(F.lit(1)).over(Window.partitionBy("column"))
    # partitioned by column from here on: nothing below shuffles again
    forms = (
        freq.withColumn("unique_count", size)
        .where(F.col("unique_count") <= MAX_CATEGORIES)
        .withColumn("form", cells.strip_blanks(F.col("value")))
        .withColumn("folded", F.lower("form"))
        .groupBy("column", "folded", "form")
        .agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    )
    by_weight = Window.partitionBy("column", "folded").orderBy(F.desc("n"), F.asc("first_id"))
    return (
        forms.withColumn("dominant", F.first("form").over(by_weight))
        .where(F.col("form") != F.col("dominant"))
        .select("column", "form", "dominant")
    )


@dataclass(frozen=True)
class Finding:
    """One cell rule on one column: when it applies, and what it reports."""

    issue_type: str
    column: str
    applies: Column
    confidence: Column
    correct: Column | None = None
    number: Column | None = None
    any_value: bool = False

    def as_struct(self) -> Column:
        none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("double")
        return F.struct(
            F.lit(self.issue_type).alias("issue_type"),
            F.lit(self.column).alias("column"),
            (none_text if self.correct is None else self.correct).alias("correct"),
            (none_number if self.number is None else self.number).alias("correct_num"),
            F.lit("any" if self.any_value else "set").alias("action"),
            self.confidence.alias("confidence"),
        )

    def replacement(self) -> Column:
        """The corrected value as text; 0 where any value will do."""
        if self.any_value:
            return F.lit("0")
        return self.number.cast("string") if self.correct is None else self.correct


class Parsed:
    """A table with the derived forms of its cells as columns.

    Each form (number, emptiness, stripped text) is computed once per row, by a
    projection the rules refer to, however many rules need it.
    """

    def __init__(self, df: DataFrame):
        self.df, self.types = df, types_of(df)
        self.names = {c: i for i, c in enumerate(df.columns)}
        self.forms: dict[str, Column] = {}

    def _form(self, prefix: str, column: str, make) -> Column:
        name = f"_{prefix}{self.names[column]}"
        if name not in self.forms:
            self.forms[name] = make(quoted(column))
        return F.col(name)

    def number(self, column: str) -> Column:
        return self._form("n", column, lambda c: cells.to_number(c, self.types[column]))

    def empty(self, column: str) -> Column:
        return self._form("e", column, lambda c: cells.is_null_like(c, self.types[column]))

    def stripped(self, column: str) -> Column:
        return self._form("s", column, cells.strip_blanks)

    def frame(self) -> DataFrame:
        return self.df.select("*", *[form.alias(name) for name, form in self.forms.items()])


def cell_findings(parsed: Parsed, rules: Rules, checks: Sequence[str]) -> list[Finding]:
    """The six rules that look at one cell, per column in detection order.

    The conditions refer to columns of `parsed.frame()`.
    """
    out = []
    wrong_type = set(type_error_columns(rules.profile))
    for p in rules.profile.checked():
        c, t = p.column, parsed.types[p.column]
        if "null" in checks and p.null_count:
            confidence = F.lit(round(max(0.0, 1.0 - p.null_rate), 4))
            if p.is_numeric:
                fill = F.lit(round(rules.medians[c], 4))
                out.append(Finding("null", c, parsed.empty(c), confidence, number=fill))
            else:
                out.append(Finding("null", c, parsed.empty(c), confidence, any_value=True))
        if "type_error" in checks and c in wrong_type and p.castable < p.present:
            bad = ~parsed.empty(c) & parsed.number(c).isNull()
            middle = F.lit(rules.medians.get(c)).cast("double")
            out.append(Finding("type_error", c, bad, F.lit(1.0), number=middle))
        if "constraint" in checks and c in rules.positive and p.non_negative < p.castable:
            number = parsed.number(c)
            out.append(Finding("constraint", c, number < 0, F.lit(0.95), number=F.abs(number)))
        if "outlier" in checks and c in rules.fences:
            f = rules.fences[c]
            if p.min < f.low or p.max > f.high:
                number = parsed.number(c)
                outside = (number < f.low) | (number > f.high)
                distance = F.greatest(number - F.lit(f.high), F.lit(f.low) - number)
                score = F.round(F.lit(0.60) + distance / F.lit(f.iqr * 10.0 + 1e-9), 4)
                middle = F.lit(round(f.middle, 4))
                out.append(Finding("outlier", c, outside, F.least(F.lit(0.99), score), number=middle))
        if "whitespace" in checks and p.dtype in TEXTUAL and cells.is_text(t):
            col = quoted(c)
            untidy = ~parsed.empty(c) & cells.is_untidy(col)
            out.append(Finding("whitespace", c, untidy, F.lit(0.90), correct=cells.squeeze_blanks(col)))
        if "inconsistent_category" in checks and c in rules.dominant:
            form = parsed.stripped(c)
            variants = rules.dominant[c]
            right = F.lit(None).cast("string")
            for spelled, fixed in sorted(variants.items()):
                right = F.when(form == spelled, F.lit(fixed)).otherwise(right)
            out.append(
                Finding("inconsistent_category", c, form.isin(sorted(variants)), F.lit(0.85), correct=right)
            )
    return out


def empty_issues(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)


def _as_issues(found: DataFrame, table: str) -> DataFrame:
    return found.select(
        cells.issue_id(F.lit(table), F.col("row_id"), F.col("column"), F.col("issue_type")).alias("issue_id"),
        "issue_type",
        F.lit(table).alias("table"),
        "row_id",
        "column",
        "correct",
        "correct_num",
        "action",
        "confidence",
    )


def detect_cells(df: DataFrame, rules: Rules, checks: Sequence[str]) -> DataFrame:
    parsed = Parsed(df)
    findings = cell_findings(parsed, rules, checks)
    if not findings:
        return empty_issues(df)
    hits = [F.when(f.applies, f.as_struct()) for f in findings]
    exploded = (
        parsed.frame()
        .select(
            quoted(rules.profile.id_col).cast("long").alias("row_id"), F.explode(F.array(*hits)).alias("hit")
        )
        .where(F.col("hit").isNotNull())
        .select("row_id", "hit.*")
    )
    return _as_issues(exploded, rules.profile.table)


def _delete_rows(rows: DataFrame, kind: str, column: str, confidence: float) -> DataFrame:
    return rows.select(
        "row_id",
        F.lit(kind).alias("issue_type"),
        F.lit(column).alias("column"),
        F.lit(None).cast("string").alias("correct"),
        F.lit(None).cast("double").alias("correct_num"),
        F.lit("delete").alias("action"),
        F.lit(confidence).alias("confidence"),
    )


def keyed_rows(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(row_id, key) of the rows with a value, the key folded."""
    t = types_of(df)[column]
    col = quoted(column)
    return df.where(cells.not_null_like(col, t)).select(
        quoted(id_col).cast("long").alias("row_id"), cells.fold_key(col, t).alias("key")
    )


def detect_duplicates(
    df: DataFrame, rules: Rules, key: str | None = None, hot_rows: int = skew.HOT_ROWS
) -> DataFrame:
    """Rows that repeat the natural key of a row with a lower id.

    Keys are counted first, so only repeated keys are joined back, and a key
    shared by a large part of the table is spread over salts.
    """
    key = key or rules.natural_key
    if key is None:
        return empty_issues(df)
    rows = keyed_rows(df, rules.profile.id_col, key)
    repeated = (
        rows.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"))
        .where(F.col("n") > 1)
    )
    later = skew.join_to_counted(
        rows, repeated, ["key"], "n", F.col("row_id"), rules.profile.row_count, hot_rows=hot_rows
    ).where(F.col("row_id") > F.col("first_id"))
    return _as_issues(_delete_rows(later, "duplicate", key, 1.0), rules.profile.table)


def foreign_keys(columns: Iterable[str], id_col: str, others: Sequence[str]) -> dict[str, str]:
    """Foreign-key column -> referenced table, by name."""
    out = {}
    for c in columns:
        if not c.lower().endswith("_id") or c == id_col or not others:
            continue
        stem = c[:-3].lower()
        named = [t for t in others if stem in t.lower()]
        out[c] = named[0] if named else others[0]
    return out


def _comparable(a, b):
    """Casts that make keys of two columns comparable."""
    if cells.is_integral(a) and cells.is_integral(b):
        return "long"
    if cells.is_numeric(a) and cells.is_numeric(b):
        return "double"
    return "string"


def detect_orphans(
    df: DataFrame,
    rules: Rules,
    references: Mapping[str, DataFrame],
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Rows whose `*_id` value is missing from the first column of its table.

    The anti join sees each distinct key once; only orphaned keys go back to
    the rows, salted when one of them is on a large part of the table.
    """
    types, parts = types_of(df), []
    targets = foreign_keys(df.columns, rules.profile.id_col, list(references))
    for column, table in targets.items():
        ref = references[table]
        ref_key = ref.schema.fields[0]
        common = _comparable(types[column], ref_key.dataType)
        col = quoted(column)
        rows = df.where(cells.not_null_like(col, types[column])).select(
            quoted(rules.profile.id_col).cast("long").alias("row_id"), col.cast(common).alias("key")
        )
        known = ref.select(quoted(ref_key.name).cast(common).alias("key"))
        orphaned = (
            rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(known, "key", "left_anti")
        )
        lost = skew.join_to_counted(
            rows, orphaned, ["key"], "n", F.col("row_id"), rules.profile.row_count, hot_rows=hot_rows
        )
        parts.append(_as_issues(_delete_rows(lost, "fk_violation", column, 0.90), rules.profile.table))
    return reduce(DataFrame.unionByName, parts) if parts else empty_issues(df)


def detect(
    df: DataFrame,
    table: str,
    id_col: str = "id",
    level: str = "hard",
    checks: Sequence[str] | None = None,
    references: Mapping[str, DataFrame] | None = None,
    rules: Rules | None = None,
    unique_ids: bool = False,
) -> DataFrame:
    """Every finding of the level's checks, as the issue table.

    A cell yields one finding per rule at most, so only rows that repeat an id can
    repeat a finding; of those the smallest correction stays.  `unique_ids` says that no
    id is repeated (as behind `ensure_id`), and spares the shuffle of all findings.
    """
    checks = tuple(checks or LEVELS[level])
    rules = rules or learn(df, table, id_col, checks)
    if rules.checks is not None and not rules.checks.issuperset(checks):
        raise ValueError(f"the rules were not learnt for {sorted(set(checks) - rules.checks)}")
    out = detect_cells(df, rules, checks)
    if "duplicate" in checks:
        out = out.unionByName(detect_duplicates(df, rules))
    if "fk_violation" in checks and references:
        out = out.unionByName(detect_orphans(df, rules, references))
    return out.select(*ISSUE_COLUMNS) if unique_ids else distinct_findings(out)


def distinct_findings(issues: DataFrame) -> DataFrame:
    """One row per (row, column, kind): the smallest correction, then the highest confidence."""
    key = ["issue_id", "issue_type", "table", "row_id", "column"]
    least = F.min(F.struct("correct_num", "correct", "action", (-F.col("confidence")).alias("doubt"))).alias("best")
    best = issues.groupBy(*key).agg(least)
    correction = [F.col(f"best.{c}").alias(c) for c in ("correct", "correct_num", "action")]
    return best.select(*key, *correction, (-F.col("best.doubt")).alias("confidence"))


def issues_remaining(issues: DataFrame, repaired: DataFrame, profile: TableProfile) -> DataFrame:
    """(issue columns..., remaining): which issues are still open after a repair.

    Whitespace and category findings never count as open.
    """
    state = with_cell(issues, repaired, profile)
    still = still_open(F.col("present"), F.col("cell_null"), F.col("cell_num"), profile)
    return state.select(*issues.columns, F.coalesce(still, F.lit(False)).alias("remaining"))


def still_open(present: Column, null_like: Column, number: Column, profile: TableProfile) -> Column:
    """Whether an issue is open, by the present state of its row and cell."""
    std, mean = state_stat(profile, "std"), state_stat(profile, "mean")
    far_from_correct = F.abs(number - F.col("correct_num")) / std > 2.0
    far_from_mean = F.abs(number - mean) / std > 3.0
    kind = F.col("issue_type")
    return (
        F.when(kind.isin(*ROW_CHECKS), present)
        .when(kind == "null", present & null_like)
        .when(kind == "type_error", present & ~null_like & number.isNull())
        .when(kind == "constraint", number < 0)
        .when(kind == "outlier", (std > 0) & F.when(F.col("correct_num").isNotNull(), far_from_correct).otherwise(far_from_mean))
        .otherwise(F.lit(False))
    )


def state_stat(profile: TableProfile, stat: str, column: str = "column") -> Column:
    """A profile statistic of the column an issue names, looked up in one literal map."""
    known = {p.column: getattr(p, stat) for p in profile.columns.values() if p.is_numeric}
    known = {c: float(v) for c, v in known.items() if v is not None}
    if not known:
        return F.lit(None).cast("double")
    return F.try_element_at(F.map_from_arrays(F.lit(list(known)), F.lit(list(known.values()))), F.col(column))


def with_cell(issues: DataFrame, table: DataFrame, profile: TableProfile, id_col: str | None = None) -> DataFrame:
    """Each issue with the current state of its cell.

    Adds present (the row exists), cell (text), cell_num and cell_null.  The
    table is first reduced to the rows that have an issue, so a small issue
    table is broadcast and the large one never moves.  The columns of one type
    travel as one array, and the cell is the entry at the place of its name: the
    expressions number as many as the types, however wide the table is.
    """
    types = types_of(table)
    id_col = id_col or profile.id_col
    names: dict[T.DataType, list[str]] = {}
    for c in table.columns:
        if c != id_col and c in profile.columns:
            names.setdefault(types[c], []).append(c)
    wide = table.select(
        quoted(id_col).cast("long").alias("row_id"),
        F.lit(True).alias("present"),
        *[F.array(*map(quoted, cols)).alias(f"_cells{k}") for k, cols in enumerate(names.values())],
    ).join(issues.select("row_id"), "row_id", "left_semi")
    joined = issues.join(wide, "row_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    # the place of a named column among those of its type, 0 elsewhere
    joined = joined.select(
        "*",
        *[
            F.coalesce(F.array_position(F.lit(cols), F.col("column")), F.lit(0)).cast("int").alias(f"_at{k}")
            for k, cols in enumerate(names.values())
        ],
    )
    joined = joined.select(
        "*", *[F.get(f"_cells{k}", F.col(f"_at{k}") - 1).alias(f"_cell{k}") for k in range(len(names))]
    )
    cell, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    null_like = F.lit(True)
    for k, t in enumerate(names):
        here, value = F.col(f"_at{k}") > 0, F.col(f"_cell{k}")
        cell = F.when(here, value.cast("string")).otherwise(cell)
        number = F.when(here, cells.to_number(value, t)).otherwise(number)
        null_like = F.when(here, cells.is_null_like(value, t)).otherwise(null_like)
    return joined.select(
        *[quoted(c) for c in issues.columns],
        "present",
        cell.alias("cell"),
        number.alias("cell_num"),
        null_like.alias("cell_null"),
    )
