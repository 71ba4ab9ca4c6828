"""Seeded error injection with ground truth, for measuring cleaners.

Cells are picked by a hash of seed, type, column and row id, so the same seed picks
the same cells on any partitioning; a rule over the row id can take the hash's place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.functions import cells
from mendframe.operators import detect, profile as prof, quantiles, repair
from mendframe.operators.dimension import ORPHAN_OFFSET, Dimension
from mendframe.operators.frequency import quoted, types_of
from mendframe.operators.profile import TableProfile
from mendframe.session import materialize

# The planted text, the order of planted types, their confidence,
# and the fewest issues a level should have.
INVALID_TEXT = "INVALID_TEXT"
PLANT_ORDER = ("null", "type_error", "constraint")
PLANT_CONFIDENCE = {"null": 0.95, "type_error": 1.0, "constraint": 0.95}
MINIMUM_ISSUES = {"easy": 3, "medium": 5, "hard": 7}
DECOY_MAX_Z = 2.0


def _shuffled(names: Sequence[str], seed: int, salt: str) -> list[str]:
    return sorted(names, key=lambda c: hashlib.sha256(f"{seed}:{salt}:{c}".encode()).hexdigest())


def plan(
    profile: TableProfile, n: int, seed: int, checks: Sequence[str], natural_key: str | None
) -> dict[tuple[str, str], int]:
    """How many errors of which type go into which column.

    Types take turns in their fixed order, columns in seeded order; the row id
    and the natural key are never touched.
    """
    free = [p for p in profile.checked() if p.column != natural_key and p.present]
    numeric = [p for p in free if p.is_numeric]
    positive = [p.column for p in numeric if p.must_be_positive]
    positive = positive or [p.column for p in numeric if (p.min or 0) > 0]
    eligible = {
        "null": [p.column for p in free],
        "type_error": [p.column for p in numeric],
        "constraint": positive,
    }
    turns = [k for k in PLANT_ORDER if k in checks and eligible[k]]
    counts: dict[tuple[str, str], int] = {}
    for kind, errors in _shares(turns, n):
        counts |= {(kind, c): k for c, k in _shares(_shuffled(eligible[kind], seed, kind), errors)}
    return counts


def _shares(names: Sequence[str], n: int) -> list[tuple[str, int]]:
    """How often each name has its turn when `n` turns go round; those without one are left out."""
    if not names:
        return []
    each, rest = divmod(n, len(names))
    return [(c, each + (i < rest)) for i, c in enumerate(names) if each or i < rest]


def inject_errors(
    df: DataFrame,
    profile: TableProfile,
    n: int,
    seed: int = 42,
    checks: Sequence[str] = PLANT_ORDER,
    issues: DataFrame | None = None,
    natural_key: str | None = None,
    order: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(dirty table, issue table of the planted errors).

    Cells that already have an issue are left alone.  Numeric columns that
    receive text become text columns.  `order`, a whole number over `row_id`, picks
    rows by a rule instead of by the seeded hash.
    """
    counts = plan(profile, n, seed, checks, natural_key)
    if not counts:
        return df, detect.empty_issues(df)
    errors = [c for kind, c in counts if kind == "type_error"]
    if errors:
        profile = prof.with_medians(df, profile, sorted(set(errors)))
    picked = _pick(df, profile, counts, seed, issues, order)
    number = F.col("original_num")
    correct_num = F.when(F.col("issue_type") == "type_error", detect.state_stat(profile, "median")).otherwise(number)
    confidence = F.coalesce(
        *[F.when(F.col("issue_type") == k, F.lit(v)) for k, v in PLANT_CONFIDENCE.items()]
    )
    found = picked.select(
        cells.issue_id(F.lit(profile.table), F.col("row_id"), F.col("column"), F.col("issue_type")).alias("issue_id"),
        "issue_type",
        F.lit(profile.table).alias("table"),
        "row_id",
        "column",
        F.when(correct_num.isNull(), F.col("original")).alias("correct"),
        correct_num.alias("correct_num"),
        F.lit("set").alias("action"),
        confidence.alias("confidence"),
    )
    value = (
        F.when(F.col("issue_type") == "type_error", F.lit(INVALID_TEXT))
        .when(F.col("issue_type") == "constraint", (-F.abs(number)).cast("string"))
        .otherwise(F.lit(None).cast("string"))
    )
    as_text = set(errors)
    widened = df.select(
        *[quoted(c).cast("string").alias(c) if c in as_text else quoted(c) for c in df.columns]
    )
    fixes = picked.select("row_id", "column", value.alias("value"))
    return repair.apply_fixes(widened, fixes, profile.id_col), found


def _pick(df, profile, counts, seed, issues, order=None) -> DataFrame:
    """(row_id, issue_type, column, original, original_num): the cells to change.

    The cells of a (type, column) with the smallest places are taken.  Their
    last place is searched by rank, so however many cells are planted, no task
    sorts them; only cells that share that very place are told apart by row id.
    """
    types = types_of(df)
    kinds: dict[str, list[str]] = {}
    for kind, c in counts:
        kinds.setdefault(c, []).append(kind)
    rows = df.withColumn("row_id", quoted(profile.id_col).cast("long"))
    free = {c: F.lit(True) for c in kinds}
    if issues is not None:
        taken = issues.where(F.col("column").isNotNull()).groupBy(F.col("row_id").alias("_row"))
        rows = rows.join(taken.agg(F.collect_set("column").alias("_taken")), F.col("row_id") == F.col("_row"), "left")
        free = {c: ~F.coalesce(F.array_contains("_taken", c), F.lit(False)) for c in kinds}
    entries, places = [], []
    for c, wanted in kinds.items():
        col, t = quoted(c), types[c]
        number = cells.to_number(col, t)
        # each cell belongs to one type, so that no cell is picked twice
        turn = F.pmod(_place(seed, "type", c, order), F.lit(len(wanted)))
        for i, kind in enumerate(wanted):
            fits = free[c] & cells.not_null_like(col, t) & (turn == i)
            if kind != "null":
                fits = fits & number.isNotNull()
            if kind == "constraint":
                fits = fits & (number > 0)
            entries.append((kind, c, number))
            places.append(F.when(fits, _place(seed, kind, c, order)).cast("double").alias(f"_at{len(places)}"))
    # the search for the last places and the pick read the same few columns: hashed and joined with the issues once
    kept = [quoted(c) for c in dict.fromkeys(c for _, c, _ in entries) if c != "row_id"]
    placed = materialize(rows.select("row_id", *kept, *places), "places")
    last = _last_places(placed, [counts[(kind, c)] for kind, c, _ in entries])
    chosen = [
        F.when(
            F.col(f"_at{i}") <= last[i][0],
            F.struct(
                F.lit(kind).alias("issue_type"),
                F.lit(c).alias("column"),
                quoted(c).cast("string").alias("original"),
                number.alias("original_num"),
                (F.col(f"_at{i}") == last[i][0]).alias("tie"),
                F.lit(last[i][1]).alias("ties_wanted"),
            ),
        )
        for i, (kind, c, number) in enumerate(entries)
        if last[i] is not None
    ]
    if not chosen:
        return placed.select("row_id", F.lit("").alias("issue_type"), F.lit("").alias("column"), F.lit("").alias("original"), F.lit(0.0).alias("original_num")).limit(0)
    picked = placed.select("row_id", F.explode(F.array_compact(F.array(*chosen))).alias("x")).select("row_id", "x.*")
    rank = F.row_number().over(Window.partitionBy("issue_type", "column").orderBy("row_id"))
    ties = picked.where("tie").withColumn("rank", rank).where(F.col("rank") <= F.col("ties_wanted")).drop("rank")
    return picked.where("NOT tie").unionByName(ties).drop("tie", "ties_wanted")


def _place(seed: int, salt: str, column: str, order: Column | None) -> Column:
    """Where a row stands when cells are picked: by hash, in 52 bits that a double holds exactly, or as the caller says."""
    if order is not None:
        return order
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.lit(column), F.col("row_id")), F.lit(1 << 52))


def _last_places(placed: DataFrame, wanted: list[int]) -> list[tuple[float, int] | None]:
    """Per place column: the place of its `wanted`th row and how many rows with that very place are taken; None without rows."""
    names = [f"_at{i}" for i in range(len(wanted))]
    ends = placed.agg(*[f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max, F.count)]).head()
    have = {n: ends[f"count{n}"] for n in names}
    ranks = {n: [min(k, have[n]) - 1] for n, k in zip(names, wanted, strict=True) if have[n]}
    if not ranks:
        return [None] * len(names)
    bounds = {n: (ends[f"min{n}"], ends[f"max{n}"], have[n]) for n in ranks}
    found = quantiles.values_at_ranks(placed, {n: F.col(n) for n in ranks}, ranks, bounds)
    last = {n: found[(n, k[0])] for n, k in ranks.items()}
    before = placed.agg(*[F.count(F.when(F.col(n) < last[n], 1)).alias(n) for n in last]).head()
    return [(last[n], ranks[n][0] + 1 - before[n]) if n in last else None for n in names]


def top_up(df, table, level="hard", seed=42, id_col="id", references=None):
    """(table, issues): detected issues, with errors planted up to the level's minimum."""
    checks = detect.LEVELS[level]
    rules = detect.learn(df, table, id_col, checks)
    found = detect.detect(df, table, id_col, checks=checks, references=references, rules=rules)
    have = found.limit(MINIMUM_ISSUES[level]).count()
    missing = MINIMUM_ISSUES[level] - have
    if missing <= 0:
        return df, found
    dirty, planted = inject_errors(df, rules.profile, missing, seed, checks, found, rules.natural_key)
    return dirty, found.unionByName(planted)


def decoy_column(profile: TableProfile, busy: Sequence[str] = ()) -> str | None:
    """Numeric column with the highest std, one without issues if there is any."""
    numeric = [p for p in profile.checked() if p.is_numeric and p.std]
    quiet = [p for p in numeric if p.column not in set(busy)]
    best = max(quiet or numeric, key=lambda p: p.std, default=None)
    return best.column if best else None


def inject_decoy(
    df: DataFrame, profile: TableProfile, issues: DataFrame, seed: int = 42, order: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(table with one doubled value, decoy table).

    The row has no issue and, if possible, an unremarkable value; `order` as in `inject_errors`.
    """
    spark = df.sparkSession
    busy = [r["column"] for r in issues.select("column").distinct().collect() if r["column"]]
    column = decoy_column(profile, busy)
    schema = "table string, row_id long, column string, decoy_value double, original double"
    if column is None:
        return df, spark.createDataFrame([], schema)
    p = profile[column]
    number = cells.to_number(quoted(column), types_of(df)[column])
    rows = df.select(quoted(profile.id_col).cast("long").alias("row_id"), number.alias("original")).where(
        F.col("original").isNotNull()
    )
    clean = rows.join(issues.select("row_id"), "row_id", "left_anti")
    unusual = F.abs((F.col("original") - F.lit(p.mean)) / F.lit(p.std)) >= DECOY_MAX_Z
    chosen = clean.orderBy(unusual, _place(seed, "decoy", column, order), "row_id").limit(1)
    decoys = chosen.select(
        F.lit(profile.table).alias("table"),
        "row_id",
        F.lit(column).alias("column"),
        F.round(F.col("original") * 2.0, 2).alias("decoy_value"),
        "original",
    )
    fixes = decoys.select("row_id", "column", F.col("decoy_value").cast("string").alias("value"))
    return repair.apply_fixes(df, fixes, profile.id_col), decoys


def inject_lookup_errors(dim: Dimension, id_col: str = "id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(facts, lookup): one row refers to no entry, one entry has lost its label."""
    victim = (
        dim.facts.select(quoted(id_col).cast("long").alias("row_id"))
        .orderBy(F.xxhash64(F.lit(seed), F.lit("orphan"), F.col("row_id")), "row_id")
        .limit(1)
    )
    last = dim.lookup.agg(F.max("id").alias("last")).first()["last"]
    fixes = victim.select(
        "row_id", F.lit(dim.ref_column).alias("column"), F.lit(str(last + ORPHAN_OFFSET)).alias("value")
    )
    facts = repair.apply_fixes(dim.facts, fixes, id_col)
    blank = (
        dim.lookup.select(F.col("id").alias("row_id"))
        .orderBy(F.xxhash64(F.lit(seed), F.lit("label"), F.col("row_id")), "row_id")
        .limit(1)
        .select("row_id", F.lit("label").alias("column"), F.lit(None).cast("string").alias("value"))
    )
    return facts, repair.apply_fixes(dim.lookup, blank, "id")
