"""Scoring a cleaned table against the issues found in the dirty one.

Each component is a one-row aggregate; they are brought together by a union and
one final aggregate, so no component multiplies the rows of another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.functions import cells
from mendframe.operators import compare, detect, validate
from mendframe.operators.frequency import quoted
from mendframe.operators.profile import TableProfile

# Fixed values of the scoring formulas.
FP_STEP, FP_CAP = 0.05, 0.35
DECOY_PENALTY = 0.40
REASON_BONUS = 0.05
REASON_TERMS = (
    "z-score", "z_score", "zscore", "mean", "std",
    "standard dev", "average", "distribution",
    "statistical", "outlier", "sigma",
)
PASS_MARK = 0.50
_TEXT = T.StringType()


def correct_number() -> Column:
    return F.coalesce(F.col("correct_num"), cells.to_number(F.col("correct"), _TEXT))


def matches_correct() -> Column:
    """The cell of an issue equals its correct value, numbers within tolerance."""
    a, b = F.col("cell_num"), correct_number()
    close = (a == b) | (F.abs(a - b) <= cells.MATCH_TOLERANCE * F.greatest(F.abs(a), F.abs(b)))
    text = F.coalesce(F.col("correct"), F.col("correct_num").cast("string"))
    same = cells.fold_key(F.col("cell"), _TEXT) == cells.fold_key(text, _TEXT)
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), close).otherwise(same), F.lit(False))


def resolve(
    issues: DataFrame, cleaned: DataFrame, profile: TableProfile, removed: DataFrame | None = None
) -> DataFrame:
    """The issue table with `resolved` in [0, 1]: how well each issue was handled.

    `removed(row_id)` lists rows reported as deleted; absent rows count as well.
    """
    state = detect.with_cell(issues, cleaned, profile)
    if removed is not None:
        marked = removed.select("row_id", F.lit(True).alias("reported")).distinct()
        state = state.join(marked, "row_id", "left")
    else:
        state = state.withColumn("reported", F.lit(None).cast("boolean"))
    conf, kind = F.col("confidence"), F.col("issue_type")
    gone, null_like, x = ~F.col("present"), F.col("cell_null"), F.col("cell_num")
    correct, hit = correct_number(), matches_correct()
    std, mean = detect.state_stat(profile, "std"), detect.state_stat(profile, "mean")
    from_correct = F.when(std > 0, F.abs(x - correct) / std)
    from_mean = F.when(std > 0, F.abs(x - mean) / std)

    row_rule = F.when(gone | F.col("reported"), F.lit(1.0)).otherwise(F.lit(0.0))
    null_rule = (
        F.when(gone, 0.5 * conf)
        .when(null_like, F.lit(0.0))
        .when((F.col("action") == "any") | hit, conf)
        .otherwise(F.lit(0.0))
    )
    type_rule = F.when(gone, F.lit(0.5)).when(~null_like & x.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    range_rule = (
        F.when(gone, 0.5 * conf)
        .when(x.isNull() | (x < 0), F.lit(0.0))
        .when(correct.isNull() | (x <= F.abs(correct) * 5), conf)
        .otherwise(0.7 * conf)
    )
    outlier_rule = (
        F.when(gone, 0.5 * conf)
        .when(x.isNull(), F.lit(0.0))
        .when(hit | (from_correct <= 2.0), conf)
        .when(from_correct <= 4.0, 0.7 * conf)
        .when(from_mean <= 3.0, conf)
        .when(from_mean <= 5.0, 0.5 * conf)
        .otherwise(F.lit(0.0))
    )
    tidy = F.when(gone | null_like | cells.is_untidy(F.col("cell")), F.lit(0.0)).otherwise(conf)
    category = F.when(gone | null_like, F.lit(0.0)).when(hit, conf).otherwise(F.lit(0.0))
    resolved = (
        F.when(kind.isin(*detect.ROW_CHECKS), row_rule)
        .when(kind == "null", null_rule)
        .when(kind == "type_error", type_rule)
        .when(kind == "constraint", range_rule)
        .when(kind == "outlier", outlier_rule)
        .when(kind == "whitespace", tidy)
        .when(kind == "inconsistent_category", category)
        .otherwise(F.lit(0.0))
    )
    return state.select(*issues.columns, resolved.alias("resolved"))


def _share(types: Sequence[str] | None) -> Column:
    """Confidence-weighted resolution of some types; NULL when there are none."""
    of = F.col("issue_type").isin(*types) if types else F.lit(True)
    weight = F.sum(F.when(of, F.col("confidence")))
    got = F.sum(F.when(of, F.col("resolved") * F.col("confidence")))
    return F.when(weight == 0, F.lit(0.0)).otherwise(got / weight)


def resolution_score(resolved: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """One row (score): 1 when there are no issues of the types."""
    return resolved.agg(F.coalesce(_share(types), F.lit(1.0)).alias("score"))


def resolution_scores(resolved: DataFrame, sets: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """(issues, score): `resolution_score` of several named sets of types, from one aggregate."""
    row = resolved.agg(*[F.coalesce(_share(types), F.lit(1.0)).alias(f"s{i}") for i, types in enumerate(sets.values())])
    entries = [F.struct(F.lit(name).alias("issues"), F.col(f"s{i}").alias("score")) for i, name in enumerate(sets)]
    return row.select(F.explode(F.array(*entries)).alias("s")).select("s.*")


def change_counts(
    dirty: DataFrame,
    cleaned: DataFrame,
    issues: DataFrame,
    id_col: str = "id",
    removed: DataFrame | None = None,
) -> DataFrame:
    """One row: changes (any difference at all) and false_positives.

    A false positive is a changed cell without an issue, or a row that is gone
    without an issue and was not reported in `removed`.
    """
    # what is known of a row joins the dirty table before the diff does: joins by one id, and nothing
    # has to be dealt out again behind the full join; bounded by the number of columns per row
    per_row = issues.groupBy(F.col("row_id").alias("_issue_row")).agg(F.collect_set("column").alias("_issue_columns"))
    row = quoted(id_col).cast("long")
    known = dirty.join(per_row, row == F.col("_issue_row"), "left").drop("_issue_row")
    if removed is not None:
        told = removed.select(F.col("row_id").alias("_told"), F.lit(True).alias("_reported")).distinct()
        known = known.join(told, row == F.col("_told"), "left").drop("_told")
    else:
        known = known.withColumn("_reported", F.lit(None).cast("boolean"))
    marked = compare.changes(known, cleaned, id_col, beside=("_issue_columns", "_reported"))
    change = F.col("change")
    wrong_cell = (change == "changed") & ~F.coalesce(
        F.array_contains("_issue_columns", F.col("column")), F.lit(False)
    )
    wrong_row = (change == "removed") & F.col("_issue_columns").isNull() & F.col("_reported").isNull()
    return marked.agg(
        # cells of a dropped column are neither: the published scores do not see them
        F.count(F.when(change != "dropped", 1)).alias("changes"),
        F.count(F.when(wrong_cell | wrong_row, 1)).alias("false_positives"),
    )


def fp_penalty(false_positives: Column) -> Column:
    return F.least(false_positives * FP_STEP, F.lit(FP_CAP))


def decoy_penalty(
    decoys: DataFrame, cleaned: DataFrame, profile: TableProfile, removed: DataFrame | None = None
) -> DataFrame:
    """One row (decoy_penalty): 0.40 when a decoy is gone or no longer has its value."""
    state = detect.with_cell(decoys, cleaned, profile)
    if removed is not None:
        told = removed.select("row_id", F.lit(True).alias("reported")).distinct()
        state = state.join(told, "row_id", "left")
    else:
        state = state.withColumn("reported", F.lit(None).cast("boolean"))
    x, want = F.col("cell_num"), F.col("decoy_value")
    kept = (x == want) | (F.abs(x - want) <= cells.MATCH_TOLERANCE * F.greatest(F.abs(x), F.abs(want)))
    hit = ~F.col("present") | F.coalesce(F.col("reported"), F.lit(False)) | ~F.coalesce(kept, F.lit(False))
    return state.agg(
        F.when(F.count(F.when(hit, 1)) > 0, F.lit(DECOY_PENALTY)).otherwise(F.lit(0.0)).alias("decoy_penalty")
    )


def reasoning_bonus(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (reasoning_bonus), or one per group `by`: 0.05 when a reason in the log uses a statistical term."""
    reason = F.lower(F.coalesce("reason", F.lit("")))
    named = reduce(lambda a, b: a | b, [reason.contains(t) for t in REASON_TERMS])
    return log.groupBy(*by).agg(
        F.when(F.count(F.when(named, 1)) > 0, F.lit(REASON_BONUS)).otherwise(F.lit(0.0)).alias("reasoning_bonus")
    )


def validation_score(checks: DataFrame) -> DataFrame:
    """One row (validation): the share of checks passed."""
    share = F.count(F.when(F.col("passed"), 1)) / F.count(F.lit(1))
    return checks.agg(share.alias("validation"))


def components(
    dirty: DataFrame,
    cleaned: DataFrame,
    issues: DataFrame,
    profile: TableProfile,
    natural_key: str | None = None,
    removed: DataFrame | None = None,
    decoys: DataFrame | None = None,
    log: DataFrame | None = None,
    validated: bool = True,
    touched: Sequence[str] = (),
    checks: DataFrame | None = None,
) -> DataFrame:
    """One row with every part of the scoring formulas; `checks` spares validating again."""
    if checks is None:
        checks = validate.validate(cleaned, issues, profile, natural_key, touched)
    resolved = resolve(issues, cleaned, profile, removed)
    parts = [
        resolved.agg(
            F.count(F.lit(1)).alias("total_issues"),
            _share(None).alias("res_all"),
            _share(detect.EASY).alias("res_easy"),
            _share(["constraint"]).alias("res_constraint"),
            _share(["outlier"]).alias("res_outlier"),
            _share(["duplicate"]).alias("res_duplicate"),
            _share(["fk_violation"]).alias("res_fk"),
        ),
        change_counts(dirty, cleaned, issues, profile.id_col, removed),
        validation_score(checks),
    ]
    if decoys is not None:
        parts.append(decoy_penalty(decoys, cleaned, profile, removed))
    if log is not None:
        parts.append(reasoning_bonus(log))
    if removed is not None:
        parts.append(removed.agg(F.count(F.lit(1)).alias("reported_rows")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = {
        "total_issues": 0, "res_all": None, "res_easy": None, "res_constraint": None, "res_outlier": None,
        "res_duplicate": None, "res_fk": None, "changes": 0, "false_positives": 0, "validation": 0.0,
        "decoy_penalty": 0.0, "reasoning_bonus": 0.0, "reported_rows": 0,
    }
    row = stacked.agg(*[F.max(c).alias(c) for c in names if c in stacked.columns])
    for c, default in names.items():
        if c not in row.columns:
            row = row.withColumn(c, F.lit(default))
        elif default is not None:
            row = row.withColumn(c, F.coalesce(c, F.lit(default)))
    skipped = F.lit(not validated) & (F.col("total_issues") > 0)
    row = row.withColumn(
        "validation",
        cells.round_to(F.when(skipped, F.col("validation") * 0.5).otherwise(F.col("validation")), 4),
    )
    row = row.withColumn("fp_penalty", fp_penalty(F.col("false_positives")))
    if not validated:
        row = row.withColumn("reasoning_bonus", F.lit(0.0))
    unchanged = (F.col("changes") == 0) & (F.col("reported_rows") == 0) & (F.col("total_issues") > 0)
    return row.withColumn("unchanged", unchanged)


def _final(raw: Column) -> Column:
    return F.when(F.col("unchanged"), F.lit(0.0)).otherwise(cells.clamp01(cells.round_to(raw, 4)))


def _full(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(1.0))


def with_levels(parts: DataFrame) -> DataFrame:
    """The component row with the raw easy, medium and hard scores and the generic preset."""
    fp = F.col("fp_penalty")
    out = parts.withColumn("easy", _final(0.70 * _full("res_easy") + 0.30 * F.col("validation") - fp))
    mean = (_full("res_constraint") + _full("res_outlier") + _full("res_duplicate")) / 3.0
    out = out.withColumn("medium", _final(0.70 * F.col("easy") + 0.30 * mean - fp))
    extra = F.col("reasoning_bonus") - F.col("decoy_penalty")
    hard = F.when(
        F.col("res_fk").isNull(), F.col("medium") + extra
    ).otherwise(0.70 * F.col("medium") + 0.30 * F.col("res_fk") + extra)
    out = out.withColumn("hard", _final(hard))
    generic = (
        0.60 * _full("res_all") + 0.30 * F.col("validation") + 0.10 * F.col("reasoning_bonus")
        - fp - F.col("decoy_penalty")
    )
    return out.withColumn("generic", _final(generic))


def scaled(raw: Column) -> Column:
    """Raw score to the open interval (0, 1)."""
    return cells.round_to(0.01 + 0.98 * raw, 4)


def score(level: str, parts: DataFrame) -> DataFrame:
    """The component row with `raw` and the scaled `score` of one level."""
    if level not in ("easy", "medium", "hard", "generic"):
        raise ValueError(f"Unknown level '{level}'. Use easy, medium, hard or generic.")
    raw = F.col(level)
    return with_levels(parts).select(
        F.lit(level).alias("level"),
        *[c for c in parts.columns],
        raw.alias("raw"),
        scaled(raw).alias("score"),
    )


def summary(scores: DataFrame) -> DataFrame:
    """(level, score, result, average) over score rows of several levels."""
    average = scores.agg(cells.round_to(F.avg("score"), 4).alias("score")).select(F.lit("average").alias("level"), "score")
    every = scores.select("level", "score").unionByName(average)
    return every.withColumn("result", F.when(F.col("score") >= PASS_MARK, F.lit("Pass")).otherwise(F.lit("Fail")))
