"""Scoring a log of cleaning actions.

The log is a table (episode, step, action_type, ...).  Facts about the cells
and rows that actions name are looked up once per distinct cell and joined back
with hot cells spread, so neither a popular cell nor a long episode gathers in
one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.functions import cells
from mendframe.operators import detect, skew
from mendframe.operators.profile import TableProfile

# Rewards, caps, and the issue types each intent cares about.
INVEST_REWARDS = {"inspect": 0.02, "profile_column": 0.03, "run_sql": 0.03, "select_tables": 0.02}
CAPS = {"inspect": 3, "profile_column": 3, "run_sql": 3, "validate": 2, "select_tables": 2}
VALIDATE_REWARD = 0.05
FIX_CORRECT, FIX_FALSE_POSITIVE, FIX_DECOY, FIX_WRONG_VALUE = 0.15, -0.20, -0.40, -0.10
DELETE_CORRECT, DELETE_FALSE_POSITIVE = 0.15, -0.20
SUBMIT_ALL_RESOLVED, SUBMIT_ISSUES_OPEN = 0.10, -0.10
INTENT_STEP = 0.10
JOIN_REWARD = 0.20
INTENT_TYPES = {
    "visualization": ("null", "type_error", "whitespace", "inconsistent_category"),
    "ml_training": ("null", "type_error", "constraint", "outlier", "duplicate"),
    "business_query": ("null", "whitespace", "inconsistent_category", "type_error", "fk_violation", "constraint"),
}
BULK_TYPES = ("null", "type_error", "whitespace")
INVESTIGATIONS = ("inspect", "profile_column", "run_sql")

LOG_COLUMNS = {
    "episode": "string", "step": "long", "action_type": "string", "table": "string", "row_id": "long",
    "column": "string", "value": "string", "reason": "string", "checks_passed": "int", "total_checks": "int",
    "join_valid": "boolean", "open_issues": "long",
}
COMPONENTS = ("invest", "fix_delta", "validate_b", "penalty", "intent_r", "join_r")
_TEXT = T.StringType()


def normalized(log: DataFrame) -> DataFrame:
    """The log with every known column, missing ones NULL."""
    return log.select(
        *[
            (F.col(c) if c in log.columns else F.lit(None)).cast(t).alias(c)
            for c, t in LOG_COLUMNS.items()
        ]
    )


def capped_steps(log: DataFrame) -> DataFrame:
    """(episode, step, action_type, in_cap): the actions that still earn an investigation reward.

    Only the first few steps per episode and action matter; the constant bound
    on the rank lets every task drop the others before the shuffle.  Rows that
    repeat a step and action share one place under the cap.
    """
    counted = log.where(F.col("action_type").isin(*CAPS)).select("episode", "action_type", "step")
    first = F.dense_rank().over(Window.partitionBy("episode", "action_type").orderBy("step"))
    cap = F.coalesce(*[F.when(F.col("action_type") == a, F.lit(n)) for a, n in CAPS.items()])
    return (
        counted.withColumn("nth", first)
        .where(F.col("nth") <= max(CAPS.values()))
        .where(F.col("nth") <= cap)
        .select("episode", "step", "action_type", F.lit(True).alias("in_cap"))
        .distinct()
    )


def _winning_issue(issues: DataFrame) -> DataFrame:
    """(row_id, column, issue): the last finding per cell, in detection order."""
    order = F.lit(-1)
    for i, kind in enumerate(detect.DETECTION_ORDER):
        order = F.when(F.col("issue_type") == kind, F.lit(i)).otherwise(order)
    return (
        issues.where(F.col("column").isNotNull())
        .groupBy("row_id", "column")
        .agg(F.max_by(F.struct("issue_type", "correct", "correct_num", "action"), order).alias("issue"))
    )


def _values_agree(text: Column, other: Column) -> Column:
    return cells.values_match(text, _TEXT, other, _TEXT)


def cell_facts(
    log: DataFrame,
    issues: DataFrame,
    decoys: DataFrame | None,
    originals: Mapping[str, DataFrame],
    primary: str,
    profile: TableProfile,
) -> DataFrame:
    """One row per distinct cell or row named by a fix or a delete, with what is known of it."""
    targets = log.where(_names_a_row()).groupBy(*_target_key()).agg(F.count(F.lit(1)).alias("n"))
    targets = targets.withColumnRenamed("cell", "column")
    known = targets.join(_winning_issue(issues), ["row_id", "column"], "left")
    due = issues.where(F.col("issue_type").isin(*detect.ROW_CHECKS)).select("row_id").distinct()
    known = known.join(due.withColumn("deletable", F.lit(True)), "row_id", "left")
    if decoys is not None:
        marked = decoys.select("row_id", "column").distinct().withColumn("decoy", F.lit(True))
        known = known.join(marked, ["row_id", "column"], "left")
    else:
        known = known.withColumn("decoy", F.lit(None).cast("boolean"))
    parts = []
    for table, df in originals.items():
        mine = known.where(F.col("table") == table)
        ids = TableProfile(table, profile.id_col, 0, {c: None for c in df.columns})
        state = detect.with_cell(mine, df, ids)
        parts.append(state.select(*known.columns, F.col("cell").alias("original")))
    rest = known.where(~F.col("table").isin(list(originals)))
    parts.append(rest.withColumn("original", F.lit(None).cast("string")))
    facts = reduce(DataFrame.unionByName, parts)
    return facts.withColumnRenamed("column", "cell")


def _names_a_row() -> Column:
    return F.coalesce(F.col("action_type").isin("fix_cell", "delete_row"), F.lit(False)) & F.col("row_id").isNotNull()


def _target_key() -> list[Column]:
    return [F.col("table"), F.col("row_id"), F.coalesce("column", F.lit("")).alias("cell")]


def fix_resolves(profile: TableProfile, value: Column, value_type: T.DataType = _TEXT) -> Column:
    """Whether a proposed value resolves the issue in the `issue` struct column."""
    kind = F.col("issue.issue_type")
    correct = F.coalesce("issue.correct", F.col("issue.correct_num").cast("string"))
    wanted = F.coalesce("issue.correct_num", cells.to_number(F.col("issue.correct"), _TEXT))
    x = cells.to_number(value, value_type)
    filled = ~cells.is_null_like(value, value_type)
    std, mean = detect.state_stat(profile, "std", "cell"), detect.state_stat(profile, "mean", "cell")
    has_std = std > 0
    same = _values_agree(value, correct)
    # text was expected and text was given
    both_text = wanted.isNull()
    null_ok = filled & ((F.col("issue.action") == "any") | same | (wanted.isNotNull() & x.isNotNull()) | both_text)
    near = (
        F.when(has_std, F.abs(x - wanted) / std <= 2.0)
        .when(wanted != 0, F.abs(x - wanted) <= F.abs(wanted) * 0.20)
        .otherwise(x == 0)
    )
    plausible = F.when(has_std, F.abs(x - mean) / std <= 3.0).otherwise(F.lit(True))
    outlier_ok = x.isNotNull() & F.when(wanted.isNotNull(), near).otherwise(plausible)
    rule = (
        F.when(kind == "null", null_ok)
        .when(kind == "type_error", x.isNotNull())
        .when(kind == "constraint", x >= 0)
        .when(kind == "outlier", outlier_ok)
        .when(kind == "whitespace", filled & ~cells.is_untidy(value))
        .when(kind == "inconsistent_category", filled & same)
    )
    return F.coalesce(rule, F.lit(False))


def action_rewards(
    log: DataFrame,
    issues: DataFrame,
    originals: Mapping[str, DataFrame],
    profile: TableProfile,
    decoys: DataFrame | None = None,
    intent: str | None = None,
    correct_intent: str | None = None,
    n_tables: int | None = None,
    log_rows: int | None = None,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """(episode, step, action_type, invest, fix_delta, ..., total) per action.

    `originals` maps table names to the tables before any repair, the primary
    table is the profiled one.  `log_rows` bounds the log; it is counted when
    not given.
    """
    primary = profile.table
    n_tables = len(originals) if n_tables is None else n_tables
    log = normalized(log).withColumn("table", F.coalesce("table", F.lit(primary)))
    total_rows = log.count() if log_rows is None else log_rows

    facts = cell_facts(log, issues, decoys, originals, primary, profile)
    keyed = log.withColumn("cell", F.coalesce("column", F.lit("")))
    named = _names_a_row()
    # actions without a row would all share the empty key, so they skip the join
    joined = skew.join_to_counted(
        keyed.where(named), facts, ["table", "row_id", "cell"], "n", F.struct("episode", "step"), total_rows,
        hot_rows=hot_rows,
    ).unionByName(keyed.where(~named), allowMissingColumns=True)
    # at most one row per column
    bulk = issues.groupBy("column").agg(
        F.count(F.when(F.col("issue_type").isin(*BULK_TYPES), 1)).alias("bulk_issues"),
        F.max(F.col("issue_type").isin(*_aligned(intent, BULK_TYPES))).alias("bulk_aligned"),
    )
    joined = joined.join(F.broadcast(bulk), "column", "left")
    joined = joined.join(capped_steps(log), ["episode", "step", "action_type"], "left")
    n_issues = issues.count()

    zero, action = F.lit(0.0), F.col("action_type")
    in_cap = F.coalesce("in_cap", F.lit(False))
    rewards = {a: r for a, r in INVEST_REWARDS.items() if a != "select_tables" or n_tables >= 2}
    invest = zero
    for a, r in rewards.items():
        invest = F.when((action == a) & in_cap, F.lit(r)).otherwise(invest)
    share = F.col("checks_passed") / F.col("total_checks")
    validate_b = F.when(
        (action == "validate") & in_cap & (F.col("total_checks") > 0), F.round(VALIDATE_REWARD * share, 4)
    ).otherwise(zero)

    has_issue = F.col("issue").isNotNull()
    incomplete = F.col("row_id").isNull() | F.col("column").isNull()
    is_decoy = F.coalesce("decoy", F.lit(False))
    solves = fix_resolves(profile, F.col("value"))
    unchanged = F.col("original").isNotNull() & F.coalesce(
        _values_agree(F.col("value"), F.col("original")), F.lit(False)
    )
    deletable = F.coalesce("deletable", F.lit(False))
    n_bulk = F.coalesce("bulk_issues", F.lit(0))
    bulk_share = F.least(n_bulk / F.lit(max(n_issues, 1)), F.lit(1.0))

    cell_delta = F.when(incomplete | is_decoy | ~has_issue, zero).when(solves, F.lit(FIX_CORRECT)).otherwise(F.lit(FIX_WRONG_VALUE))
    cell_penalty = (
        F.when(incomplete, F.lit(FIX_FALSE_POSITIVE))
        .when(is_decoy, F.lit(FIX_DECOY))
        .when(has_issue | unchanged, zero)
        .otherwise(F.lit(FIX_FALSE_POSITIVE))
    )
    none_open = F.col("open_issues") == 0
    fix_delta = (
        F.when(action == "fix_cell", cell_delta)
        .when((action == "delete_row") & deletable, F.lit(DELETE_CORRECT))
        .when((action == "fix_column") & (n_bulk > 0), F.round(FIX_CORRECT * (1.0 + 2.0 * bulk_share), 4))
        .when((action == "submit") & none_open, F.lit(SUBMIT_ALL_RESOLVED))
        .otherwise(zero)
    )
    penalty = (
        F.when(action == "fix_cell", cell_penalty)
        .when((action == "delete_row") & ~deletable, F.lit(DELETE_FALSE_POSITIVE))
        .when((action == "fix_column") & F.col("column").isNull(), F.lit(FIX_FALSE_POSITIVE))
        .when((action == "fix_column") & (n_bulk == 0), F.lit(FIX_FALSE_POSITIVE * 0.5))
        .when((action == "submit") & ~F.coalesce(none_open, F.lit(False)), F.lit(SUBMIT_ISSUES_OPEN))
        .otherwise(zero)
    )
    intent_r = _intent_reward(action, intent, correct_intent, fix_delta)
    join_r = F.when((action == "join_tables") & F.col("join_valid"), F.lit(JOIN_REWARD)).when(
        (action == "join_tables") & ~F.col("join_valid"), F.lit(-JOIN_REWARD)
    ).otherwise(zero)

    scored = joined.select(
        "episode",
        "step",
        "action_type",
        invest.alias("invest"),
        fix_delta.alias("fix_delta"),
        validate_b.alias("validate_b"),
        penalty.alias("penalty"),
        intent_r.alias("intent_r"),
        join_r.alias("join_r"),
    )
    total = reduce(lambda a, b: a + b, [F.col(c) for c in COMPONENTS])
    return scored.withColumn("total", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(total, 4))))


def _aligned(intent: str | None, types) -> list[str]:
    return [t for t in types if t in INTENT_TYPES.get(intent, ())] or [""]


def _intent_reward(action: Column, intent, correct_intent, fix_delta: Column) -> Column:
    zero = F.lit(0.0)
    guess = F.lower(cells.strip_blanks(F.coalesce("value", F.lit(""))))
    known = guess.isin(*INTENT_TYPES)
    out = zero
    if correct_intent is not None:
        out = F.when(action == "classify_intent", F.when(guess == correct_intent, F.lit(INTENT_STEP)).otherwise(F.lit(-INTENT_STEP))).otherwise(out)
    out = F.when((action == "classify_intent") & ~known, F.lit(-INTENT_STEP * 0.5)).otherwise(out)
    if intent is not None:
        good = fix_delta > 0
        relevant = F.coalesce(F.col("issue.issue_type").isin(*INTENT_TYPES.get(intent, ("",))), F.lit(False))
        out = F.when((action == "fix_cell") & good & relevant, F.lit(INTENT_STEP * 0.5)).otherwise(out)
        bulk = F.coalesce("bulk_aligned", F.lit(False))
        out = F.when((action == "fix_column") & good & bulk, F.lit(INTENT_STEP * 0.5)).otherwise(out)
    if intent == "visualization":
        out = F.when((action == "delete_row") & (fix_delta > 0), F.lit(-INTENT_STEP * 0.3)).otherwise(out)
    return out


def episode_totals(rewards: DataFrame, final_scores: DataFrame | None = None) -> DataFrame:
    """Per episode: steps, investigations, every reward component, and the reward.

    `final_scores(episode, score)` replaces the reward of submit and export.
    """
    closing = F.coalesce(F.col("action_type").isin("submit", "export"), F.lit(False))
    sums = rewards.groupBy("episode").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count(F.when(F.col("action_type").isin(*INVESTIGATIONS), 1)).alias("investigations"),
        *[F.round(F.sum(c), 4).alias(c) for c in COMPONENTS],
        F.sum("total").alias("_total"),
        F.sum(F.when(~closing, F.col("total"))).alias("_open"),
        F.count(F.when(closing, 1)).alias("_closings"),
    )
    reward = F.col("_total")
    if final_scores is not None:
        # closing steps of an episode all earn its score: their number is enough, so a
        # long episode is one row when it meets its score
        sums = sums.join(final_scores.select("episode", "score"), "episode", "left")
        scored = F.coalesce("_open", F.lit(0.0)) + F.col("score") * F.col("_closings")
        reward = F.when(F.col("score").isNotNull() & (F.col("_closings") > 0), scored).otherwise(reward)
    return sums.select("episode", "steps", "investigations", *COMPONENTS, F.round(reward, 4).alias("reward"))
