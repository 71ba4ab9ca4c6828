"""Outcome measures of a cleaned table: intent, downstream use, over-cleaning, joins."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions import cells
from mendframe.operators import detect, score
from mendframe.operators.frequency import quoted, types_of
from mendframe.operators.profile import TableProfile

# Issue types each intent cares about, names of the intents that
# are measured by kept rows or by reporting issues, and the neutral scores.
ML_TYPES = ("outlier", "type_error", "constraint")
REPORTING_TYPES = ("whitespace", "inconsistent_category", "null")
DASHBOARD_INTENTS = ("dashboard", "visualization")
REPORTING_INTENTS = ("reporting", "business_query")
NEUTRAL_INTENT = 0.8
NEUTRAL_ML = 0.75
NO_NUMERIC = 0.80
KEEP_SHARE = 0.20
MIN_TRAINING = 10


def row_counts(dirty: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: rows_before, rows_after."""
    before = dirty.agg(F.count(F.lit(1)).alias("rows_before"))
    after = cleaned.agg(F.count(F.lit(1)).alias("rows_after"))
    both = before.unionByName(after, allowMissingColumns=True)
    return both.agg(F.max("rows_before").alias("rows_before"), F.max("rows_after").alias("rows_after"))


def settled(issues: DataFrame, cleaned: DataFrame, profile: TableProfile) -> DataFrame:
    """The issue table with `settled`: a yes/no version of the resolution rules."""
    state = detect.with_cell(issues, cleaned, profile)
    kind, x, null_like = F.col("issue_type"), F.col("cell_num"), F.col("cell_null")
    std, mean = detect.state_stat(profile, "std"), detect.state_stat(profile, "mean")
    no_std = std.isNull() | (std == 0)
    rule = (
        F.when(~F.col("present"), kind.isin(*detect.ROW_CHECKS))
        .when(kind == "null", ~null_like)
        .when(kind == "type_error", x.isNotNull())
        .when(kind == "constraint", x >= 0)
        .when(kind == "outlier", no_std | (F.abs(x - mean) / std <= 3.0))
        .when(kind == "whitespace", ~null_like & ~cells.is_untidy(F.col("cell")))
        .when(kind == "inconsistent_category", score.matches_correct())
    )
    return state.select(*issues.columns, F.coalesce(rule, F.lit(False)).alias("settled"))


def intent_alignment(
    intent: str | None, dirty: DataFrame, cleaned: DataFrame, issues: DataFrame, profile: TableProfile
) -> DataFrame:
    """One row (intent_alignment) in [0, 1]."""
    if intent in DASHBOARD_INTENTS:
        kept = F.col("rows_after") / F.greatest("rows_before", F.lit(1))
        steps = F.when(kept >= 0.90, 1.0).when(kept >= 0.80, 0.85).when(kept >= 0.70, 0.60).otherwise(kept)
        return row_counts(dirty, cleaned).select(steps.alias("intent_alignment"))
    types = ML_TYPES if intent == "ml_training" else REPORTING_TYPES if intent in REPORTING_INTENTS else None
    if types is None:
        return dirty.sparkSession.createDataFrame([(NEUTRAL_INTENT,)], "intent_alignment double")
    relevant = settled(issues.where(F.col("issue_type").isin(*types)), cleaned, profile)
    share = F.count(F.when(F.col("settled"), 1)) / F.count(F.lit(1))
    return relevant.agg(F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(share).alias("intent_alignment"))


def null_ratio_score(ratio: Column) -> Column:
    return (
        F.when(ratio == 0, 1.0)
        .when(ratio <= 0.05, 0.90)
        .when(ratio <= 0.15, 0.70)
        .when(ratio <= 0.30, 0.50)
        .otherwise(F.greatest(F.lit(0.20), 1.0 - ratio))
    )


def downstream_nulls(cleaned: DataFrame, profile: TableProfile) -> DataFrame:
    """One row (cells, null_cells, downstream): empty cells in the numeric columns."""
    types = types_of(cleaned)
    numeric = [c for c, p in profile.columns.items() if p.is_numeric and c != profile.id_col and c in types]
    rows = F.count(F.lit(1))
    if not numeric:
        empty = cleaned.agg(rows.alias("rows"))
        neutral = F.when(F.col("rows") == 0, 0.0).otherwise(NO_NUMERIC)
        return empty.select(F.lit(0).cast("long").alias("cells"), F.lit(0).cast("long").alias("null_cells"), neutral.alias("downstream"))

    def gone(c):
        col = quoted(c)
        return col.isNull() | F.isnan(col) if cells.can_be_nan(types[c]) else col.isNull()

    nulls = reduce(lambda a, b: a + b, [F.count(F.when(gone(c), 1)) for c in numeric])
    counted = cleaned.agg((rows * len(numeric)).alias("cells"), nulls.alias("null_cells"))
    ratio = F.col("null_cells") / F.col("cells")
    return counted.withColumn(
        "downstream", F.when(F.col("cells") == 0, F.lit(0.0)).otherwise(null_ratio_score(ratio))
    )


def ml_columns(profile: TableProfile) -> tuple[str | None, list[str]]:
    """Target (first column with two values) and numeric feature columns.

    Needs the distinct counts of the profile.
    """
    target, features = None, []
    for p in profile.checked():
        if p.unique_count == 2 and target is None:
            target = p.column
        elif p.is_numeric:
            features.append(p.column)
    return target, features


def penalty_strength(rows: int) -> float:
    """Spark's weight of half the squared coefficients that equals a sum of `rows` losses with weight 1 each."""
    return 1.0 / max(rows, 1)


def _training_accuracy(df: DataFrame, target: str, features: list[str]) -> float | None:
    types = types_of(df)
    names = [f"f{i}" for i in range(len(features))]
    data = df.where(quoted(target).isNotNull()).select(
        quoted(target).cast("string").alias("target"),
        *[
            F.coalesce(cells.to_number(quoted(c), types[c]), F.lit(0.0)).alias(n)
            for c, n in zip(features, names, strict=True)
        ],
    )
    rows = data.count()
    if rows < MIN_TRAINING:
        return None
    indexer = StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc").fit(data)
    train = VectorAssembler(inputCols=names, outputCol="features").transform(indexer.transform(data))
    # an L2 term on the features as they are, not on scaled ones
    fit = LogisticRegression(maxIter=300, regParam=penalty_strength(rows), elasticNetParam=0.0, standardization=False)
    model = fit.fit(train.select("features", "label"))
    # the fitted model as plain expressions: one scan, no vectors
    predicted = _predicted_label(model, names, indexer.labels)
    return data.agg(F.avg((F.col("target") == predicted).cast("double"))).first()[0]


def _predicted_label(model, names: list[str], labels: list[str]) -> Column:
    def margin(weights, intercept):
        return reduce(lambda a, b: a + b, [F.col(n) * float(w) for n, w in zip(names, weights, strict=True)]) + F.lit(
            float(intercept)
        )

    rows, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(rows) == 1:
        return F.when(margin(rows[0], intercepts[0]) > 0, F.lit(labels[-1])).otherwise(F.lit(labels[0]))
    margins = F.array(*[margin(w, b) for w, b in zip(rows, intercepts, strict=True)])
    best = F.array_position(margins, F.array_max(margins)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), best)


def ml_band(delta: float) -> float:
    """Accuracy gain to score: neutral within two points, else 2.5 per unit."""
    if delta > 0.02:
        return min(1.0, NEUTRAL_ML + delta * 2.5)
    if delta > -0.02:
        return NEUTRAL_ML
    return max(0.30, NEUTRAL_ML + delta * 2.5)


def downstream_ml(dirty: DataFrame, cleaned: DataFrame, profile: TableProfile) -> DataFrame:
    """One row (target, features, accuracy_before, accuracy_after, downstream).

    Logistic regression with an L2 term is trained on both versions by Spark ML;
    accuracy is that on the training rows, as the measure is defined.
    """
    spark = dirty.sparkSession
    schema = "target string, features int, accuracy_before double, accuracy_after double, downstream double"
    target, features = ml_columns(profile)
    if target is None or len(features) < 2:
        return spark.createDataFrame([(target, len(features), None, None, NEUTRAL_ML)], schema)
    before = _training_accuracy(dirty, target, features)
    after = _training_accuracy(cleaned, target, features)
    result = NEUTRAL_ML if before is None or after is None else ml_band(after - before)
    return spark.createDataFrame([(target, len(features), before, after, result)], schema)


def over_cleaning(dirty: DataFrame, cleaned: DataFrame, issues: DataFrame) -> DataFrame:
    """One row (over_cleaning): penalty for losing over 20 % of the rows without cause."""
    due = issues.where(F.col("issue_type").isin(*detect.ROW_CHECKS)).agg(F.count(F.lit(1)).alias("due"))
    both = row_counts(dirty, cleaned).unionByName(due, allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in ("rows_before", "rows_after", "due")])
    lost = F.col("rows_before") - F.col("rows_after")
    excess = F.greatest(lost - F.col("due"), F.lit(0)) / F.greatest("rows_before", F.lit(1))
    within = (F.col("rows_before") == 0) | (lost / F.greatest("rows_before", F.lit(1)) <= KEEP_SHARE)
    return row.select(
        F.when(within, F.lit(0.0)).otherwise(F.least(F.lit(0.20), 0.5 * excess)).alias("over_cleaning")
    )


def join_quality(attempts: DataFrame, context_table: str | None) -> DataFrame:
    """One row (join_quality) from a log of joins (table1, table2, valid)."""
    if context_table is None:
        return attempts.sparkSession.createDataFrame([(1.0,)], "join_quality double")
    good = F.col("valid") & ((F.col("table1") == context_table) | (F.col("table2") == context_table))
    return attempts.agg(
        F.when(F.count(F.lit(1)) == 0, 0.5).when(F.count(F.when(good, 1)) > 0, 1.0).otherwise(0.3).alias("join_quality")
    )


def composite(
    base: DataFrame, joins: DataFrame, intent: DataFrame, downstream: DataFrame, over: DataFrame
) -> DataFrame:
    """One row (composite) from the one-row frames of its parts; `base` holds `raw` and `unchanged`."""
    parts = [
        base.select(F.col("raw").alias("base"), F.col("unchanged")),
        joins.select("join_quality"),
        intent.select("intent_alignment"),
        downstream.select("downstream"),
        over.select("over_cleaning"),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    row = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    raw = (
        0.40 * F.col("base")
        + 0.20 * F.col("join_quality")
        + 0.20 * F.col("intent_alignment")
        + 0.20 * F.col("downstream")
        - F.col("over_cleaning")
    )
    total = F.when(F.coalesce("unchanged", F.lit(False)), 0.0).otherwise(cells.clamp01(cells.round_to(raw, 4)))
    return row.withColumn("composite", total)
